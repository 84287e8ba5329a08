"""Keyed merges, publication and state folding on plain tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.operators.checks import reconcile
from leadloom.operators.ranking import Key, latest_per_key

LEAD = ["empresa_id", "lead_consolidado_id"]


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], owner: str | None = None,
           insert_only: bool = False) -> DataFrame:
    """The table after merging ``incoming`` by key.

    The owner column of a stored row is never rewritten, and a row that claims another owner
    leaves the stored one untouched. ``insert_only`` tables keep their stored rows as they are.
    """
    columns = [c for c in stored.columns if c not in keys]
    s = stored.select(*keys, F.struct(*columns).alias("_s"), F.lit(True).alias("_in_s"))
    n = incoming.select(*keys, F.struct(*columns).alias("_n"), F.lit(True).alias("_in_n"))
    joined = s.join(n, list(keys), "full_outer")
    same_owner = F.lit(True) if owner is None else F.col(f"_s.{owner}").eqNullSafe(
        F.col(f"_n.{owner}"))
    replace = F.col("_in_n").isNotNull() & (
        F.col("_in_s").isNull() | (F.lit(not insert_only) & same_owner))
    return joined.select(*keys, *[
        F.when(replace, F.col(f"_n.{c}")).otherwise(F.col(f"_s.{c}")).alias(c) for c in columns
    ]).select(*stored.columns)


def current_from_runs(priorities: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest priority per lead among completed runs, as the first published pointer."""
    done = runs.where(F.col("estado") == "completada").select(
        "ejecucion_id", "etapa", "registrada_en")
    joined = priorities.select(*LEAD, "priorizacion_id", "ejecucion_id").join(done, "ejecucion_id")
    last = latest_per_key(joined, LEAD, [
        Key("registrada_en", desc=True), Key("ejecucion_id", desc=True),
        Key("priorizacion_id", desc=True)])
    return last.select(
        *LEAD, "priorizacion_id", F.lit(1).cast("bigint").alias("revision_entrada"),
        F.when(F.col("etapa") == "clasificacion_importada", "lote").otherwise("captura_manual")
        .alias("origen"),
        F.lit(False).alias("conflicto_lote"),
        F.lit(None).cast("string").alias("propuesta_lote_id"),
        F.lit(None).cast("boolean").alias("revision_antes_conflicto"))


def publish_batch(published: DataFrame, proposals: DataFrame, states: DataFrame | None = None
                  ) -> DataFrame:
    """Published pointers after a batch: new leads get one, a different one becomes a conflict.

    With ``states`` the review flag is remembered when a conflict begins.
    """
    n = proposals.select(*LEAD, F.col("priorizacion_id").alias("_new"))
    joined = published.join(n, LEAD, "full_outer")
    if states is not None:
        joined = joined.join(states.select(*LEAD, F.col("requiere_revision").alias("_flag")),
                             LEAD, "left")
    else:
        joined = joined.withColumn("_flag", F.lit(None).cast("boolean"))
    fresh = F.col("priorizacion_id").isNull()
    conflict = ~fresh & F.col("_new").isNotNull() & (F.col("_new") != F.col("priorizacion_id"))
    starts = conflict & ~F.coalesce("conflicto_lote", F.lit(False))
    return joined.select(
        *LEAD,
        F.coalesce("priorizacion_id", "_new").alias("priorizacion_id"),
        F.coalesce("revision_entrada", F.lit(1).cast("bigint")).alias("revision_entrada"),
        F.coalesce("origen", F.lit("lote")).alias("origen"),
        F.when(conflict, True).otherwise(F.coalesce("conflicto_lote", F.lit(False)))
        .alias("conflicto_lote"),
        F.when(conflict, F.col("_new")).otherwise(F.col("propuesta_lote_id"))
        .alias("propuesta_lote_id"),
        F.when(starts, F.col("_flag")).otherwise(F.col("revision_antes_conflicto"))
        .alias("revision_antes_conflicto"))


def guarded_publication(states: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and obsolete results: a result counts only for the lead's present revision."""
    s = states.select(*LEAD, F.col("revision_entrada").alias("_now"))
    joined = results.join(s, LEAD)
    same = F.col("revision_entrada") == F.col("_now")
    return joined.where(same).drop("_now"), joined.where(~same).drop("_now")


def propagate(states: DataFrame, pointers: DataFrame) -> DataFrame:
    """Operating state after pointer changes, unless the state already saw a newer revision."""
    p = pointers.select(*LEAD, F.struct(
        "priorizacion_id", "revision_entrada", "origen", "conflicto_lote").alias("_p"))
    joined = states.join(p, LEAD, "full_outer")
    absent = F.col("revision_entrada").isNull()
    take = F.col("_p").isNotNull() & (
        absent | (F.col("revision_entrada") <= F.col("_p.revision_entrada")))
    return joined.select(
        *LEAD,
        F.coalesce("estado", F.lit("abierto")).alias("estado"),
        F.when(take, F.col("_p.revision_entrada")).otherwise(F.col("revision_entrada"))
        .alias("revision_entrada"),
        F.when(take, F.col("_p.priorizacion_id")).otherwise(F.col("priorizacion_vigente_id"))
        .alias("priorizacion_vigente_id"),
        F.when(take, F.col("_p.origen")).otherwise(F.col("priorizacion_origen"))
        .alias("priorizacion_origen"),
        F.when(take, F.coalesce("requiere_revision", F.lit(False)) | F.col("_p.conflicto_lote"))
        .otherwise(F.col("requiere_revision")).alias("requiere_revision"))


def resolve_conflicts(published: DataFrame, decisions: DataFrame, audit: DataFrame
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adopt or keep batch proposals.

    ``decisions``: lead columns, ``propuesta_id, accion, nota``. Returns the new pointers, the
    audit rows and the rejected decisions. A decision already in ``audit`` changes nothing; one
    whose proposal is no longer pending is rejected.
    """
    d_cols = ["propuesta_id", "accion", "nota"]
    fresh = decisions.join(audit.select(*LEAD, *d_cols).distinct(), [*LEAD, *d_cols], "left_anti")
    joined = fresh.join(published, LEAD, "left")
    note = F.length(F.trim("nota"))
    valid = (
        F.col("accion").isin("adoptar", "conservar") & note.between(1, 500)
        & F.coalesce("conflicto_lote", F.lit(False))
        & F.coalesce(F.col("propuesta_lote_id") == F.col("propuesta_id"), F.lit(False))
    )
    good = joined.where(valid)
    marks = good.select(*LEAD, F.struct("propuesta_id", "accion").alias("_d"))
    after = published.join(marks, LEAD, "left")
    done = F.col("_d").isNotNull()
    pointers = after.select(
        *LEAD,
        F.when(done & (F.col("_d.accion") == "adoptar"), F.col("_d.propuesta_id"))
        .otherwise(F.col("priorizacion_id")).alias("priorizacion_id"),
        F.when(done, F.col("revision_entrada") + 1).otherwise(F.col("revision_entrada"))
        .alias("revision_entrada"),
        F.when(done, "revision_supervisada").otherwise(F.col("origen")).alias("origen"),
        F.when(done, False).otherwise(F.col("conflicto_lote")).alias("conflicto_lote"),
        F.when(~done, F.col("propuesta_lote_id")).alias("propuesta_lote_id"),
        F.col("revision_antes_conflicto"))
    return pointers, good.select(*LEAD, *d_cols), joined.where(~valid).select(*LEAD, *d_cols)


def restore_review_flag(states: DataFrame, before: DataFrame, after: DataFrame,
                        priorities: DataFrame) -> DataFrame:
    """Once a conflict ends, the review flag goes back to what it was before it."""
    was = before.where(F.col("conflicto_lote")).select(
        *LEAD, F.coalesce("revision_antes_conflicto", F.lit(True)).alias("_old"))
    now = after.where(~F.col("conflicto_lote")).select(
        *LEAD, "priorizacion_id", F.col("revision_entrada").alias("_rev"))
    queues = priorities.select("priorizacion_id", F.col("cola").startswith("revision").alias("_q"))
    ended = was.join(now, LEAD).join(queues, "priorizacion_id", "left").select(
        *LEAD, "_rev", (F.col("_old") | F.coalesce("_q", F.lit(False))).alias("_flag"))
    joined = states.join(ended, LEAD, "left")
    applies = F.col("_rev") == F.col("revision_entrada")
    return joined.withColumn(
        "requiere_revision",
        F.when(F.coalesce(applies, F.lit(False)), F.col("_flag")).otherwise(
            F.col("requiere_revision"))).drop("_rev", "_flag")


def idempotent_requests(requests: DataFrame, keys: Sequence[str], body: str, order: str
                        ) -> DataFrame:
    """Classify repeated requests: the first acts, equal bodies repeat it, others conflict."""
    first = requests.groupBy(*keys).agg(
        F.min(F.struct(order, body)).alias("_f"))
    joined = requests.join(first, list(keys))
    return joined.withColumn(
        "resultado_solicitud",
        F.when(F.col(order) == F.col(f"_f.{order}"), "efectiva")
        .when(F.col(body) == F.col(f"_f.{body}"), "repetida")
        .otherwise("conflicto")).drop("_f")


def fold_activities(activities: DataFrame, ts: str = "ts", row: str = "event_id") -> DataFrame:
    """Present state per lead from its activities: last terminal result and next action."""
    at = F.struct(ts, row)
    terminal = F.col("resultado").isin(V.TERMINAL_RESULTS)
    folded = activities.groupBy(*LEAD).agg(
        F.max_by(F.when(terminal, F.col("resultado")), F.when(terminal, at)).alias("estado"),
        F.max_by("proxima_accion_en", at).alias("proxima_accion_en"),
        F.count(F.lit(1)).alias("gestiones"))
    return folded.withColumn("estado", F.coalesce("estado", F.lit("abierto")))


def complete_assignments(assignments: DataFrame, activities: DataFrame) -> DataFrame:
    """Assignments of a day with an activity of that lead and day become completed."""
    touched = activities.select(
        *LEAD, F.col("dia").alias("fecha_operativa")).distinct().withColumn("_t", F.lit(True))
    joined = assignments.join(touched, [*LEAD, "fecha_operativa"], "left")
    return joined.withColumn(
        "estado", F.when(F.col("_t"), "completada").otherwise(F.col("estado"))).drop("_t")


def settle_jobs(jobs: DataFrame, now: Column, revisions: DataFrame | None = None) -> DataFrame:
    """Work log at ``now``: expired leases retry or fail, finished work on an old revision is
    obsolete. Jobs with the same logical key count once (the first)."""
    key = ["empresa_id", "tipo_entidad", "entidad_id", "tipo_trabajo", "revision_entrada"]
    first = jobs.groupBy(*key).agg(F.min("trabajo_id").alias("trabajo_id"))
    unique = jobs.join(first, [*key, "trabajo_id"], "left_semi")
    if revisions is not None:
        unique = unique.join(
            revisions.select("entidad_id", F.col("revision").alias("_now")), "entidad_id", "left")
    else:
        unique = unique.withColumn("_now", F.col("revision_entrada"))
    expired = (F.col("estado") == "ejecutando") & (F.col("lease_hasta") < now)
    stale = (F.col("estado") == "completado") & (F.col("_now") != F.col("revision_entrada"))
    state = (
        F.when(expired & (F.col("intentos") >= F.col("max_intentos")), "fallido")
        .when(expired, "reintento").when(stale, "obsoleto").otherwise(F.col("estado")))
    return unique.withColumns({
        "ultimo_error": F.when(expired, "lease_vencido"),
        "disponible_en": F.when(expired, now).otherwise(F.col("disponible_en")),
        "lease_hasta": F.when(~F.coalesce(expired, F.lit(False)), F.col("lease_hasta")),
        "estado": state,
    }).drop("_now")


def seed_states(states: DataFrame, pointers: DataFrame) -> DataFrame:
    """Operating rows for published leads that have none yet."""
    return pointers.join(states.select(*LEAD), LEAD, "left_anti").select(
        *LEAD, F.lit("abierto").alias("estado"), "revision_entrada",
        F.col("priorizacion_id").alias("priorizacion_vigente_id"),
        F.col("origen").alias("priorizacion_origen"),
        F.col("conflicto_lote").alias("requiere_revision"))


def audit_events(rows: DataFrame, action: str, entity: str, key: str, detail: Sequence[str],
                 actor: str = "actor") -> DataFrame:
    """One audit row per decision."""
    return rows.select(
        "empresa_id", F.col(actor).alias("actor"), F.lit(action).alias("accion"),
        F.lit(entity).alias("tipo_entidad"), F.col(key).cast("string").alias("entidad_id"),
        F.to_json(F.struct(*detail), {"ignoreNullFields": "false"}).alias("detalle"))


def load_is_done(runs: DataFrame, run_id: str) -> bool:
    """Whether this exact load already completed (then only reconciliation is due)."""
    done = runs.where((F.col("ejecucion_id") == run_id) & (F.col("estado") == "completada"))
    return len(done.take(1)) > 0


def load_once(
    runs: DataFrame, run_id: str, expected: dict[str, DataFrame], keys: dict[str, Sequence[str]],
    load: Callable[[], None], stored: Callable[[str], DataFrame],
) -> DataFrame:
    """Load unless this exact load completed before; in both cases hold the stored tables against
    the expected ones.

    Returns one row per absent or differing row: tabla, clave, estado, columnas.
    """
    if not load_is_done(runs, run_id):
        load()
    reports = []
    for name, frame in expected.items():
        found = reconcile(frame, stored(name), keys[name])
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys[name]])
        reports.append(found.select(
            F.lit(name).alias("tabla"), key.alias("clave"), *[c for c in found.columns if c not in keys[name]]))
    return reduce(DataFrame.unionByName, reports)
