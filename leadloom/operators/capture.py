"""Batch versions of intake, review resolution and single-chat publication.

Each function takes a batch of requests and returns the rows to append or merge per table. Ids
derive from the request, so repeating a batch produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions import ids, signals
from leadloom.operators.changes import ChangeSet, Together, plan_changes, written
from leadloom.operators.merge import LEAD, audit_events

ACTIONS = ["vincular", "rechazar", "crear_distinto"]


def _web_id(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit("WEB-"), F.substring(ids.row_id(F.lit(kind), key), 1, 32))


def _priority(df: DataFrame, sku: str, initial: Column, payment: str, visit: Column) -> DataFrame:
    args = (sku, initial, payment, visit)
    out = df.withColumns({
        "puntos": signals.points(*args).cast("bigint"),
        "temperatura": signals.temperature(*args[1:]),
        "explicacion": signals.explanation(*args, style="intake"),
        "version_reglas": F.lit(V.RULES_VERSION),
    })
    out = out.withColumns({
        "score_prioridad": signals.score(F.col("puntos")),
        "cola": signals.queue("temperatura", F.lit(False), F.lit("valido")),
    })
    return out.withColumn("accion_sugerida", signals.action("cola", "temperatura"))


def _captured(requests: DataFrame) -> DataFrame:
    """The requests with the ids of their rows and their priority."""
    base = requests.withColumns({
        "lead_consolidado_id": F.coalesce("lead_existente", _web_id("lead", "solicitud_id")),
        "lead_id_origen": _web_id("consulta", "solicitud_id"),
        "ejecucion_id": _web_id("ejecucion", "solicitud_id"),
        "priorizacion_id": _web_id("prioridad", "solicitud_id"),
        "captura_id": _web_id("captura", "solicitud_id"),
    })
    return _priority(
        base, "modelo_sku", F.coalesce(F.col("cuota_inicial"), F.lit(0)) > 0, "forma_pago",
        F.col("cliente_pidio_cita"))


def _capture_rows(origin: str) -> dict[str, list]:
    """The columns of the rows that a capture adds to each table; a lead is added for a new person only."""
    return {
        "leads": [
            *LEAD, F.col("nombre_limpio").alias("nombre_presentacion"),
            F.to_date("registrada_en").alias("primera_fecha_registro"),
            F.date_format("registrada_en", "HH:mm:ss").alias("primera_fecha_registro_hora"),
            F.lit("fecha_hora").alias("primera_fecha_registro_precision"),
            F.lit("web").alias("origen_registro")],
        "consultas": [
            "lead_id_origen", *LEAD, F.col("sede_id").alias("punto_venta_id"),
            F.col("nombre_limpio").alias("nombre_declarado"),
            F.col("telefono_valido").alias("telefono"), F.col("correo_valido").alias("email"),
            "modelo_sku", F.lit("web").alias("origen_registro")],
        "capturas": [
            "captura_id", *LEAD, "lead_id_origen", F.col("actor").alias("autor"),
            F.lit(origin).alias("origen")],
        "ejecuciones": [
            "ejecucion_id", "empresa_id", F.lit("prioridad_manual").alias("etapa"),
            F.col("captura_id").alias("huella_entrada"), F.lit("completada").alias("estado"),
            F.col("registrada_en")],
        "priorizaciones": [
            "priorizacion_id", *LEAD, "ejecucion_id",
            F.col("lead_id_origen").alias("lead_id_contexto"), "score_prioridad", "temperatura",
            "cola", "explicacion", "accion_sugerida", "version_reglas"],
    }


def _raised_pointers(captured: DataFrame, states: DataFrame, origin: str) -> DataFrame:
    """The published priority of each lead after its captures."""
    last = captured.groupBy(*LEAD).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("registrada_en", "solicitud_id")).alias("_last"))
    known = states.select(*LEAD, F.col("revision_entrada").alias("_rev"))
    return last.join(known, LEAD, "left").select(
        *LEAD, _web_id("prioridad", "_last.solicitud_id").alias("priorizacion_id"),
        # a new lead starts at revision 1 with its first capture
        (F.coalesce("_rev", F.lit(0)) + F.col("_n")).cast("bigint").alias("revision_entrada"),
        F.lit(origin).alias("origen"), F.lit(False).alias("conflicto_lote"),
        F.lit(None).cast("string").alias("propuesta_lote_id"),
        F.lit(None).cast("boolean").alias("revision_antes_conflicto"))


def plan_intake(requests: DataFrame, states: DataFrame, origin: str = "captura_manual"
                ) -> dict[str, DataFrame]:
    """Rows of accepted captures.

    ``requests``: solicitud_id, empresa_id, actor, nombre_limpio, telefono_valido, correo_valido,
    sede_id, modelo_sku, cuota_inicial, forma_pago, cliente_pidio_cita, registrada_en and
    ``lead_existente`` (null for a new person). Every capture raises the revision of its lead; of
    several for one lead the last one's priority is the published one.
    """
    captured = _captured(requests)
    fresh = captured.where(F.col("lead_existente").isNull())
    return {
        **{n: (fresh if n == "leads" else captured).select(*columns) for n, columns in _capture_rows(origin).items()},
        "prioridades_publicadas": _raised_pointers(captured, states, origin),
        "auditoria": audit_events(
            captured, "capturar_lead", "lead", "lead_consolidado_id", ["lead_id_origen"]),
    }


KEYS = {
    "leads": LEAD, "consultas": ["lead_id_origen"], "capturas": ["captura_id"], "ejecuciones": ["ejecucion_id"],
    "priorizaciones": ["priorizacion_id"], "prioridades_publicadas": LEAD, "revisiones": ["revision_id"],
    "extracciones_ia": ["extraccion_id"], "intereses_modelo": ["interes_id"],
}


def _lead_unit() -> Column:
    return ids.row_id(*LEAD)


def intake_changes(requests: DataFrame, states: DataFrame, stored: dict[str, DataFrame],
                   origin: str = "captura_manual") -> ChangeSet:
    """The change log of accepted captures, a lead's rows being one unit.

    Requests whose capture is stored already add nothing, so a batch that comes again is empty.
    """
    if "capturas" in stored:
        requests = requests.withColumn("captura_id", _web_id("captura", "solicitud_id")).join(
            stored["capturas"].select("captura_id"), "captura_id", "left_anti").drop("captura_id")
    # read once; the requests of a lead stand together, those of a very busy one in several files
    requests = written(
        requests.withColumn("_near", F.coalesce("lead_existente", "solicitud_id")).hint("rebalance", "empresa_id", "_near")
        .sortWithinPartitions("lead_existente", "empresa_id", "solicitud_id").drop("_near"), "requests")
    captured = _captured(requests)
    rows = {n: F.struct(*columns) for n, columns in _capture_rows(origin).items()}
    rows["leads"] = F.when(F.col("lead_existente").isNull(), rows["leads"])
    # a run belongs to the lead of its capture
    return plan_changes(
        {"prioridades_publicadas": _raised_pointers(captured, states, origin)}, stored, KEYS,
        {"prioridades_publicadas": _lead_unit()}, together=[Together(captured, rows, _lead_unit())])


def review_changes(reviews: DataFrame, decisions: DataFrame, states: DataFrame) -> tuple[ChangeSet, DataFrame]:
    """(change log of the decided reviews, the decisions that could not be applied with the reason)."""
    out = resolve_reviews(reviews, decisions, states)
    decided = out["revisiones"].join(decisions.select("revision_id").distinct(), "revision_id", "left_semi").select(
        *reviews.columns)
    log = plan_changes({"revisiones": decided}, {"revisiones": reviews}, KEYS, {"revisiones": F.col("revision_id")})
    return log, out["rechazadas"]


def publication_changes(results: DataFrame, catalogue: DataFrame, states: DataFrame, stored: dict[str, DataFrame]
                        ) -> tuple[ChangeSet, DataFrame]:
    """(change log of the finished extractions of present revisions, the obsolete results).

    A lead's rows are one unit. Of several results for a lead all are kept, and the pointer goes to
    the one with the greatest job id.
    """
    now, stale = _present_results(results, states)
    # scored once; the results of a lead stand together, those of a very busy one in several files
    scored = _scored_results(now, _named_models(now, catalogue))
    scored = written(scored.hint("rebalance", *LEAD).sortWithinPartitions(*LEAD, "extraccion_id"), "results")
    named = _named_models(scored, catalogue)
    columns = _result_rows()
    pointers = scored.select(*columns.pop("prioridades_publicadas"))
    others = [c for c in pointers.columns if c not in LEAD]
    pointers = pointers.groupBy(*LEAD).agg(
        F.max_by(F.struct(*others), "priorizacion_id").alias("_p")).select(*LEAD, "_p.*")
    rows = {n: F.struct(*c) for n, c in columns.items()}
    # without an id only the priority is known
    known = F.col("extraccion_id").isNotNull()
    rows.update({n: F.when(known, rows[n]) for n in ("ejecuciones", "extracciones_ia")})
    log = plan_changes(
        {"prioridades_publicadas": pointers,
         "intereses_modelo": named.where(known).withColumn("_unidad", _lead_unit()).drop(*LEAD)}, stored, KEYS,
        {"prioridades_publicadas": _lead_unit(), "intereses_modelo": F.col("_unidad")}, helpers=("_unidad",),
        together=[Together(scored, rows, _lead_unit())])
    return log, stale


def resolve_reviews(reviews: DataFrame, decisions: DataFrame, states: DataFrame
                    ) -> dict[str, DataFrame]:
    """Decide pending captures: link to a lead, reject, or create a distinct person.

    ``reviews``: revision_id, empresa_id, estado, resolucion. ``decisions``: revision_id, accion,
    nota, lead_id, actor. Returns ``revisiones`` (after), ``aceptadas`` (revision_id and
    ``lead_existente``, to go through the intake rules and ``plan_intake`` again), ``rechazadas``
    (decisions that could not be applied, with the reason) and ``auditoria``. Repeating a decision
    changes nothing; a different one on a settled review is refused.
    """
    d = decisions.withColumns({
        "lead_id": F.trim(F.coalesce("lead_id", F.lit(""))),
        "nota": F.coalesce("nota", F.lit("")),
    })
    d = d.withColumn("_digest", ids.row_id("accion", "lead_id", F.trim("nota")))
    joined = d.join(reviews, "revision_id", "left").join(
        states.select("empresa_id", F.col("lead_consolidado_id").alias("lead_id"),
                      F.lit(True).alias("_known")), ["empresa_id", "lead_id"], "left")
    link, note = F.col("accion") == "vincular", F.trim("nota") != ""
    pending = F.col("estado") == "pendiente"
    why = (
        F.when(F.col("estado").isNull(), "revision_inexistente")
        .when(~F.col("accion").isin(ACTIONS) | (F.length("nota") > 500), "decision_invalida")
        .when(link & (F.col("lead_id") == ""), "falta_lead")
        .when(~link & (F.col("lead_id") != ""), "lead_no_admitido")
        .when(~link & ~note, "falta_motivo")
        .when(~pending & (F.col("resolucion") != F.col("_digest")), "decision_distinta")
        .when(pending & link & F.col("_known").isNull(), "lead_ajeno"))
    judged = joined.withColumn("motivo", why)
    applied = judged.where(F.col("motivo").isNull() & pending)
    marks = applied.select(
        "revision_id", F.col("_digest").alias("_r"),
        F.when(F.col("accion") == "rechazar", "rechazada").otherwise("resuelta").alias("_e"))
    after = reviews.join(marks, "revision_id", "left").withColumns({
        "estado": F.coalesce("_e", "estado"), "resolucion": F.coalesce("_r", "resolucion"),
    }).drop("_r", "_e")
    return {
        "revisiones": after,
        "aceptadas": applied.where(F.col("accion") != "rechazar").select(
            "revision_id", F.nullif("lead_id", F.lit("")).alias("lead_existente")),
        "rechazadas": judged.where(F.col("motivo").isNotNull()).select("revision_id", "motivo"),
        "auditoria": audit_events(
            applied, "resolver_captura_revision", "captura_revision", "revision_id",
            ["accion", "lead_id", "nota"]),
    }


def _present_results(results: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results for the present revision of their lead, the obsolete ones)."""
    from leadloom.operators.merge import guarded_publication

    now, stale = guarded_publication(
        states, results.withColumn("extraccion_id", F.concat(F.lit("IA-"), F.col("trabajo_id"))))
    return now, stale.select("trabajo_id", *LEAD, "revision_entrada")


def _named_models(now: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The models mentioned in each result, with its lead."""
    from leadloom.operators.catalog import resolve_mentions

    mentions = now.select(
        *LEAD, "extraccion_id", F.posexplode("modelos_interes").alias("posicion", "texto_mencionado"))
    return resolve_mentions(mentions, "texto_mencionado", catalogue).select(
        F.concat_ws("-", "extraccion_id", F.col("posicion").cast("string")).alias("interes_id"),
        "extraccion_id", "texto_mencionado", F.col("sku").alias("modelo_sku"),
        F.when(F.col("sku").isNotNull(), "exacto").otherwise("no_identificado")
        .alias("estado_identificacion"), *LEAD)


def _scored_results(now: DataFrame, named: DataFrame) -> DataFrame:
    """The results with their priority; a model counts when it is the only one that was meant."""
    single = named.groupBy("extraccion_id").agg(
        F.when((F.countDistinct("modelo_sku") == 1) & (F.count("modelo_sku") == F.count(F.lit(1))),
               F.max("modelo_sku")).alias("modelo_sku"))
    positive = (F.coalesce("inicial_evidencias", F.lit(0)) > 0) & (
        (F.coalesce("cuota_inicial", F.lit(0.0)) > 0)
        | (F.col("cuota_inicial").isNull() & (F.coalesce("inicial_minimo", F.lit(0.0)) > 0)))
    return _priority(
        now.join(single, "extraccion_id", "left"), "modelo_sku", positive, "forma_pago",
        F.col("cliente_pidio_cita"))


def _result_rows() -> dict[str, list]:
    """The columns of the rows that a result adds to each table."""
    return {
        "ejecuciones": [
            F.col("extraccion_id").alias("ejecucion_id"), "empresa_id",
            F.lit("extraccion_individual").alias("etapa"), F.lit("completada").alias("estado")],
        "extracciones_ia": [
            "extraccion_id", "conversacion_id", F.col("extraccion_id").alias("ejecucion_id"),
            F.lit("valido").alias("estado_validacion")],
        "priorizaciones": [
            F.col("extraccion_id").alias("priorizacion_id"), *LEAD,
            F.col("lead_id_origen").alias("lead_id_contexto"),
            F.col("conversacion_id").alias("conversacion_id_contexto"), "score_prioridad",
            "temperatura", "cola", "explicacion", "accion_sugerida", "version_reglas"],
        "prioridades_publicadas": [
            *LEAD, F.col("extraccion_id").alias("priorizacion_id"), "revision_entrada",
            F.lit("gemini").alias("origen"), F.lit(False).alias("conflicto_lote")],
    }


def publish_extractions(results: DataFrame, catalogue: DataFrame, states: DataFrame
                        ) -> dict[str, DataFrame]:
    """Rows of finished single-chat extractions.

    ``results``: trabajo_id, empresa_id, lead_consolidado_id, lead_id_origen, conversacion_id,
    revision_entrada, modelos_interes (array), cuota_inicial, inicial_minimo, inicial_evidencias,
    forma_pago, cliente_pidio_cita. Only a result for the lead's present revision is published;
    the others are returned as ``obsoletas``.
    """
    now, stale = _present_results(results, states)
    named = _named_models(now, catalogue)
    scored = _scored_results(now, named)
    return {
        **{n: (scored if n == "priorizaciones" else now).select(*columns) for n, columns in _result_rows().items()},
        "intereses_modelo": named.drop(*LEAD),
        "obsoletas": stale,
    }
