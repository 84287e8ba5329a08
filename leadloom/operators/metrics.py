"""Ranking-quality metrics over scored labels, grouped and tie-aware.

Rows are first counted per distinct score; running counts are carried between score buckets, so
neither a popular score nor a continuous one puts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.ranking import Running, with_running


def score_steps(df: DataFrame, y: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score (best first) with its rows, positives and running counts."""
    return weighted_steps(df.withColumn("_w", F.lit(1)), y, score, "_w", group)


def weighted_steps(df: DataFrame, y: str, score: str, weight: str, group: Sequence[str] = ()
                   ) -> DataFrame:
    """The same with integer row weights."""
    keys = list(group) or ["_all"]
    base = df if group else df.withColumn("_all", F.lit(0))
    steps = base.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(weight).alias("n"), F.sum(F.col(y) * F.col(weight)).alias("tp"))
    steps = steps.withColumn("_neg", -F.col("score"))
    run = with_running(
        steps, keys, ["_neg"], F.floor(F.col("_neg") * 256),
        {"n_antes": Running("sum", F.col("n")), "tp_antes": Running("sum", F.col("tp"))})
    totals = steps.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("tp").alias("positivos"))
    out = run.join(totals, keys).drop("_neg")
    return out if group else out.drop("_all")


def _fold(steps: DataFrame, group: Sequence[str], **aggs: Column) -> DataFrame:
    return steps.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()])


def average_precision(steps: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Step-form average precision; ties share one step."""
    precision = (F.col("tp_antes") + F.col("tp")) / (F.col("n_antes") + F.col("n"))
    return _fold(steps, group, ap=F.round(F.sum(
        F.col("tp") / F.nullif(F.col("positivos"), F.lit(0)) * precision), 6))


def roc_auc(steps: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting one half."""
    neg = F.col("n") - F.col("tp")
    pairs = F.col("positivos") * (F.col("total") - F.col("positivos"))
    return _fold(steps, group, auc=F.round(F.sum(
        neg * (F.col("tp_antes") + F.col("tp") / 2) / F.nullif(pairs, F.lit(0))), 6))


def top_fraction(steps: DataFrame, fraction: float = 0.2, group: Sequence[str] = ()) -> DataFrame:
    """Expected positives, precision, recall and lift of the first part of the queue.

    The score at the cut contributes the expected share of its tied rows.
    """
    k = F.greatest(F.lit(1), F.ceil(F.col("total") * fraction))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("n_antes")))
    hits = F.sum(F.col("tp") * taken / F.col("n"))
    out = _fold(steps, group, k=F.max(k).cast("bigint"), cierres=hits,
                _p=F.max("positivos"), _n=F.max("total"))
    precision = F.col("cierres") / F.col("k")
    return out.select(
        *group, "k", F.round("cierres", 6).alias("cierres_esperados"),
        F.round(precision, 6).alias("precision_top"),
        F.round(F.col("cierres") / F.nullif("_p", F.lit(0)), 6).alias("recall_top"),
        F.round(precision / F.nullif(F.col("_p") / F.col("_n"), F.lit(0.0)), 6).alias("lift_top"))


def curve_points(steps: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Precision and recall after each distinct score."""
    hits = F.col("tp_antes") + F.col("tp")
    return steps.select(
        *group, "score",
        F.round(hits / (F.col("n_antes") + F.col("n")), 6).alias("precision"),
        F.round(hits / F.nullif("positivos", F.lit(0)), 6).alias("recall"))


def brier(df: DataFrame, y: str, score: str, group: Sequence[str] = (), weight: str | None = None
          ) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight)
    gap = F.col(score) - F.col(y)
    return df.groupBy(*group).agg(F.round(F.sum(w * gap * gap) / F.sum(w), 6).alias("brier"))


def confusion(df: DataFrame, y: str, score: str, cut: float = 0.5, group: Sequence[str] = (),
              weight: str | None = None) -> DataFrame:
    flag, pos = F.col(score) >= cut, F.col(y) == 1
    w = F.lit(1) if weight is None else F.col(weight)

    def rows(where: Column) -> Column:
        return F.sum(F.when(where, w).otherwise(0)).cast("bigint")

    parts = {"vp": flag & pos, "fp": flag & ~pos, "fn": ~flag & pos, "vn": ~flag & ~pos}
    return df.groupBy(*group).agg(*[F.coalesce(rows(c), F.lit(0)).alias(n) for n, c in parts.items()])


def balanced_weights(df: DataFrame, y: str, group: Sequence[str] = ()) -> DataFrame:
    """n / (2 * n_class) per class."""
    counts = df.groupBy(*group, y).agg(F.count(F.lit(1)).alias("filas"))
    total = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if group:
        joined = counts.join(total, list(group))
    else:
        from leadloom.operators.ranking import attach_single

        joined = attach_single(counts, total)
    return joined.select(
        *group, F.col(y), "filas", F.round(F.col("_n") / (2 * F.col("filas")), 6).alias("peso"))


def month_rounds(df: DataFrame, date: str, rounds: Sequence[tuple[str, str | None, str, str]]) -> DataFrame:
    """Rows tagged per rolling-origin round: (name, train start, validation start, end).

    A round without a train start learns from everything before its validation. Later rows belong to
    no round, so that no choice is made on them.
    """
    d = F.col(date)
    tags = []
    for name, start, cut, end in rounds:
        cut_at, end_at = F.lit(cut).cast("date"), F.lit(end).cast("date")
        learnt = d < cut_at if start is None else (d >= F.lit(start).cast("date")) & (d < cut_at)
        use = F.when(learnt, "entrenamiento").when((d >= cut_at) & (d < end_at), "validacion")
        tags.append(F.struct(F.lit(name).alias("ronda"), use.alias("uso")))
    return df.select("*", F.inline(F.array(*tags))).where(F.col("uso").isNotNull())


def round_summary(tagged: DataFrame, y: str, date: str) -> DataFrame:
    return tagged.groupBy("ronda", "uso").agg(
        F.count(F.lit(1)).alias("filas"), F.sum(y).alias("cierres"),
        F.round(F.avg(y), 6).alias("tasa_cierre"),
        F.date_format(F.min(date), "yyyy-MM-dd").alias("desde"),
        F.date_format(F.max(date), "yyyy-MM-dd").alias("hasta"))


def category_drift(history: DataFrame, current: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of every category in both populations, absent ones as zero."""
    from leadloom.operators.profile import long_form

    def shares(df: DataFrame, name: str) -> DataFrame:
        long = long_form(df, fields)
        n = long.groupBy("campo").agg(F.count("valor").alias("_n"))
        c = long.where(F.col("valor").isNotNull()).groupBy("campo", "valor").agg(
            F.count(F.lit(1)).alias("_c"))
        return c.join(n, "campo").select(
            "campo", "valor", (F.col("_c") / F.col("_n")).alias(name))

    joined = shares(history, "historico").join(
        shares(current, "actual"), ["campo", "valor"], "full_outer")
    return joined.select("campo", "valor", *[
        F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("historico", "actual")])


def feature_frame(history: DataFrame, keep: Sequence[str] = ("lead_id", "empresa_id", "fecha")
                  ) -> DataFrame:
    """The five approved categorical features; anything later than the decision stays out."""
    unknown = F.lit("DESCONOCIDO")
    base = ["canal", "modelo_sku", "manifesto_cuota_inicial", "forma_pago_declarada"]
    return history.select(
        *keep,
        *[F.coalesce(F.col(c).cast("string"), unknown).alias(c) for c in base],
        F.when(F.col("pidio_cita") == "SI", "SI").otherwise("NO_OBSERVADA").alias(
            "cita_observada"))


def observed_outcomes(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a label, incidents of rows left out). No outcome is never a loss."""
    known = F.coalesce(F.col("desenlace").isin("Cerrado", "Perdido"), F.lit(False))
    dated = F.col("fecha").isNotNull()
    kept = history.where(known & dated).withColumn(
        "y", F.when(F.col("desenlace") == "Cerrado", 1).otherwise(0).cast("bigint"))
    out = history.where(~(known & dated)).select(
        F.lit("fuera_del_entrenamiento").alias("tipo"), "empresa_id", "lead_id",
        F.when(~known, "Resultado no observado: no se convierte en perdido.")
        .otherwise("Fecha de registro inválida: no permite partición temporal.").alias("motivo"),
        F.lit("Conservar en la fuente; excluir solo de este experimento.").alias("accion"))
    return kept, out
