"""Evaluation queries: labels, splits, ranking metrics, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import metrics
from leadloom.plans import bindings as B
from leadloom.plans.registry import Tables, query

_STEPS = """SELECT *, sum(n) OVER w - n AS n_antes, sum(tp) OVER w - tp AS tp_antes,
    sum(n) OVER () AS total, sum(tp) OVER () AS positivos FROM
    (SELECT score, count(*) AS n, sum(y) AS tp FROM scored_labels GROUP BY 1)
    WINDOW w AS (ORDER BY score DESC)"""
_GSTEPS = """SELECT *, sum(n) OVER w - n AS n_antes, sum(tp) OVER w - tp AS tp_antes,
    sum(n) OVER (PARTITION BY grupo) AS total, sum(tp) OVER (PARTITION BY grupo) AS positivos FROM
    (SELECT grupo, score, count(*) AS n, sum(y) AS tp FROM scored_labels GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY grupo ORDER BY score DESC)"""


@query("k1_features", B.sql("""SELECT lead_id, coalesce(canal, 'DESCONOCIDO') AS canal,
    coalesce(modelo_sku, 'DESCONOCIDO') AS modelo_sku,
    coalesce(manifesto_cuota_inicial, 'DESCONOCIDO') AS manifesto_cuota_inicial,
    coalesce(forma_pago_declarada, 'DESCONOCIDO') AS forma_pago_declarada,
    CASE WHEN pidio_cita = 'SI' THEN 'SI' ELSE 'NO_OBSERVADA' END AS cita_observada
    FROM history""", "history"))
def k1_features(t: Tables) -> DataFrame:
    return metrics.feature_frame(B.history(t)).drop("empresa_id", "fecha")


@query("k2_labels", B.sql("""SELECT lead_id, CAST(desenlace = 'Cerrado' AS BIGINT) AS y
    FROM history WHERE desenlace IN ('Cerrado', 'Perdido')""", "history"))
def k2_labels(t: Tables) -> DataFrame:
    return metrics.observed_outcomes(B.history(t))[0].select("lead_id", "y")


@query("k2_left_out", B.sql("""SELECT lead_id, 'Resultado no observado: no se convierte en perdido.'
    AS motivo FROM history WHERE desenlace = 'Sin gestión'""", "history"))
def k2_left_out(t: Tables) -> DataFrame:
    return metrics.observed_outcomes(B.history(t))[1].select("lead_id", "motivo")


ROUNDS = [("mayo", "1998-03-01", "1998-05-01", "1998-06-01"),
          ("junio", "1998-03-01", "1998-06-01", "1998-07-01")]


@query("k3_rounds", B.sql("""WITH o AS (SELECT fecha, CAST(desenlace = 'Cerrado' AS BIGINT) AS y
        FROM history WHERE desenlace IN ('Cerrado', 'Perdido')),
    r AS (""" + " UNION ALL ".join(
        f"""SELECT '{n}' AS ronda, CASE WHEN fecha < DATE '{c}' THEN 'entrenamiento'
            ELSE 'validacion' END AS uso, y, fecha FROM o
            WHERE fecha >= DATE '{s}' AND fecha < DATE '{e}'""" for n, s, c, e in ROUNDS) + """)
    SELECT ronda, uso, count(*) AS filas, CAST(sum(y) AS BIGINT) AS cierres,
        round(avg(y), 6) AS tasa_cierre, strftime(min(fecha), '%Y-%m-%d') AS desde,
        strftime(max(fecha), '%Y-%m-%d') AS hasta FROM r GROUP BY 1, 2""", "history"))
def k3_rounds(t: Tables) -> DataFrame:
    kept, _ = metrics.observed_outcomes(B.history(t))
    return metrics.round_summary(metrics.month_rounds(kept, "fecha", ROUNDS), "y", "fecha")


@query("k7_weights", B.sql("""SELECT y, count(*) AS filas,
    round((SELECT count(*) FROM scored_labels) / (2.0 * count(*)), 6) AS peso
    FROM scored_labels GROUP BY 1""", "scored_labels"))
def k7_weights(t: Tables) -> DataFrame:
    return metrics.balanced_weights(B.scored_labels(t), "y")


def _steps(t: Tables, group=()) -> DataFrame:
    return metrics.score_steps(B.scored_labels(t), "y", "score", group)


@query("k9_ap", B.sql("""SELECT round(sum(tp / positivos * (tp_antes + tp) / (n_antes + n)), 6)
    AS ap FROM steps""", "scored_labels", steps=_STEPS))
def k9_ap(t: Tables) -> DataFrame:
    return metrics.average_precision(_steps(t))


@query("k10_auc", B.sql("""SELECT round(sum((n - tp) * (tp_antes + tp / 2.0))
    / max(positivos * (total - positivos)), 6) AS auc FROM steps""", "scored_labels",
    steps=_STEPS))
def k10_auc(t: Tables) -> DataFrame:
    return metrics.roc_auc(_steps(t))


@query("k11_brier", B.sql("SELECT round(avg((score - y) * (score - y)), 6) AS brier "
                          "FROM scored_labels", "scored_labels"))
def k11_brier(t: Tables) -> DataFrame:
    return metrics.brier(B.scored_labels(t), "y", "score")


_TOP = """SELECT {g} max(k) AS k, round(sum(CASE WHEN n_antes + n <= k THEN tp
        WHEN n_antes < k THEN tp * (k - n_antes) / n ELSE 0 END), 6) AS cierres_esperados,
    round(sum(CASE WHEN n_antes + n <= k THEN tp WHEN n_antes < k THEN tp * (k - n_antes) / n
        ELSE 0 END) / max(k), 6) AS precision_top,
    round(sum(CASE WHEN n_antes + n <= k THEN tp WHEN n_antes < k THEN tp * (k - n_antes) / n
        ELSE 0 END) / max(positivos), 6) AS recall_top,
    round(sum(CASE WHEN n_antes + n <= k THEN tp WHEN n_antes < k THEN tp * (k - n_antes) / n
        ELSE 0 END) / max(k) / (max(positivos) / max(total)), 6) AS lift_top
    FROM (SELECT *, CAST(greatest(1, ceil(total * 0.2)) AS BIGINT) AS k FROM steps) {b}"""


@query("k12_top20", B.sql(_TOP.format(g="", b=""), "scored_labels", steps=_STEPS))
def k12_top20(t: Tables) -> DataFrame:
    return metrics.top_fraction(_steps(t))


@query("f4_fraction_by_group", B.sql(_TOP.format(g="grupo,", b="GROUP BY grupo"),
                                     "scored_labels", steps=_GSTEPS))
def f4_fraction_by_group(t: Tables) -> DataFrame:
    return metrics.top_fraction(_steps(t, ["grupo"]), group=["grupo"])


@query("k13_confusion", B.sql("""SELECT count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS vp,
    count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp,
    count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn,
    count(*) FILTER (WHERE score < 0.5 AND y = 0) AS vn FROM scored_labels""", "scored_labels"))
def k13_confusion(t: Tables) -> DataFrame:
    return metrics.confusion(B.scored_labels(t), "y", "score")


@query("k15_by_group", B.sql("""SELECT grupo,
    round(sum(tp / positivos * (tp_antes + tp) / (n_antes + n)), 6) AS ap FROM steps
    GROUP BY 1""", "scored_labels", steps=_GSTEPS))
def k15_by_group(t: Tables) -> DataFrame:
    return metrics.average_precision(_steps(t, ["grupo"]), ["grupo"])


@query("k16_baselines", B.sql("""WITH o AS (SELECT *, CAST(desenlace = 'Cerrado' AS BIGINT) AS y
        FROM history WHERE desenlace IN ('Cerrado', 'Perdido')),
    s AS (SELECT y, ((modelo_sku IS NOT NULL)::INT * 10 + coalesce(manifesto_cuota_inicial = 'SI',
        false)::INT * 30 + (forma_pago_declarada IN ('credito', 'contado'))::INT * 10
        + (pidio_cita = 'SI')::INT * 40) / 90.0 AS score FROM o),
    g AS (SELECT score, count(*) AS n, sum(y) AS tp FROM s GROUP BY 1),
    r AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct, sum(tp) OVER () AS p FROM g
        WINDOW w AS (ORDER BY score DESC))
    SELECT 'reglas' AS metodo, round(sum(tp / p * ct / cn), 6) AS ap FROM r
    UNION ALL SELECT 'constante', round(avg(y), 6) FROM o""", "history"))
def k16_baselines(t: Tables) -> DataFrame:
    from leadloom.functions import signals

    kept, _ = metrics.observed_outcomes(B.history(t))
    total = signals.points(
        "modelo_sku", F.col("manifesto_cuota_inicial") == "SI", "forma_pago_declarada",
        F.col("pidio_cita") == "SI")
    scored = kept.select("y", (total / 90.0).alias("regla"), F.lit(0.0).alias("constante"))
    rules = metrics.average_precision(metrics.score_steps(scored, "y", "regla"))
    constant = metrics.average_precision(metrics.score_steps(scored, "y", "constante"))
    return rules.select(F.lit("reglas").alias("metodo"), "ap").unionByName(
        constant.select(F.lit("constante").alias("metodo"), "ap"))


@query("k19_drift", B.sql("""WITH h AS (SELECT * FROM history WHERE fecha < DATE '1998-06-01'),
    a AS (SELECT * FROM history WHERE fecha >= DATE '1998-06-01'),
    x AS (""" + " UNION ALL ".join(
        f"""SELECT '{c}' AS campo, {c} AS valor, count(*) * 1.0 / (SELECT count({c}) FROM {s}) AS p,
            '{s}' AS s FROM {s} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in ("canal", "modelo_sku") for s in ("h", "a")) + """)
    SELECT campo, valor, round(coalesce(max(p) FILTER (WHERE s = 'h'), 0), 6) AS historico,
        round(coalesce(max(p) FILTER (WHERE s = 'a'), 0), 6) AS actual FROM x GROUP BY 1, 2""",
    "history"))
def k19_drift(t: Tables) -> DataFrame:
    h = B.history(t)
    cut = F.lit("1998-06-01").cast("date")
    return metrics.category_drift(
        h.where(F.col("fecha") < cut), h.where(F.col("fecha") >= cut), ["canal", "modelo_sku"])


@query("k20_curve", B.sql("""SELECT round(score, 6) AS score,
    round((tp_antes + tp) / (n_antes + n), 6) AS precision,
    round((tp_antes + tp) / positivos, 6) AS recall FROM steps""", "scored_labels", steps=_STEPS))
def k20_curve(t: Tables) -> DataFrame:
    return metrics.curve_points(_steps(t)).withColumn("score", F.round("score", 6))
