"""Streaming jobs run to completion over the event table, and model fits over the history."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import signals
from leadloom.operators import metrics, model
from leadloom.plans import bindings as B
from leadloom.plans.registry import Tables, query
from leadloom.session import checkpoint_dir
from leadloom.streaming import timers


def event_stream(t: Tables) -> DataFrame:
    """The event table, a file or a folder of files, as a stream (hence the one-letter glob)."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(
        f"{t.folder}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def activity_stream(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return event_stream(t).join(t.customer, F.col("user_id") == F.col("c_custkey")).select(
        "event_id", B.company("c_nationkey").alias("empresa_id"),
        F.concat(F.lit("L-"), F.col("user_id").cast("string")).alias("lead_consolidado_id"),
        F.when(kind == "view", "sin_respuesta").when(kind == "click", "contactado")
        .otherwise("otro").alias("resultado"), "ts")


def finished(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and read back what it wrote.

    Results and progress go to the shared checkpoint folder, in a place of their own per run. Each
    batch has a folder of its own, so one that is repeated after a failure replaces what it wrote.
    """
    base = f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        part = 0 if mode == "complete" else number
        batch.write.mode("overwrite").parquet(f"{out}/lote={part}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out).select(stream.columns)


@query("st2_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def st2_repeats(t: Tables) -> DataFrame:
    requests = event_stream(t).select(
        F.lit("E").alias("empresa_id"), F.col("user_id").alias("actor"),
        F.col("event_type").alias("operacion"), F.lit("k").alias("clave"), "ts")
    return finished(t, timers.suppress_repeats(requests, delay="90 days")).select(
        F.col("actor").alias("user_id"), F.col("operacion").alias("event_type"))


# a stream that has read everything has settled what is older than its watermark
_PASSED = "epoch_ms(CAST(ts AS TIMESTAMP)) < (SELECT epoch_ms(max(CAST(ts AS TIMESTAMP))) - {ms} FROM events)"
_HOUR_AGO = "(SELECT epoch_ms(max(CAST(ts AS TIMESTAMP))) - 3600000 FROM events)"


@query("st3_quota")
def st3_quota(t: Tables) -> DataFrame:
    attempts = event_stream(t).select(
        F.col("event_type").alias("modelo"), F.col("event_id").alias("intento_id"), "ts")
    return finished(t, timers.rolling_quota(attempts))


@query("st4_deadlines", f"""WITH e AS (SELECT user_id, event_type = 'signup' AS inicio,
        CAST(ts AS TIMESTAMP) AS ts FROM events WHERE {_PASSED.format(ms=3600000)}),
    s AS (SELECT user_id, min(ts) FILTER (WHERE inicio) AS desde, min(ts) FILTER (WHERE NOT inicio)
        AS primero FROM e GROUP BY 1),
    c AS (SELECT s.user_id, desde, primero, min(ts) FILTER (WHERE NOT inicio AND ts >= desde) AS contacto
        FROM s JOIN e USING (user_id) WHERE desde IS NOT NULL GROUP BY ALL)
    SELECT CAST(user_id AS VARCHAR) AS lead_consolidado_id, CASE WHEN primero < desde
        THEN 'no_medible' WHEN contacto <= desde + INTERVAL 24 HOURS THEN 'cumple' ELSE 'vencido' END
        AS estado FROM c WHERE primero < desde OR contacto <= desde + INTERVAL 24 HOURS
        OR epoch_ms(desde + INTERVAL 24 HOURS) < {_HOUR_AGO}""")
def st4_deadlines(t: Tables) -> DataFrame:
    events = event_stream(t).select(
        F.col("user_id").cast("string").alias("lead_consolidado_id"),
        F.when(F.col("event_type") == "signup", "inicio").otherwise("contacto").alias("tipo"), "ts")
    return finished(t, timers.first_contact_deadline(events, keep_days=3650))


@query("st5_latest_revision", f"""SELECT event_id AS resultado_id, CASE WHEN r >= coalesce(max(r) OVER
    (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    THEN 'vigente' ELSE 'obsoleto' END AS estado FROM (SELECT *, (event_id * 7) % 11 AS r
    FROM events WHERE {_PASSED.format(ms=3600000)})""")
def st5_latest_revision(t: Tables) -> DataFrame:
    results = event_stream(t).select(
        F.col("user_id").cast("string").alias("lead_consolidado_id"), "ts",
        F.col("event_id").alias("resultado_id"), ((F.col("event_id") * 7) % 11).alias("revision"))
    return finished(t, timers.latest_revision(results, keep_days=3650)).select("resultado_id", "estado")


@query("st6_leases", f"""WITH e AS (SELECT user_id, event_type = 'click' AS fin, CAST(ts AS TIMESTAMP) AS ts,
        event_id FROM events WHERE {_PASSED.format(ms=60000)}),
    n AS (SELECT *, lead(ts) OVER w AS sigue, lead(fin) OVER w AS sigue_fin,
        count(*) FILTER (WHERE NOT fin) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS intentos
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT user_id, CASE WHEN sigue < ts + INTERVAL 1 HOUR THEN
            CASE WHEN sigue_fin THEN 'completado' END
        WHEN sigue IS NOT NULL OR epoch_ms(ts + INTERVAL 1 HOUR) <
            (SELECT epoch_ms(max(CAST(ts AS TIMESTAMP))) - 60000 FROM events)
        THEN CASE WHEN intentos >= 3 THEN 'fallido' ELSE 'reintento' END END AS estado
        FROM n WHERE NOT fin)
    SELECT CAST(user_id AS VARCHAR) AS trabajo_id, estado FROM r WHERE estado IS NOT NULL""")
def st6_leases(t: Tables) -> DataFrame:
    events = event_stream(t).select(
        F.col("user_id").cast("string").alias("trabajo_id"),
        F.when(F.col("event_type") == "click", "completado").otherwise("reclamo").alias("tipo"),
        "ts", F.lit(3600).alias("lease_segundos"), F.col("event_id").alias("orden"))
    return finished(t, timers.lease_expiry(events, keep_days=3650))


@query("st7_daily_activity", B.sql(f"""SELECT empresa_id, strftime(date_trunc('day', ts - INTERVAL 5
        HOURS), '%Y-%m-%d') AS dia, count(*) FILTER (WHERE resultado = 'sin_respuesta') AS intentos,
    count(*) FILTER (WHERE resultado = 'contactado') AS contactos FROM activities GROUP BY 1, 2
    HAVING epoch_ms(date_trunc('day', max(ts) - INTERVAL 5 HOURS) + INTERVAL 29 HOURS) <= {_HOUR_AGO}""",
    "activities"))
def st7_daily_activity(t: Tables) -> DataFrame:
    out = finished(t, timers.daily_activity(activity_stream(t)))
    return out.select("empresa_id", F.date_format("inicio", "yyyy-MM-dd").alias("dia"), "intentos",
                      "contactos")


@query("st8_sessions", f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS
        THEN 0 ELSE 1 END AS nueva FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT CAST(user_id AS VARCHAR) AS conversacion_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S')
        AS inicio, count(*) AS mensajes FROM s GROUP BY user_id, n
    HAVING epoch_ms(max(CAST(ts AS TIMESTAMP)) + INTERVAL 6 HOURS) <= {_HOUR_AGO}""")
def st8_sessions(t: Tables) -> DataFrame:
    messages = event_stream(t).select(F.col("user_id").cast("string").alias("conversacion_id"), "ts")
    out = finished(t, timers.chat_sessions(messages, gap="6 hours"))
    return out.select(
        "conversacion_id", F.date_format("inicio", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "mensajes")


def training_rows(t: Tables) -> DataFrame:
    kept, _ = metrics.observed_outcomes(B.history(t))
    return metrics.feature_frame(kept, ("lead_id", "y"))


COMMERCIAL = model.PROFILES["comercial"]


@query("k5_coefficients")
def k5_coefficients(t: Tables) -> DataFrame:
    fitted = model.fit(training_rows(t), model.Candidate("comercial", "logistica", 1.0))
    return model.coefficients(fitted, COMMERCIAL, t.spark)


@query("k6_tree_paths")
def k6_tree_paths(t: Tables) -> DataFrame:
    rows = training_rows(t)
    fitted = model.fit(rows, model.Candidate("comercial", "arbol", 3, "balanced"))
    return model.tree_paths(fitted, rows, COMMERCIAL, "lead_id")


def _training_models(rows: DataFrame) -> DataFrame:
    """The rows from before the last models of the catalogue came."""
    number = F.substring_index("modelo_sku", "-", -1).try_cast("int")
    return rows.where((F.coalesce(number, F.lit(0)) < 16) & (F.col("forma_pago_declarada") != "contado"))


@query("k4_active", B.sql("""SELECT lead_id, 1 + CAST(modelo_sku IS NULL OR CAST(split_part(modelo_sku, '-', 2) AS INT)
        < 16 AS INT) + 1 + CAST(forma_pago_declarada <> 'contado' AS INT) + 1 AS activas
    FROM history WHERE desenlace IN ('Cerrado', 'Perdido')""", "history"))
def k4_active(t: Tables) -> DataFrame:
    rows = training_rows(t)
    cells = _training_models(rows).groupBy(*COMMERCIAL).agg(F.count(F.lit(1)).alias("n"))
    encoding = Pipeline(stages=model.encoder(COMMERCIAL)).fit(cells)
    ones = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return encoding.transform(rows).select("lead_id", ones.cast("int").alias("activas"))


GRID_ROUNDS = [("abril", None, "1998-04-01", "1998-05-01"), ("mayo", None, "1998-05-01", "1998-06-01"),
               ("junio", None, "1998-06-01", "1998-07-01")]
_FIXED = [("reglas", "sin_pesos"), ("cita", "sin_pesos"), ("cuota", "balanced"), ("constante", "balanced")]


@query("k8_choice", B.sql("""SELECT regimen, candidato, ap_media, ap_minima, precision_media FROM (
        SELECT candidato, regimen, orden, round(avg(ap), 6) AS ap_media, min(ap) AS ap_minima,
            round(avg(precision_top), 6) AS precision_media FROM stored GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY regimen ORDER BY ap_media DESC NULLS LAST, orden) = 1""", "history",
    seen="""SELECT fecha, CAST(desenlace = 'Cerrado' AS BIGINT) AS y, ((modelo_sku IS NOT NULL)::INT * 10
            + coalesce(manifesto_cuota_inicial = 'SI', false)::INT * 30 + (forma_pago_declarada IN ('credito',
            'contado'))::INT * 10 + (pidio_cita = 'SI')::INT * 40) / 90.0::DOUBLE AS reglas,
            (pidio_cita = 'SI')::INT::DOUBLE AS cita, 0.0::DOUBLE AS constante,
            coalesce(manifesto_cuota_inicial = 'SI', false)::INT::DOUBLE AS cuota
        FROM history WHERE desenlace IN ('Cerrado', 'Perdido')""",
    checked=" UNION ALL ".join(f"""SELECT '{n}' AS ronda, * FROM seen WHERE fecha >= DATE '{c}' AND fecha < DATE '{e}'"""
                               for n, _, c, e in GRID_ROUNDS),
    scored=" UNION ALL ".join(f"""SELECT '{c}' AS candidato, '{w}' AS regimen, {i} AS orden, ronda, y, {c} AS score
        FROM checked""" for i, (c, w) in enumerate(_FIXED)),
    steps="""SELECT *, sum(n) OVER w - n AS n_antes, sum(tp) OVER w - tp AS tp_antes, sum(n) OVER p AS total,
            sum(tp) OVER p AS positivos FROM (SELECT candidato, regimen, orden, ronda, score, count(*) AS n,
            sum(y) AS tp FROM scored GROUP BY ALL)
        WINDOW w AS (PARTITION BY orden, ronda ORDER BY score DESC), p AS (PARTITION BY orden, ronda)""",
    stored="""SELECT candidato, regimen, orden, ronda,
            round(sum(tp / nullif(positivos, 0) * (tp_antes + tp) / (n_antes + n)), 6) AS ap,
            round(sum(tp * greatest(0, least(n, k - n_antes)) / n) / max(k), 6) AS precision_top
        FROM (SELECT *, greatest(1, ceil(total * 0.2::DOUBLE)) AS k FROM steps) GROUP BY 1, 2, 3, 4"""))
def k8_choice(t: Tables) -> DataFrame:
    """The choice among fixed scores: the same cells, metrics and ranking as for fitted candidates."""
    kept, _ = metrics.observed_outcomes(B.history(t))
    initial, visit = (F.coalesce(F.col(c) == "SI", F.lit(False)) for c in ("manifesto_cuota_inicial", "pidio_cita"))
    score = {
        "reglas": signals.points("modelo_sku", initial, "forma_pago_declarada", visit) / 90.0,
        "cita": visit.cast("double"), "cuota": initial.cast("double"), "constante": F.lit(0.0)}
    runs = F.array(*[
        F.struct(F.lit(c).alias("candidato"), F.lit(w).alias("regimen"), F.lit(i).alias("orden"), score[c].alias("score"))
        for i, (c, w) in enumerate(_FIXED)])
    checked = metrics.month_rounds(kept, "fecha", GRID_ROUNDS).where("uso = 'validacion'")
    scored = checked.select("ronda", "y", F.lit(1).alias("n"), F.inline(runs))
    return model.choose(model.grid_metrics(scored))


@query("k8_grid")
def k8_grid(t: Tables) -> DataFrame:
    """Metrics of the twenty candidates over all rounds; every fit learns, on counted cells, from all rows before it."""
    kept, _ = metrics.observed_outcomes(B.history(t))
    rows = metrics.feature_frame(kept, ("fecha", "y"))
    per_round, _ = model.select_candidates(metrics.month_rounds(rows, "fecha", GRID_ROUNDS), model.grid())
    return per_round


_REPS = 200
_WEIGHED = """SELECT rep, {c} AS s, sum(w) AS n, sum(w * y) AS tp,
    coalesce(sum(sum(w)) OVER before, 0) AS n_antes, coalesce(sum(sum(w * y)) OVER before, 0) AS tp_antes,
    sum(sum(w)) OVER (PARTITION BY rep) AS total, sum(sum(w * y)) OVER (PARTITION BY rep) AS positivos
    FROM drawn GROUP BY rep, {c}
    WINDOW before AS (PARTITION BY rep ORDER BY {c} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_BOTH = """SELECT rep, round(sum(tp / nullif(positivos, 0) * (tp_antes + tp) / (n_antes + n)), 6) AS ap,
    round(sum(tp * greatest(0, least(n, greatest(1, ceil(total * 0.2)) - n_antes)) / n)
        / max(greatest(1, ceil(total * 0.2))), 6) AS top FROM {s} GROUP BY rep"""


@query("k14_bootstrap", B.sql(
    """SELECT medida, round(q[1], 6) AS limite_inferior_95, round(q[2], 6) AS mediana,
        round(q[3], 6) AS limite_superior_95
    FROM (SELECT medida, quantile_cont(d, [0.025, 0.5, 0.975]) AS q FROM (
        SELECT 'AP' AS medida, a.ap - b.ap AS d FROM of_a a JOIN of_b b ON a.rep = b.rep
        UNION ALL SELECT 'precision_top20', a.top - b.top FROM of_a a JOIN of_b b ON a.rep = b.rep)
        WHERE d IS NOT NULL GROUP BY medida)""", "scored_labels",
    cells="""SELECT y, score AS a, (doc_id % 10) / 10.0 AS b, count(*) AS n FROM scored_labels GROUP BY 1, 2, 3""",
    law=f"""SELECT n, list(c ORDER BY k) AS cdf FROM (SELECT n, k,
            sum(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS c
        FROM (SELECT DISTINCT n FROM cells) JOIN range({model.LONGEST_DRAW}) t(k) ON true) GROUP BY n""",
    hashed=f"""SELECT y, a, b, n, rep, md5(concat_ws('|', 42, CAST(round(a * 1e9) AS BIGINT),
            CAST(round(b * 1e9) AS BIGINT), CAST(y AS BIGINT), rep)) AS h
        FROM cells JOIN range(1, {_REPS + 1}) t(rep) ON true""",
    numbers="""SELECT *, CAST('0x' || substr(h, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u,
        CAST('0x' || substr(h, 14, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS v FROM hashed""",
    drawn=f"""SELECT * FROM (SELECT y, a, b, rep, CASE WHEN m.n <= {model.EXACT_DRAWS}
            THEN len(list_filter(cdf, lambda c: c <= u))
            ELSE greatest(0, floor(m.n + z * sqrt(m.n) + (z * z - 1) / 6 + 0.5)) END AS w
        FROM (SELECT *, sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) AS z FROM numbers) m JOIN law ON law.n = m.n)
        WHERE w > 0""",
    steps_a=_WEIGHED.format(c="a"), steps_b=_WEIGHED.format(c="b"),
    of_a=_BOTH.format(s="steps_a"), of_b=_BOTH.format(s="steps_b")))
def k14_bootstrap(t: Tables) -> DataFrame:
    scored = B.scored_labels(t).withColumn("b", (F.col("doc_id") % 10) / F.lit(10.0))
    return model.bootstrap_interval(scored, "y", "score", "b", repetitions=_REPS)


@query("k17_contributions")
def k17_contributions(t: Tables) -> DataFrame:
    rows = training_rows(t)
    fitted = model.fit(rows, model.Candidate("comercial", "logistica", 0.1))
    table = model.coefficients(fitted, COMMERCIAL, t.spark)
    return model.logit_contributions(rows, table, COMMERCIAL, "lead_id")


@query("k21_experimental_score")
def k21_experimental_score(t: Tables) -> DataFrame:
    rows = training_rows(t)
    fitted = model.fit(rows, model.Candidate("ingreso", "logistica", 1.0))
    return model.experimental_score(fitted, rows).select("lead_id", "score_modelo_experimental")
