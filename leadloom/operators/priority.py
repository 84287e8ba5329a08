"""Context per lead, scoring, the ranked queue and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions import signals
from leadloom.operators.ranking import Key, attach_single, provable_latest, with_positions

LEAD = ["empresa_id", "lead_consolidado_id"]
QUEUE_ORDER = [
    Key("score", desc=True, nulls_last=True),
    Key("fecha", nulls_last=True),
    Key("hora"),
    Key("lead_consolidado_id"),
]


def queue_positions(priorities: DataFrame, out: str = "posicion") -> DataFrame:
    """Position per company and queue: score, earliest date (unknown last), hour (unknown first),
    id. Buckets by score and month, then by day, hour and the start of the id."""
    month = F.trunc("fecha", "month")
    coarse = [QUEUE_ORDER[0], Key(month, nulls_last=True)]
    fine = [QUEUE_ORDER[1], QUEUE_ORDER[2], Key(F.substring("lead_consolidado_id", 1, 6))]
    return with_positions(priorities, ["empresa_id", "cola"], QUEUE_ORDER, coarse, fine, out)


def queue_violations(ranked: DataFrame) -> DataFrame:
    """Queues whose positions have gaps or whose score rises with the position."""
    # the next position is looked up by equality, so no queue is sorted in one task
    ahead = ranked.select("empresa_id", "cola", (F.col("posicion") - 1).alias("posicion"),
                          F.col("score").alias("_next"))
    rising = ranked.join(ahead, ["empresa_id", "cola", "posicion"]).where("_next > score").select(
        "empresa_id", "cola", F.lit("score_creciente").alias("regla")).distinct()
    gaps = ranked.groupBy("empresa_id", "cola").agg(
        F.count(F.lit(1)).alias("_n"), F.max("posicion").alias("_m"), F.min("posicion").alias("_1"),
        F.sum(F.col("posicion").cast("decimal(38,0)")).alias("_s"),
    ).where((F.col("_n") != F.col("_m")) | (F.col("_1") != 1)
            | (F.col("_s") != F.col("_n") * (F.col("_n") + 1) / 2)).select(
        "empresa_id", "cola", F.lit("posiciones_no_contiguas").alias("regla"))
    return rising.unionByName(gaps)


def fifo_rank(df: DataFrame, date: str, row: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Descending FIFO score: the oldest row gets the largest value. ``row`` is a text id."""
    ranked = with_positions(
        df, list(group), [Key(date), Key(row)], [Key(F.trunc(date, "month"))],
        [Key(date), Key(F.substring(row, 1, 6))], out="_p")
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(counts, list(group)) if group else attach_single(ranked, counts)
    return joined.withColumn("fifo", F.col("_n") - F.col("_p") + 1).drop("_n", "_p")


def context_rows(leads: DataFrame, inquiries: DataFrame, chats: DataFrame) -> DataFrame:
    """One context row per lead from its provably latest evidence.

    ``inquiries``: lead columns, ``lead_id, canal, modelo_sku, fecha, con_hora, estado_gestion``.
    ``chats`` (usable only): lead columns, ``lead_id, conversacion_id, fecha, con_hora, menciones,
    skus, sku, inicial, forma_pago, cita``. The latest chat wins; without one the latest inquiry;
    without a provable order only values all inquiries share.
    """
    last_chat = provable_latest(chats, LEAD, "fecha", "con_hora", "conversacion_id").select(
        *LEAD, "conversacion_id", F.col("motivo").alias("motivo_conversaciones"))
    last_inquiry = provable_latest(inquiries, LEAD, "fecha", "con_hora", "lead_id").select(
        *LEAD, F.col("lead_id").alias("_last"), F.col("motivo").alias("motivo_consultas"))
    unknown = F.lit("DESCONOCIDO")

    def common(c: str):
        v = F.coalesce(c, unknown)
        return F.when(F.min(v) == F.max(v), F.max(v)).otherwise(unknown)

    shared = inquiries.groupBy(*LEAD).agg(
        common("canal").alias("_canal"), common("modelo_sku").alias("_sku"),
        F.bool_and(F.coalesce(F.col("estado_gestion") == "Descartado", F.lit(False)))
        .alias("todas_consultas_descartadas"))
    chat_counts = chats.groupBy(*LEAD).agg(
        F.count(F.lit(1)).alias("numero_conversaciones_utilizables"))
    # looked up by lead, so that every join here has the same partitioning
    chosen = chats.select(
        *LEAD, F.col("conversacion_id").alias("_c"), F.col("lead_id").alias("_chat_lead"),
        "menciones", "skus", F.col("sku").alias("_chat_sku"), "inicial",
        F.col("forma_pago").alias("_pago"), "cita",
    ).join(last_chat.select(*LEAD, "conversacion_id"), LEAD).where(
        F.col("_c") == F.col("conversacion_id")).drop("_c", "conversacion_id")
    picked = inquiries.select(
        *LEAD, F.col("lead_id").alias("lead_id_contexto"), F.col("canal").alias("_q_canal"),
        F.col("modelo_sku").alias("_q_sku"))
    base = (
        leads.join(last_chat, LEAD, "left")
        .join(chosen, LEAD, "left")
        .join(last_inquiry, LEAD, "left")
        .join(shared, LEAD, "left")
        .join(chat_counts, LEAD, "left")
        .withColumn("lead_id_contexto", F.coalesce("_chat_lead", "_last"))
        .join(picked, [*LEAD, "lead_id_contexto"], "left")
    )
    has_chat = F.col("conversacion_id").isNotNull()
    known = F.col("lead_id_contexto").isNotNull()
    sku = F.when(known, F.coalesce("_q_sku", unknown)).otherwise(F.coalesce("_sku", unknown))
    single = (F.col("skus") == 1) & F.col("_chat_sku").isNotNull()
    return base.select(
        *[c for c in leads.columns],
        "lead_id_contexto",
        F.col("conversacion_id").alias("conversacion_id_contexto"),
        F.coalesce("numero_conversaciones_utilizables", F.lit(0)).alias(
            "numero_conversaciones_utilizables"),
        F.when(known, F.coalesce("_q_canal", unknown)).otherwise(F.coalesce("_canal", unknown))
        .alias("canal"),
        F.when(has_chat & (F.col("menciones") > 0),
               F.when(single, F.col("_chat_sku")).otherwise("AMBIGUO"))
        .otherwise(sku).alias("modelo_sku"),
        F.coalesce("inicial", F.lit("NO_INFORMA")).alias("manifesto_cuota_inicial"),
        F.when(F.col("_pago").isin(V.PAYMENT_SIGNALS), F.col("_pago")).otherwise("no_informa")
        .alias("forma_pago_declarada"),
        F.when(F.col("cita"), "SI").otherwise("NO_OBSERVADA").alias("cita_observada"),
        "todas_consultas_descartadas",
        F.when(has_chat, "conversacion_utilizable")
        .when(F.col("motivo_conversaciones").isNotNull(), "revision_orden")
        .otherwise("sin_conversacion_utilizable").alias("estado_contexto"),
        "motivo_conversaciones", "motivo_consultas")


def prioritise(context: DataFrame) -> DataFrame:
    """Score, temperature, queue, explanation and suggested action of context rows."""
    initial = F.col("manifesto_cuota_inicial") == "SI"
    appointment = F.col("cita_observada") == "SI"
    args = ("modelo_sku", initial, "forma_pago_declarada", appointment)
    out = context.withColumns({
        "puntos": signals.points(*args).cast("bigint"),
        "temperatura": signals.temperature(*args[1:]),
        "explicacion_prioridad": signals.explanation(*args),
        "metodo_prioridad": F.lit(V.RULES_VERSION),
    })
    out = out.withColumns({
        "score": signals.score(F.col("puntos")),
        "cola": signals.queue("temperatura", "todas_consultas_descartadas", "estado_contexto"),
    })
    return out.withColumn("accion_sugerida", signals.action("cola", "temperatura"))


def order_incidents(context: DataFrame) -> DataFrame:
    """Incidents for leads whose chat or inquiry order cannot be proven."""
    chat = context.where(F.col("motivo_conversaciones").isNotNull()).select(
        F.lit("orden_conversaciones_ambiguo").alias("tipo"), *LEAD,
        F.col("motivo_conversaciones").alias("motivo"),
        F.lit("No usar señales conversacionales; conservar fuentes.").alias("accion"))
    inquiry = context.where(
        F.col("motivo_consultas").isNotNull() & F.col("conversacion_id_contexto").isNull()
    ).select(
        F.lit("orden_consultas_ambiguo").alias("tipo"), *LEAD,
        F.col("motivo_consultas").alias("motivo"),
        F.lit("Solo conservar canal/modelo comunes; no inventar orden.").alias("accion"))
    return chat.unionByName(inquiry)


def context_documents(context: DataFrame, chats: DataFrame, page: int = 1000) -> DataFrame:
    """Per lead the usable chats in pages, beside the chosen one."""
    from leadloom.operators.identity import listed_values

    pages = listed_values(chats, LEAD, ["conversacion_id"], page).select(
        *LEAD, "pagina", F.col("valores").alias("conversaciones_utilizables"))
    return context.select(*LEAD, "conversacion_id_contexto", F.lit(
        "Foto más reciente verificable; no acumular declaraciones de otras fechas."
    ).alias("criterio")).join(pages, LEAD, "left")


def latest_by_window(df: DataFrame, keys: list[str], order: list[Key]) -> DataFrame:
    """First row per key in ``order``; Spark keeps one row per key and task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[k.sort() for k in order]))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")
