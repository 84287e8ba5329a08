"""Window, sort and paging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import identity, priority, ranking
from leadloom.operators.ranking import Key
from leadloom.plans import bindings as B
from leadloom.plans.q_values import prepared_inquiries
from leadloom.plans.q_aggregates import _GROUPS
from leadloom.plans.registry import Tables, query


@query("e1_queue_position", B.sql("""SELECT empresa_id, cola, lead_consolidado_id,
    CAST(score AS DOUBLE) AS score, temperatura, row_number() OVER (PARTITION BY empresa_id, cola
        ORDER BY score DESC, fecha ASC NULLS LAST, hora ASC NULLS FIRST, lead_consolidado_id)
        AS posicion FROM priorities""", "priorities"))
def e1_queue_position(t: Tables) -> DataFrame:
    return priority.queue_positions(B.priorities(t)).select(
        "empresa_id", "cola", "lead_consolidado_id", F.col("score").cast("double").alias("score"),
        "temperatura", "posicion")


@query("e2_codes", B.sql("""WITH g AS (SELECT empresa_id, telefono FROM prep
        WHERE telefono IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
    n AS (SELECT *, row_number() OVER (ORDER BY empresa_id, telefono) AS p FROM g)
    SELECT empresa_id, telefono, 'DUP-' || CASE WHEN p < 1000
        THEN lpad(CAST(p AS VARCHAR), 3, '0') ELSE CAST(p AS VARCHAR) END AS grupo FROM n""",
    "inquiries", **_GROUPS))
def e2_codes(t: Tables) -> DataFrame:
    return identity.candidate_groups(prepared_inquiries(t))


@query("e3_dupes", """WITH r AS (SELECT o_orderkey AS fila, o_orderstatus, o_orderpriority,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 20 END AS c FROM orders),
    k AS (SELECT *, min(fila) OVER (PARTITION BY o_orderstatus, o_orderpriority, c) AS m FROM r)
    SELECT fila, m AS fila_conservada, CASE WHEN fila = m THEN 'conservar'
        ELSE 'repeticion_exacta' END AS accion FROM k""")
def e3_dupes(t: Tables) -> DataFrame:
    r = t.orders.select(
        F.col("o_orderkey").alias("fila"), "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 20).alias("c"))
    return identity.exact_duplicates(
        r, ["o_orderstatus", "o_orderpriority", "c"], "fila"
    ).select("fila", "fila_conservada", "accion")


@query("e4_latest", """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 400 <> 3
        THEN date_trunc('hour', ts) END AS f, event_id % 6 <> 0 AS h FROM events),
    d AS (SELECT *, max(CAST(f AS DATE)) OVER (PARTITION BY user_id) AS md,
        max(f) OVER (PARTITION BY user_id) AS mf,
        bool_or(f IS NULL) OVER (PARTITION BY user_id) AS mal FROM e),
    s AS (SELECT user_id, bool_or(mal) AS mal,
        count(*) FILTER (WHERE CAST(f AS DATE) = md) AS n,
        bool_or(NOT h) FILTER (WHERE CAST(f AS DATE) = md) AS sin,
        count(*) FILTER (WHERE f = mf) AS nf, min(event_id) FILTER (WHERE f = mf) AS id
        FROM d GROUP BY 1),
    m AS (SELECT user_id, id, CASE WHEN mal THEN 'fecha_invalida' WHEN n = 1 THEN NULL
        WHEN sin THEN 'orden_intradia_desconocido' WHEN nf > 1 THEN 'empate_fecha' END AS motivo
        FROM s)
    SELECT user_id, CASE WHEN motivo IS NULL THEN id END AS event_id, motivo FROM m""")
def e4_latest(t: Tables) -> DataFrame:
    e = t.events.select(
        "user_id", "event_id",
        F.when(F.col("event_id") % 400 != 3, F.date_trunc("hour", "ts")).alias("fecha"),
        (F.col("event_id") % 6 != 0).alias("con_hora"))
    return ranking.provable_latest(e, ["user_id"], "fecha", "con_hora", "event_id")


@query("e5_current", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number()
    OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    WHERE rn = 1""")
def e5_current(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ranking.latest_per_key(
        o, ["o_custkey"], [Key("o_orderdate", desc=True), Key("o_orderkey", desc=True)]
    ).select("o_custkey", "o_orderkey", "o_totalprice")


@query("e6_latest_run", """SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey
    FROM lineitem WHERE l_orderkey =
    (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'
        AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
     ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
def e6_latest_run(t: Tables) -> DataFrame:
    loaded = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    last = t.orders.where("o_orderstatus = 'F'").join(loaded, "o_orderkey", "left_semi").agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("l_orderkey"))
    # one row by construction
    return t.lineitem.join(F.broadcast(last), "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")


@query("e7_rolling", """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts
        RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW) AS dia,
    count(*) OVER (PARTITION BY event_type ORDER BY ts
        RANGE BETWEEN INTERVAL '00:00:59.999999' PRECEDING AND CURRENT ROW) AS minuto
    FROM events""")
def e7_rolling(t: Tables) -> DataFrame:
    return ranking.trailing_counts(
        t.events, ["event_type"], "ts", "event_id", {"dia": 86400, "minuto": 60})


@query("e8_positions", B.sql("SELECT conversacion_id, posicion, emisor FROM messages", "messages"))
def e8_positions(t: Tables) -> DataFrame:
    return B.messages(t).select("conversacion_id", "posicion", "emisor")


@query("e9_batches", """WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 6 <> 0
        THEN conv_id % 4 END AS empresa FROM conversations)
    SELECT conv_id, empresa, CASE WHEN empresa IS NOT NULL THEN CAST((row_number() OVER
        (PARTITION BY empresa ORDER BY conv_id) - 1) // 5 AS BIGINT) END AS lote FROM c""")
def e9_batches(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id").distinct().withColumn(
        "empresa", F.when(F.col("conv_id") % 6 != 0, F.col("conv_id") % 4))
    return ranking.batches_of(
        c, "empresa", [Key("conv_id")], [Key(F.floor(F.col("conv_id") / 1024))])


@query("e10_append", """WITH top AS (SELECT o_custkey, max(o_orderkey % 10) AS m FROM orders
        WHERE o_orderkey % 2 = 0 GROUP BY 1)
    SELECT o_orderkey, coalesce(m, 0) + row_number() OVER (PARTITION BY o.o_custkey
        ORDER BY o_orderkey) AS posicion FROM orders o LEFT JOIN top USING (o_custkey)
    WHERE o_orderkey % 2 = 1""")
def e10_append(t: Tables) -> DataFrame:
    now = t.orders.where("o_orderkey % 2 = 0").withColumn("posicion", F.col("o_orderkey") % 10)
    new = t.orders.where("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey")
    return ranking.append_positions(
        new, now, ["o_custkey"], [Key("o_orderkey")],
        [Key(F.floor(F.col("o_orderkey") / 4096))], "posicion"
    ).select("o_orderkey", "posicion")


@query("e11_fifo", B.sql("""SELECT lead_id, (SELECT count(*) FROM history) - row_number() OVER
    (ORDER BY fecha, lead_id) + 1 AS fifo FROM history""", "history"))
def e11_fifo(t: Tables) -> DataFrame:
    h = B.history(t).select("lead_id", "fecha")
    return priority.fifo_rank(h, "fecha", "lead_id").select("lead_id", "fifo")


_ATTENTION = """SELECT p.*, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2024-01-01 00:00:00'
        + to_hours(CAST(o_orderkey % 100 AS INTEGER)) END AS due FROM priorities p"""


@query("e12_overdue_first", B.sql("""SELECT lead_consolidado_id, row_number() OVER (
    PARTITION BY empresa_id ORDER BY CASE WHEN due <= TIMESTAMP '2024-01-03 00:00:00' THEN due END
        ASC NULLS LAST, score DESC, fecha ASC NULLS LAST, lead_consolidado_id) AS orden FROM att""",
    "priorities", att=_ATTENTION))
def e12_overdue_first(t: Tables) -> DataFrame:
    from leadloom.operators.assignment import attention_levels, attention_order

    now = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    due = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, "
                 "cast(o_orderkey % 100 as int))")
    att = B.priorities(t).withColumn(
        "proxima_accion_en", F.when(F.col("o_orderkey") % 5 == 0, due))
    order = attention_order(now)
    return ranking.with_positions(
        att, ["empresa_id"], order, *attention_levels(order), out="orden"
    ).select("lead_consolidado_id", "orden")


@query("e13_queue_check", B.sql("""WITH r AS (SELECT empresa_id, cola, score,
        row_number() OVER (PARTITION BY empresa_id, cola ORDER BY lead_consolidado_id)
            + CASE WHEN empresa_id = 'EMP-04' THEN 1 ELSE 0 END AS p FROM priorities),
    l AS (SELECT *, lag(score) OVER (PARTITION BY empresa_id, cola ORDER BY p) AS ant FROM r)
    SELECT DISTINCT empresa_id, cola, 'score_creciente' AS regla FROM l WHERE score > ant
    UNION ALL SELECT empresa_id, cola, 'posiciones_no_contiguas' FROM r GROUP BY 1, 2
    HAVING min(p) <> 1 OR max(p) <> count(*)""", "priorities"))
def e13_queue_check(t: Tables) -> DataFrame:
    # numbered by id on purpose, so both kinds of violation occur
    wrong = ranking.with_positions(
        B.priorities(t), ["empresa_id", "cola"], [Key("lead_consolidado_id")],
        [Key(F.substring("lead_consolidado_id", 1, 6))]
    ).withColumn("posicion", F.col("posicion") + F.when(
        F.col("empresa_id") == "EMP-04", 1).otherwise(0))
    return priority.queue_violations(wrong)


@query("e14_first_candidate", """SELECT l_returnflag AS regimen, l_suppkey AS candidato FROM (
    SELECT l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_returnflag
        ORDER BY count(*) DESC, l_suppkey) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def e14_first_candidate(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy(
        F.col("l_returnflag").alias("regimen"), F.col("l_suppkey").alias("candidato")
    ).agg(F.count(F.lit(1)).alias("_n"))
    return priority.latest_by_window(
        c, ["regimen"], [Key("_n", desc=True), Key("candidato")]).select("regimen", "candidato")


@query("e15_bounded_list", """SELECT event_id FROM events WHERE event_type = 'error'
    ORDER BY event_id LIMIT 20""")
def e15_bounded_list(t: Tables) -> DataFrame:
    return ranking.page(
        t.events.where("event_type = 'error'").select("event_id"), [Key("event_id")], 20, 0)


@query("f1_sort", """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST, o_orderkey
    """)
def f1_sort(t: Tables) -> DataFrame:
    keys = [Key("o_orderpriority"), Key("o_totalprice", desc=True, nulls_last=True),
            Key("o_orderkey")]
    return t.orders.select(
        "o_orderkey", "o_orderpriority", "o_totalprice").orderBy(*[k.sort() for k in keys])


@query("f2_page", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders
        WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def f2_page(t: Tables) -> DataFrame:
    scope = t.orders.where("o_orderstatus = 'F'")
    total = scope.agg(F.count(F.lit(1)).alias("total"))
    rows = ranking.page(
        scope.select("o_orderkey", "o_totalprice"),
        [Key("o_totalprice", desc=True), Key("o_orderkey")], 25, 50)
    return ranking.attach_single(rows, total)


@query("f3_top_n", """SELECT user_id, event_id, orden FROM (SELECT user_id, event_id, row_number()
    OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS orden FROM events)
    WHERE orden <= 3""")
def f3_top_n(t: Tables) -> DataFrame:
    return ranking.top_n_per_group(
        t.events, ["user_id"], [Key("ts", desc=True), Key("event_id", desc=True)], 3
    ).select("user_id", "event_id", F.col("orden").cast("bigint").alias("orden"))
