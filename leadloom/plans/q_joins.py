"""Join queries: lookups, semi/anti, reconciliation, availability, lateral aggregates."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators import catalog, checks, identity, keyed_table, scope
from leadloom.operators.merge import upsert
from leadloom.plans import bindings as B
from leadloom.plans.registry import Tables, query
from leadloom.session import checkpoint_dir


@query("c1_many_to_one", B.sql("""SELECT i.fila, i.lead_consolidado_id, l.segmento,
    l.lead_consolidado_id IS NOT NULL AS encontrado FROM inquiries i LEFT JOIN
    (SELECT * FROM leads WHERE c_custkey % 10 <> 0) l USING (lead_consolidado_id)""",
    "inquiries", "leads"))
def c1_many_to_one(t: Tables) -> DataFrame:
    ref = B.leads(t).where("c_custkey % 10 <> 0").select("lead_consolidado_id", "segmento")
    out = checks.lookup(
        B.inquiries(t).select("fila", "lead_consolidado_id"), ref, ["lead_consolidado_id"],
        indicator="encontrado")
    return out.select("fila", "lead_consolidado_id", "segmento", "encontrado")


@query("c2_paired", """WITH m AS (SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 6) AS q,
        count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT a.l_suppkey AS candidato, a.q AS q_a, b.q AS q_n, round(a.q - b.q, 6) AS delta
    FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A'
        AND b.l_returnflag = 'N'""")
def c2_paired(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("candidato"), "l_returnflag").agg(
        F.round(F.avg("l_quantity"), 6).alias("q"))
    a = m.where("l_returnflag = 'A'").select("candidato", F.col("q").alias("q_a"))
    b = m.where("l_returnflag = 'N'").select("candidato", F.col("q").alias("q_n"))
    return checks.lookup(a, b, ["candidato"], how="inner").withColumn(
        "delta", F.round(F.col("q_a") - F.col("q_n"), 6))


_LINE_CTE = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'PV-' || l_suppkey
    AS punto_venta_id,
    'EMP-' || lpad(CAST(CASE WHEN l_linenumber % 2 = 1 THEN s_nationkey
        ELSE l_orderkey % 25 END AS VARCHAR), 2, '0') AS empresa_id,
    CASE WHEN l_orderkey % 8 = 0 THEN NULL WHEN l_orderkey % 8 = 1 THEN 'SKU-X'
        WHEN l_orderkey % 8 = 2 THEN 'SKU-0' ELSE 'SKU-' || l_partkey END AS modelo_sku
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


def wanted_lines(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") % 8
    joined = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    nation = F.when(F.col("l_linenumber") % 2 == 1, F.col("s_nationkey").cast("bigint")).otherwise(
        F.col("l_orderkey") % 25)
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("PV-"), F.col("l_suppkey").cast("string")).alias("punto_venta_id"),
        B.company(nation).alias("empresa_id"),
        F.when(k == 0, None).when(k == 1, "SKU-X").when(k == 2, "SKU-0")
        .otherwise(F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string"))).alias("modelo_sku"))


_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("c3_anti_pair", B.sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, empresa_id
    FROM lines l WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.empresa_id = l.empresa_id
        AND s.punto_venta_id = l.punto_venta_id)""", "sites", lines=_LINE_CTE))
def c3_anti_pair(t: Tables) -> DataFrame:
    pairs = B.sites(t).select("empresa_id", "punto_venta_id").distinct()
    return wanted_lines(t).join(pairs, ["empresa_id", "punto_venta_id"], "left_anti").select(
        *_LINE_KEYS, "empresa_id")


@query("c4_availability", B.sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN modelo_sku IS NULL THEN 'no_evaluable_modelo_pendiente'
        WHEN modelo_sku NOT IN (SELECT sku FROM catalogue) THEN 'no_evaluable_sku_desconocido'
        WHEN (empresa_id, punto_venta_id) NOT IN (SELECT (empresa_id, punto_venta_id) FROM sites)
            THEN 'no_evaluable_empresa_punto'
        WHEN (modelo_sku, punto_venta_id) IN (SELECT (sku, punto_venta_id) FROM availability)
            THEN 'listado_en_punto' ELSE 'no_listado_en_punto' END AS disponibilidad
    FROM lines""", "sites", "catalogue", "availability", lines=_LINE_CTE))
def c4_availability(t: Tables) -> DataFrame:
    return catalog.availability_state(
        wanted_lines(t), B.catalogue(t), B.sites(t), B.availability(t)
    ).select(*_LINE_KEYS, "disponibilidad")


@query("c5_all_pairs", B.sql(f"""WITH nk AS (SELECT empresa_id, c_custkey // 2 AS grupo,
        {B.mixed_name_sql('(c_custkey // 2 * 11 + fila % 3 * 7)')} AS k FROM inquiries),
    g AS (SELECT empresa_id, grupo, k, count(*) AS n FROM nk GROUP BY ALL),
    -- every pair of different names, and a repeated name with itself
    p AS (SELECT a.empresa_id, a.grupo, bool_and({B.names_agree_sql('a.k', 'b.k')}) AS todos
        FROM g a JOIN g b ON a.empresa_id = b.empresa_id AND a.grupo = b.grupo
            AND (a.k < b.k OR (a.k = b.k AND a.n > 1)) GROUP BY 1, 2),
    f AS (SELECT empresa_id, grupo, CAST(sum(n) AS BIGINT) AS filas FROM g GROUP BY 1, 2)
    SELECT empresa_id, grupo, filas, coalesce(todos, true) AS compatibles FROM f
        LEFT JOIN p USING (empresa_id, grupo) WHERE filas > 1""", "inquiries"))
def c5_all_pairs(t: Tables) -> DataFrame:
    pair = F.floor(F.col("c_custkey") / 2)
    base = B.inquiries(t).withColumn("grupo", pair).withColumn(
        "nombre_cliente", B.mixed_name(pair * 11 + F.col("fila") % 3 * 7))
    return identity.compatible_groups(base, ["empresa_id", "grupo"], "nombre_cliente")


@query("c6_names_in_text", B.sql("""WITH n AS (SELECT sku, lower(marca || ' ' || linea) AS nombre
        FROM catalogue),
    m AS (SELECT doc_id, lower(strip_accents(texto)) AS texto FROM docs)
    SELECT DISTINCT doc_id, sku FROM m JOIN n ON contains(texto, nombre)""", "catalogue",
    docs="""SELECT doc_id, text || coalesce(' quiero la ' || p_brand || ' ' || p_name || ' ' || p_size, '')
        AS texto FROM documents LEFT JOIN part ON p_partkey = doc_id"""))
def c6_names_in_text(t: Tables) -> DataFrame:
    wish = F.concat_ws(" ", "text", F.lit("quiero la"), "p_brand", "p_name",
                       F.col("p_size").cast("string"))
    docs = t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id"), "left").select(
        "doc_id", F.when(F.col("p_brand").isNotNull(), wish).otherwise(F.col("text")).alias("texto"))
    return catalog.names_in_text(docs, "doc_id", "texto", B.catalogue(t))


_LINKS = """SELECT o_orderkey AS fila, 'L-' || o_custkey AS lead_consolidado_id,
    'EMP-' || lpad(CAST(CASE WHEN o_orderkey % 9 = 0 THEN 99 ELSE c_nationkey END AS VARCHAR), 2,
        '0') AS empresa_id FROM orders JOIN customer ON o_custkey = c_custkey"""


def _links(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("fila"),
        F.concat(F.lit("L-"), F.col("o_custkey").cast("string")).alias("lead_consolidado_id"),
        B.company(F.when(F.col("o_orderkey") % 9 == 0, 99).otherwise(F.col("c_nationkey")))
        .alias("empresa_id"))


@query("c7_orphans", B.sql("""SELECT k.fila, CASE WHEN l.lead_consolidado_id IS NULL
        THEN 'sin_lead' WHEN l.empresa_id <> k.empresa_id THEN 'empresa_distinta'
        ELSE 'vinculada' END AS estado
    FROM links k LEFT JOIN (SELECT * FROM leads WHERE c_custkey % 10 <> 0) l
        USING (lead_consolidado_id)""", "leads", links=_LINKS))
def c7_orphans(t: Tables) -> DataFrame:
    ref = B.leads(t).where("c_custkey % 10 <> 0").select(
        "lead_consolidado_id", F.col("empresa_id").alias("_owner"))
    return _links(t).join(ref, "lead_consolidado_id", "left").select(
        "fila",
        F.when(F.col("_owner").isNull(), "sin_lead")
        .when(F.col("_owner") != F.col("empresa_id"), "empresa_distinta")
        .otherwise("vinculada").alias("estado"))


@query("c8_owner_mismatch", B.sql("""SELECT k.fila FROM links k LEFT JOIN leads l
    USING (lead_consolidado_id) WHERE l.empresa_id IS DISTINCT FROM k.empresa_id""", "leads",
    links=_LINKS))
def c8_owner_mismatch(t: Tables) -> DataFrame:
    return checks.owner_mismatch(
        _links(t), B.leads(t), ["lead_consolidado_id"], ["empresa_id"]).select("fila")


@query("c9_fk", """SELECT o_orderkey FROM orders WHERE nullif(o_custkey % 7, 0) IS NOT NULL
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)""")
def c9_fk(t: Tables) -> DataFrame:
    child = t.orders.withColumn("cliente", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")))
    parent = t.customer.where("c_custkey % 10 <> 0")
    return checks.missing_parents(child, parent, {"cliente": "c_custkey"}).select("o_orderkey")


@query("c10_lateral", B.sql("""SELECT l.lead_consolidado_id, c.n AS consultas, c.ultima
    FROM leads l LEFT JOIN LATERAL (SELECT count(*) AS n,
        strftime(max(o_orderdate), '%Y-%m-%d') AS ultima FROM inquiries q
        WHERE q.empresa_id = l.empresa_id AND q.lead_consolidado_id = l.lead_consolidado_id) c
    ON true""", "leads", "inquiries"))
def c10_lateral(t: Tables) -> DataFrame:
    per_lead = B.inquiries(t).groupBy("empresa_id", "lead_consolidado_id").agg(
        F.count(F.lit(1)).alias("consultas"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("ultima"))
    return B.leads(t).join(per_lead, ["empresa_id", "lead_consolidado_id"], "left").select(
        "lead_consolidado_id", F.coalesce("consultas", F.lit(0)).alias("consultas"), "ultima")


@query("c11_current_pointer", B.sql("""WITH p AS (SELECT empresa_id, lead_consolidado_id,
        max(fila) AS puntero FROM inquiries GROUP BY ALL)
    SELECT i.fila, i.empresa_id, i.canal FROM inquiries i JOIN p ON
        (p.empresa_id, p.lead_consolidado_id, p.puntero) =
        (i.empresa_id, i.lead_consolidado_id, i.fila)""", "inquiries"))
def c11_current_pointer(t: Tables) -> DataFrame:
    i = B.inquiries(t)
    pointer = i.groupBy("empresa_id", "lead_consolidado_id").agg(F.max("fila").alias("fila"))
    return i.join(pointer, ["empresa_id", "lead_consolidado_id", "fila"]).select(
        "fila", "empresa_id", "canal")


@query("c12_catalog", B.sql("""SELECT DISTINCT s.empresa_id, m.sku, m.marca, m.linea,
    m.precio_lista, m.unidades FROM catalogue m JOIN availability d ON d.sku = m.sku
    JOIN sites s ON s.punto_venta_id = d.punto_venta_id""", "catalogue", "availability", "sites"))
def c12_catalog(t: Tables) -> DataFrame:
    return catalog.tenant_catalogue(B.catalogue(t), B.availability(t), B.sites(t)).select(
        "empresa_id", "sku", "marca", "linea", "precio_lista", "unidades")


@query("c13_candidates", B.sql("""SELECT p.lead_consolidado_id, CAST(p.score AS DOUBLE) AS score,
    p.cola, q.ciudad FROM priorities p LEFT JOIN
    (SELECT * FROM inquiries WHERE fila % 4 <> 0) q ON q.fila = p.o_orderkey
        AND q.empresa_id = p.empresa_id""", "priorities", "inquiries"))
def c13_candidates(t: Tables) -> DataFrame:
    q = B.inquiries(t).where("fila % 4 <> 0").select(
        F.col("fila").alias("o_orderkey"), "empresa_id", "ciudad")
    return B.priorities(t).join(q, ["o_orderkey", "empresa_id"], "left").select(
        "lead_consolidado_id", F.col("score").cast("double").alias("score"), "cola", "ciudad")


@query("c14_optional_filters", B.sql("""SELECT lead_consolidado_id FROM priorities
    WHERE temperatura = 'tibio' AND cola NOT LIKE 'revision%' AND empresa_id = 'EMP-03'""",
    "priorities"))
def c14_optional_filters(t: Tables) -> DataFrame:
    return scope.filter_states(
        scope.scoped(B.priorities(t), "EMP-03"),
        temperatura="tibio", revision="no", sede="", estado="",
    ).select("lead_consolidado_id")


@query("c15_exists_parent", B.sql("""SELECT event_id FROM activities a WHERE EXISTS
    (SELECT 1 FROM leads l WHERE l.lead_consolidado_id = a.lead_consolidado_id
        AND l.empresa_id = 'EMP-03')""", "activities", "leads"))
def c15_exists_parent(t: Tables) -> DataFrame:
    return scope.scoped_children(
        B.activities(t), B.leads(t), "lead_consolidado_id", "EMP-03").select("event_id")


@query("c16_side_by_side", """SELECT a.c_custkey AS lead, x.o_totalprice AS score_actual,
    n.o_totalprice AS score_nuevo FROM (SELECT o_custkey AS c_custkey, min(o_orderkey) AS actual,
        max(o_orderkey) AS propuesta FROM orders GROUP BY 1) a
    JOIN orders x ON x.o_orderkey = a.actual JOIN orders n ON n.o_orderkey = a.propuesta
    WHERE actual <> propuesta""")
def c16_side_by_side(t: Tables) -> DataFrame:
    published = t.orders.groupBy(F.col("o_custkey").alias("lead")).agg(
        F.min("o_orderkey").alias("actual"), F.max("o_orderkey").alias("propuesta")
    ).where("actual <> propuesta")
    now = t.orders.select(F.col("o_orderkey").alias("actual"),
                          F.col("o_totalprice").alias("score_actual"))
    new = t.orders.select(F.col("o_orderkey").alias("propuesta"),
                          F.col("o_totalprice").alias("score_nuevo"))
    return published.join(now, "actual").join(new, "propuesta").select(
        "lead", "score_actual", "score_nuevo")


@query("c17_person_candidates", B.sql("""WITH b AS (SELECT empresa_id, 'T' || (c_custkey % 400) AS tel,
        count(DISTINCT lead_consolidado_id) AS personas, min(lead_consolidado_id) AS primera
        FROM inquiries GROUP BY 1, 2)
    SELECT fila AS solicitud_id, personas, primera FROM inquiries i
        JOIN b ON b.empresa_id = i.empresa_id AND tel = 'T' || (c_custkey % 400)""",
    "inquiries"))
def c17_person_candidates(t: Tables) -> DataFrame:
    tel = F.concat(F.lit("T"), (F.col("c_custkey") % 400).cast("string")).alias("tel")
    i = B.inquiries(t)
    r = i.select(F.col("fila").alias("solicitud_id"), "empresa_id", tel)
    people = identity.people_by_phone(i.select("empresa_id", "lead_consolidado_id", tel), "tel")
    return r.join(people, ["empresa_id", "tel"]).select("solicitud_id", "personas", "primera")


_STORED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 = 0 THEN 'X'
    ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 30 = 0 THEN NULL
    ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 50 <> 7"""


def _stored_orders(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.where(k % 50 != 7).select(
        "o_orderkey", "o_custkey",
        F.when(k % 20 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 30 != 0, F.col("o_totalprice")).alias("o_totalprice"))


@query("c18_reconcile", f"""WITH s AS ({_STORED}) SELECT e.o_orderkey,
    CASE WHEN s.o_orderkey IS NULL THEN 'ausente' ELSE 'distinta' END AS estado,
    CASE WHEN s.o_orderkey IS NOT NULL THEN concat_ws(',',
        CASE WHEN e.o_orderstatus IS DISTINCT FROM s.o_orderstatus THEN 'o_orderstatus' END,
        CASE WHEN e.o_totalprice IS DISTINCT FROM s.o_totalprice THEN 'o_totalprice' END) END
        AS columnas
    FROM orders e LEFT JOIN s USING (o_orderkey) WHERE s.o_orderkey IS NULL
        OR e.o_orderstatus IS DISTINCT FROM s.o_orderstatus
        OR e.o_totalprice IS DISTINCT FROM s.o_totalprice""")
def c18_reconcile(t: Tables) -> DataFrame:
    expected = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return checks.reconcile(expected, _stored_orders(t), ["o_orderkey"])


@query("c23_unique_mention", B.sql("""WITH k AS (SELECT regexp_replace(lower(marca || linea),
        '[^a-z0-9]', '', 'g') AS clave, sku FROM catalogue),
    u AS (SELECT clave, max(sku) AS sku FROM k GROUP BY 1 HAVING count(*) = 1)
    SELECT o_orderkey, u.sku FROM (SELECT o_orderkey, regexp_replace(lower(p_brand || p_name ||
        p_size), '[^a-z0-9]', '', 'g') AS clave FROM orders LEFT JOIN part
        ON p_partkey = o_orderkey % 3000) m LEFT JOIN u ON u.clave = m.clave""", "catalogue"))
def c23_unique_mention(t: Tables) -> DataFrame:
    said = F.concat_ws("-", F.upper("p_brand"), "p_name", F.col("p_size").cast("string"))
    mentions = t.orders.withColumn("p_partkey", F.col("o_orderkey") % 3000).join(
        t.part, "p_partkey", "left").select(
        "o_orderkey", F.when(F.col("p_brand").isNotNull(), said).alias("mencion"))
    return catalog.resolve_mentions(mentions, "mencion", B.catalogue(t)).select(
        "o_orderkey", "sku")


@query("c24_cache_split", B.sql("""SELECT conversacion_id, conv_id % 3 <> 0 AS en_cache
    FROM (SELECT DISTINCT conversacion_id, conv_id FROM messages)""", "messages"))
def c24_cache_split(t: Tables) -> DataFrame:
    from leadloom.operators.chat import chat_fingerprint, reuse_cached

    m = B.messages(t)
    wanted = chat_fingerprint(m, "v1")
    kept = chat_fingerprint(m.where("conv_id % 3 <> 0"), "v1").select("huella").unionByName(
        chat_fingerprint(m, "v0").select("huella"))
    hits, misses = reuse_cached(wanted, kept.withColumn("resultado", F.lit("{}")))
    return hits.select("conversacion_id", F.lit(True).alias("en_cache")).unionByName(
        misses.select("conversacion_id", F.lit(False).alias("en_cache")))


@query("c25_forbidden_use", B.sql("""SELECT p.lead_consolidado_id FROM priorities p
    JOIN (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 0) d
        ON d.conv_id = p.o_orderkey""", "priorities"))
def c25_forbidden_use(t: Tables) -> DataFrame:
    discarded = t.conversations.where("conv_id % 4 = 0").select("conv_id").distinct()
    return B.priorities(t).join(
        discarded, F.col("o_orderkey") == F.col("conv_id"), "left_semi"
    ).select("lead_consolidado_id")


@query("c26_sites", B.sql("""SELECT punto_venta_id, nombre FROM sites WHERE empresa_id = 'EMP-07'
    ORDER BY punto_venta_id""", "sites"))
def c26_sites(t: Tables) -> DataFrame:
    return scope.scoped(B.sites(t), "EMP-07").select("punto_venta_id", "nombre").orderBy(
        "punto_venta_id")


@query("c27_usable_chat", B.sql("""SELECT m.conversacion_id, m.posicion, m.emisor,
    md5(m.texto) AS texto FROM messages m JOIN (SELECT DISTINCT conv_id FROM conversations
        WHERE conv_id % 4 <> 0 AND conv_id % 25 = 3) c USING (conv_id)
    ORDER BY 1, 2""", "messages"))
def c27_usable_chat(t: Tables) -> DataFrame:
    chats = t.conversations.select("conv_id").distinct().select(
        "conv_id", B.company(F.col("conv_id") % 25).alias("empresa_id"),
        (F.col("conv_id") % 4 == 0).alias("descartada"))
    mine = scope.usable_chats(scope.scoped(chats, "EMP-03"))
    return B.messages(t).join(mine, "conv_id", "left_semi").select(
        "conversacion_id", "posicion", "emisor", F.md5("texto").alias("texto")
    ).orderBy("conversacion_id", "posicion")


@query("g2_key_sets", """SELECT coalesce(a.k, b.k) AS clave, a.k IS NOT NULL AS en_a,
    b.k IS NOT NULL AS en_b FROM (SELECT DISTINCT o_custkey AS k FROM orders) a
    FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 6 <> 0) b ON a.k = b.k
    WHERE a.k IS NULL OR b.k IS NULL""")
def g2_key_sets(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_custkey").alias("clave"))
    b = t.customer.where("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("clave"))
    return checks.key_differences(a, b, ["clave"])


@query("g3_partition", """SELECT o_orderkey, CAST((o_orderkey % 4 = 0)::INT
    + (o_orderkey % 6 = 0)::INT AS BIGINT) AS partes FROM orders
    WHERE (o_orderkey % 4 = 0) = (o_orderkey % 6 = 0)""")
def g3_partition(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey")
    return checks.partition_violations(
        o, [o.where("o_orderkey % 4 = 0"), o.where("o_orderkey % 6 = 0")], "o_orderkey")


@query("g4_disappearance", """SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0
    AND c_custkey % 10 = 0""")
def g4_disappearance(t: Tables) -> DataFrame:
    stored = t.customer.withColumn(
        "origen_registro", F.when(F.col("c_custkey") % 3 == 0, "lote").otherwise("web"))
    snapshot = t.customer.where("c_custkey % 10 <> 0")
    return checks.disappeared(stored, snapshot, ["c_custkey"], origin="origen_registro")


@query("g5_immutable", f"""WITH s AS ({_STORED}) SELECT e.o_orderkey, concat_ws(',',
        CASE WHEN e.o_orderstatus IS DISTINCT FROM s.o_orderstatus THEN 'o_orderstatus' END,
        CASE WHEN e.o_totalprice IS DISTINCT FROM s.o_totalprice THEN 'o_totalprice' END)
        AS columnas FROM orders e JOIN s USING (o_orderkey)
    WHERE e.o_orderstatus IS DISTINCT FROM s.o_orderstatus
        OR e.o_totalprice IS DISTINCT FROM s.o_totalprice""")
def g5_immutable(t: Tables) -> DataFrame:
    return checks.changed_rows(
        _stored_orders(t), t.orders, ["o_orderkey"],
        ["o_custkey", "o_orderstatus", "o_totalprice"],
    ).select("o_orderkey", F.array_join("columnas", ",").alias("columnas"))


@query("g6_new_categories", """SELECT DISTINCT p_brand || '/' || p_size AS valor FROM part
    EXCEPT SELECT DISTINCT p_brand || '/' || p_size FROM part WHERE p_partkey % 40 = 1""")
def g6_new_categories(t: Tables) -> DataFrame:
    value = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("valor")
    now = t.part.select(value).distinct()
    seen = t.part.where("p_partkey % 40 = 1").select(value).distinct()  # the catalogue known so far
    return now.join(seen, "valor", "left_anti")


@query("g7_table_counts", """SELECT 'customer' AS tabla, count(*) AS filas FROM customer
    UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*)
    FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def g7_table_counts(t: Tables) -> DataFrame:
    frames = {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem,
              "events": t.events}
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        out = one if out is None else out.unionByName(one)
    return out


@query("g8_masters", """WITH r AS (SELECT s_nationkey AS e, 'S' || s_suppkey AS p FROM supplier
        UNION SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'S' || (c_custkey % 40) END
        FROM customer UNION SELECT n_nationkey, NULL FROM nation)
    SELECT p AS punto_venta_id, count(DISTINCT e) AS empresas,
        CASE WHEN count(DISTINCT e) = 1 THEN max(e) END AS empresa FROM r WHERE p IS NOT NULL
    GROUP BY 1""")
def g8_masters(t: Tables) -> DataFrame:
    from leadloom.operators.star import company_site_masters

    a = t.supplier.select(
        F.col("s_nationkey").alias("empresa_id"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("punto_venta_id"))
    b = t.customer.select(
        F.col("c_nationkey").alias("empresa_id"),
        F.when(F.col("c_custkey") % 3 == 0,
               F.concat(F.lit("S"), (F.col("c_custkey") % 40).cast("string")))
        .alias("punto_venta_id"))
    c = t.nation.select(F.col("n_nationkey").alias("empresa_id"),
                        F.lit(None).cast("string").alias("punto_venta_id"))
    _, sites, _ = company_site_masters([a, b, c])
    return sites.select("punto_venta_id", "empresas", F.col("empresa_id").alias("empresa"))


_MERGED = """SELECT coalesce(n.k, s.k) AS k, CASE WHEN s.k IS NOT NULL
        THEN s.empresa ELSE n.empresa END AS empresa,
    CASE WHEN n.k IS NOT NULL AND (s.k IS NULL OR s.empresa = n.empresa) THEN n.v ELSE s.v END AS v
    FROM (SELECT o_orderkey AS k, o_custkey % 5 AS empresa, o_totalprice AS v FROM orders
        WHERE o_orderkey % 3 <> 0) s
    FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 9 ELSE o_custkey % 5 END
        AS empresa, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 4 <> 0) n ON n.k = s.k"""


def _merge_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, owner = F.col("o_orderkey"), F.col("o_custkey") % 5
    stored = t.orders.where(k % 3 != 0).select(
        k.alias("k"), owner.alias("empresa"), F.col("o_totalprice").alias("v"))
    new = t.orders.where(k % 4 != 0).select(
        k.alias("k"), F.when(k % 10 == 0, 9).otherwise(owner).alias("empresa"),
        (F.col("o_totalprice") * 2).alias("v"))
    return stored, new


@query("a14_upsert", _MERGED)
def a14_upsert(t: Tables) -> DataFrame:
    return upsert(*_merge_sides(t), ["k"], owner="empresa")


@query("a14_buckets", _MERGED)
def a14_buckets(t: Tables) -> DataFrame:
    """The same merge on a stored table, in two batches, the second of them sent twice."""
    stored, new = _merge_sides(t)
    path = f"{checkpoint_dir(t.spark)}/a14-{uuid.uuid4().hex}"
    keyed_table.create(stored, path, ["k"])
    change = partial(upsert, keys=["k"], owner="empresa")
    early = F.col("k") < 1000
    keyed_table.merge(path, new.where(early), "l1", ["k"], change)
    for _ in range(2):
        keyed_table.merge(path, new.where(~early), "l2", ["k"], change)
    return keyed_table.read(t.spark, path)
