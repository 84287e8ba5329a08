"""Data-quality log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions import dates, text
from leadloom.operators import catalog, checks, identity, incidents
from leadloom.plans import bindings as B
from leadloom.plans.q_aggregates import _GROUPS
from leadloom.plans.q_joins import _LINE_CTE, _LINE_KEYS, wanted_lines
from leadloom.plans.q_values import (
    PHONES,
    RESOLVED_DATES,
    _category_sql,
    _clean,
    prepared_inquiries,
    resolved_dates,
)
from leadloom.plans.registry import Tables, query

_CELLS_SQL = f"""SELECT fila, lead_id, email, lower({_clean('email')}) AS email_normalizado,
    ciudad, {_category_sql('ciudad', 'ciudad')[0]} AS ciudad_normalizado,
    {_category_sql('ciudad', 'ciudad')[1]} AS ciudad_estado,
    telefono, CASE WHEN telefono_estado = 'valido' THEN '+57' || local END AS telefono_normalizado,
    telefono_estado FROM phones"""


def _cells(t: Tables) -> DataFrame:
    c, p = text.category("ciudad", "ciudad"), text.phone("telefono")
    return B.inquiries(t).select(
        "fila", "lead_id", "email", F.lower(text.clean("email")).alias("email_normalizado"),
        "ciudad", c["valor"].alias("ciudad_normalizado"), c["estado"].alias("ciudad_estado"),
        "telefono", p["valor"].alias("telefono_normalizado"), p["estado"].alias("telefono_estado"))


def _cell_sql(f: str, state: str) -> str:
    return f"""SELECT fila, '{f}' AS campo, CASE WHEN trim(coalesce({f}, '')) = '' THEN 'faltante'
        WHEN {state} <> 'valido' THEN 'valor_no_resuelto'
        WHEN {f} IS DISTINCT FROM {f}_normalizado THEN 'normalizacion' END AS tipo,
        {f}_normalizado AS valor_resultante FROM cells"""


@query("i1_cell_log", B.sql("SELECT * FROM (" + " UNION ALL ".join([
    _cell_sql("email", "'valido'"), _cell_sql("ciudad", "ciudad_estado"),
    _cell_sql("telefono", "telefono_estado")]) + ") WHERE tipo IS NOT NULL", "inquiries", **PHONES,
    cells=_CELLS_SQL))
def i1_cell_log(t: Tables) -> DataFrame:
    return incidents.cell_log(
        _cells(t), "leads", "fila", "lead_id", ["email", "ciudad", "telefono"]
    ).select("fila", "campo", "tipo", "valor_resultante")


@query("i2_date_order_log", B.sql("""SELECT fila, regla AS accion FROM resolved
    WHERE regla LIKE 'MDY%' OR regla LIKE 'origen_mixto%'""", "inquiries", **RESOLVED_DATES))
def i2_date_order_log(t: Tables) -> DataFrame:
    f = F.col("f")
    return incidents.date_order_log(
        resolved_dates(t), "fila", "lead_id", f["regla"], f["motivo"],
        F.to_json(F.struct("fecha_registro", "fecha_primer_contacto")),
        f["registro"]["valor"].cast("string")).select("fila", "accion")


@query("i3_sequence_log", B.sql("""SELECT fila, b AS valor_original FROM resolved
    WHERE CASE WHEN pa = 'fecha' OR pb = 'fecha' THEN CAST(registro AS DATE) > CAST(contacto AS DATE)
        ELSE registro > contacto END""", "inquiries", **RESOLVED_DATES))
def i3_sequence_log(t: Tables) -> DataFrame:
    s = dates.sequence_state(F.col("f.registro"), F.col("f.contacto"))
    df = resolved_dates(t).withColumn("_q", s)
    return incidents.sequence_log(
        df, "fila", "lead_id", F.col("_q.estado"), F.col("_q.comentario"),
        F.col("fecha_primer_contacto")).select("fila", "valor_original")


@query("i4_duplicate_log", """SELECT o_orderkey AS fila, m AS valor_resultante FROM (SELECT *,
        min(o_orderkey) OVER (PARTITION BY o_orderstatus, o_orderpriority, o_custkey) AS m
    FROM orders) WHERE o_orderkey <> m""")
def i4_duplicate_log(t: Tables) -> DataFrame:
    trace = identity.exact_duplicates(
        t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"], "o_orderkey")
    return incidents.duplicate_log(trace, "o_orderkey", "o_custkey").select(
        "fila", F.col("valor_resultante").cast("bigint").alias("valor_resultante"))


_KEYED = """SELECT empresa_id, telefono, replace(strip_accents(lower(trim(regexp_replace(nombre,
    '\\s+', ' ', 'g')))), 'j.', 'j') AS k FROM prep WHERE telefono IS NOT NULL"""


@query("i5_identity_log", B.sql("""WITH g AS (SELECT empresa_id, telefono, k, count(*) AS n
        FROM keyed GROUP BY ALL),
    s AS (SELECT empresa_id, telefono, sum(n) AS filas,
        coalesce(sum(n) FILTER (WHERE k = 'j perez'), 0) AS ini,
        bool_or(k = 'ana perez') AND bool_or(k <> 'ana perez') AS ana,
        bool_or(k = 'prueba') AS prueba,
        count(*) FILTER (WHERE k LIKE 'jose % perez') AS medios FROM g GROUP BY ALL)
    SELECT empresa_id || '|' || telefono AS id_origen, CASE WHEN ini <= 1 AND NOT ana AND NOT prueba
        AND medios <= 1 THEN 'agrupado' ELSE 'separado_por_identidad_incierta' END
        AS valor_resultante FROM s WHERE filas > 1""", "inquiries", **_GROUPS, keyed=_KEYED))
def i5_identity_log(t: Tables) -> DataFrame:
    return incidents.identity_log(identity.identity_decisions(prepared_inquiries(t))).select(
        "id_origen", "valor_resultante")


@query("i6_shared_phone_log", B.sql("""SELECT telefono AS valor_original FROM prep
    WHERE telefono IS NOT NULL GROUP BY 1 HAVING count(DISTINCT empresa_id) > 1""", "inquiries",
    **_GROUPS))
def i6_shared_phone_log(t: Tables) -> DataFrame:
    from leadloom.operators.profile import shared_across_owners

    phones = B.inquiries(t).select("empresa_id", text.phone("telefono")["valor"].alias("telefono"))
    return incidents.shared_phone_log(
        shared_across_owners(phones, "telefono", "empresa_id")).select("valor_original")


def _chats(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id").distinct().select(
        F.concat(F.lit("CONV-"), F.col("conv_id").cast("string")).alias("conversacion_id"),
        F.concat(F.lit("C-"), (F.col("conv_id") * 3).cast("string")).alias("lead_id"))


@query("i7_unlinked_chats", B.sql("""SELECT DISTINCT 'CONV-' || conv_id AS id_origen,
    'C-' || conv_id * 3 AS valor_original FROM conversations
    WHERE 'C-' || conv_id * 3 NOT IN (SELECT lead_id FROM inquiries WHERE fila % 2 = 0)""",
    "inquiries"))
def i7_unlinked_chats(t: Tables) -> DataFrame:
    kept = B.inquiries(t).where("fila % 2 = 0")
    return incidents.unlinked_chat_log(identity.link_chats(_chats(t), kept)).select(
        "id_origen", "valor_original")


@query("i9_unlisted_models", B.sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey
    FROM lines WHERE modelo_sku IN (SELECT sku FROM catalogue)
        AND (empresa_id, punto_venta_id) IN (SELECT (empresa_id, punto_venta_id) FROM sites)
        AND (modelo_sku, punto_venta_id) NOT IN (SELECT (sku, punto_venta_id) FROM availability)""",
    "sites", "catalogue", "availability", lines=_LINE_CTE))
def i9_unlisted_models(t: Tables) -> DataFrame:
    state = catalog.availability_state(
        wanted_lines(t), B.catalogue(t), B.sites(t), B.availability(t)
    ).withColumn("_k", F.concat_ws("|", *[F.col(c).cast("string") for c in _LINE_KEYS]))
    out = incidents.unlisted_model_log(state, "l_orderkey", "_k")
    parts = F.split("id_origen", r"\|")
    return out.select(*[
        F.get(parts, F.lit(i)).cast("int" if c == "l_linenumber" else "bigint").alias(c)
        for i, c in enumerate(_LINE_KEYS)])


@query("i10_unknown_sites", B.sql("""SELECT l_orderkey AS fila, count(*) AS n FROM lines l
    WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.empresa_id = l.empresa_id
        AND s.punto_venta_id = l.punto_venta_id) GROUP BY 1""", "sites", lines=_LINE_CTE))
def i10_unknown_sites(t: Tables) -> DataFrame:
    pairs = B.sites(t).select("empresa_id", "punto_venta_id").distinct()
    orphans = wanted_lines(t).join(pairs, ["empresa_id", "punto_venta_id"], "left_anti")
    return incidents.unknown_site_log(orphans, "l_orderkey", "l_partkey").groupBy("fila").agg(
        F.count(F.lit(1)).alias("n"))


@query("i11_message_gaps", B.sql("""SELECT conversacion_id || '#' || posicion AS id_origen,
    'hora' AS campo FROM messages WHERE posicion % 3 = 0
    UNION ALL SELECT conversacion_id || '#' || posicion, 'emisor' FROM messages
    WHERE posicion % 5 = 0""", "messages"))
def i11_message_gaps(t: Tables) -> DataFrame:
    m = B.messages(t).withColumns({
        "hora": F.when(F.col("posicion") % 3 != 0, "10:00"),
        "emisor": F.when(F.col("posicion") % 5 == 0, "").otherwise(F.col("emisor"))})
    return incidents.message_gap_log(m).select("id_origen", "campo")


@query("i12_exceptions", B.sql("""SELECT fila, 'ciudad' AS campo, ciudad_estado AS estado FROM cells
    WHERE ciudad_estado <> 'valido' UNION ALL SELECT fila, 'telefono', telefono_estado FROM cells
    WHERE telefono_estado <> 'valido'""", "inquiries", **PHONES, cells=_CELLS_SQL))
def i12_exceptions(t: Tables) -> DataFrame:
    return incidents.exceptions_table(
        _cells(t), "leads", "fila", "lead_id", ["ciudad", "telefono"]
    ).select("fila", "campo", "estado")


@query("i14_trace", B.sql("""WITH p AS (SELECT fila, 0 AS c FROM prep UNION ALL SELECT fila, 1
        FROM prep WHERE fila % 5 = 0)
    SELECT fila * 2 + c AS fila, fila * 2 AS fila_conservada,
        CASE WHEN c = 0 THEN 'conservar' ELSE 'repeticion_exacta' END AS accion,
        CASE WHEN fila % 12 = 3 AND fila % 7 = 0 THEN 'excluido_sin_valor_recuperable'
            ELSE 'conservado' END AS estado_salida FROM p""", "inquiries", **_GROUPS))
def i14_trace(t: Tables) -> DataFrame:
    first = prepared_inquiries(t).select("fila", "lead_id", "empresa_id")
    rows = first.select(F.col("fila") * 2, "lead_id", "empresa_id").toDF(
        "fila", "lead_id", "empresa_id").unionByName(
        first.where("fila % 5 = 0").select((F.col("fila") * 2 + 1).alias("fila"), "lead_id",
                                           "empresa_id"))
    trace = identity.exact_duplicates(rows, ["lead_id", "empresa_id"], "fila").select(
        "fila", "fila_conservada", "accion")
    ids = rows.select("fila", F.col("lead_id").alias("lead_consolidado_id"),
                      F.lit("consulta_individual").alias("regla_identidad"))
    out = first.where("fila % 12 = 3 AND fila % 7 = 0").select(
        (F.col("fila") * 2).alias("fila"),
        F.lit("excluir_sin_valor_recuperable").alias("decision"),
        F.lit(V.EXCLUSION_TEXT).alias("comentario"))
    return incidents.traceability(trace, ids, out, "fila").select(
        "fila", "fila_conservada", "accion", "estado_salida")


@query("i15_event_owner", B.sql("""WITH e AS (SELECT event_id, 'L-' || user_id AS ref, CASE WHEN
        event_id % 4 = 0 THEN 'ver CONV-' || lpad(CAST(event_id % 30 AS VARCHAR), 3, '0') END AS nota
        FROM events)
    SELECT event_id, empresa_id AS empresa_inferida FROM e LEFT JOIN leads
        ON lead_consolidado_id = ref AND c_custkey % 3 <> 0
    WHERE nota IS NULL OR event_id % 30 >= 10""", "leads"))
def i15_event_owner(t: Tables) -> DataFrame:
    events = t.events.select(
        "event_id", F.concat(F.lit("L-"), F.col("user_id").cast("string")).alias(
            "lead_consolidado_id"),
        F.when(F.col("event_id") % 4 == 0, F.concat(
            F.lit("ver CONV-"), F.lpad((F.col("event_id") % 30).cast("string"), 3, "0")))
        .alias("nota"))
    owners = B.leads(t).where("c_custkey % 3 <> 0").select(
        F.col("lead_consolidado_id").alias("referencia"), "empresa_id")
    external = t.events.select(F.concat(
        F.lit("CONV-"), F.lpad((F.col("event_id") % 10).cast("string"), 3, "0"))
        .alias("conversacion_id")).distinct()
    kept, _ = incidents.with_owner(events, owners, external)
    return kept.select("event_id", "empresa_inferida")


@query("i16_contracts", B.sql("""SELECT 'cliente_sin_registro' AS regla, CAST(o_orderkey AS VARCHAR)
        AS clave FROM orders WHERE o_custkey % 10 = 0
    UNION ALL SELECT 'importe_alto', CAST(o_orderkey AS VARCHAR) FROM orders
        WHERE o_totalprice > 490000"""))
def i16_contracts(t: Tables) -> DataFrame:
    parents = t.customer.where("c_custkey % 10 <> 0")
    orphans = checks.missing_parents(t.orders, parents, {"o_custkey": "c_custkey"})
    a = checks.expect(orphans, "cliente_sin_registro", F.lit(True), "o_orderkey")
    b = checks.expect(t.orders, "importe_alto", F.col("o_totalprice") > 490000, "o_orderkey")
    return a.unionByName(b).select("regla", "clave")


@query("g1_incident_log", B.sql("""WITH l AS (SELECT 'exclusion' AS tipo, fila FROM inquiries
        WHERE fila % 6 = 4 UNION ALL SELECT 'faltante', fila FROM inquiries WHERE email IS NULL),
    n AS (SELECT *, row_number() OVER (ORDER BY tipo, fila) AS p FROM l)
    SELECT 'INC-' || CASE WHEN p < 1000000 THEN lpad(CAST(p AS VARCHAR), 6, '0')
        ELSE CAST(p AS VARCHAR) END AS incidencia_id, tipo, fila FROM n""", "inquiries"))
def g1_incident_log(t: Tables) -> DataFrame:
    i = B.inquiries(t)

    def log(df: DataFrame, kind: str) -> DataFrame:
        return incidents._log(df, tipo=kind, tabla="leads", fila=F.col("fila"),
                              id_origen=F.col("lead_id"))

    return incidents.numbered_log([
        log(i.where("fila % 6 = 4"), "exclusion"), log(i.where("email IS NULL"), "faltante"),
    ]).select("incidencia_id", "tipo", "fila")


@query("j4_clean_split", B.sql("""SELECT fila, CASE WHEN fila % 12 = 3 AND fila % 7 = 0
    THEN 'excluido' ELSE 'limpio' END AS conjunto FROM inquiries""", "inquiries"))
def j4_clean_split(t: Tables) -> DataFrame:
    i = B.inquiries(t).select("fila")
    decisions = i.select("fila", F.when(
        (F.col("fila") % 12 == 3) & (F.col("fila") % 7 == 0), "excluir_sin_valor_recuperable"
    ).otherwise("conservar_con_anotacion").alias("decision"))
    kept, out = identity.clean_split(i, decisions, "fila")
    return kept.withColumn("conjunto", F.lit("limpio")).unionByName(
        out.withColumn("conjunto", F.lit("excluido")))
