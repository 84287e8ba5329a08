"""Priority, publication, state folding and scoping queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions import signals
from leadloom.operators import assignment, capture, changes, identity, keyed_table, merge, priority, scope
from leadloom.plans import bindings as B
from leadloom.plans.q_aggregates import _GROUPS
from leadloom.plans.q_values import prepared_inquiries
from leadloom.plans.registry import Tables, query
from leadloom.session import checkpoint_dir


@query("j1_identity", B.sql("""WITH k AS (SELECT *, replace(strip_accents(lower(trim(regexp_replace(
        nombre, '\\s+', ' ', 'g')))), 'j.', 'j') AS k FROM prep),
    s AS (SELECT empresa_id, telefono, count(*) AS filas, count(*) FILTER (WHERE k = 'j perez') AS ini,
        bool_or(k = 'ana perez') AND bool_or(k <> 'ana perez') AS ana, bool_or(k = 'prueba') AS pr,
        count(DISTINCT k) FILTER (WHERE k LIKE 'jose % perez') AS medios FROM k
        WHERE telefono IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT * FROM s WHERE filas > 1 AND ini <= 1 AND NOT ana AND NOT pr AND medios <= 1)
    SELECT k.fila, 'LC-' || substr(sha256('["' || k.empresa_id || '", "' || CASE WHEN g.filas > 1
        THEN 'telefono:' || k.telefono ELSE 'consulta:' || k.lead_id END || '"]'), 1, 20)
        AS lead_consolidado_id FROM k LEFT JOIN g USING (empresa_id, telefono)""", "inquiries",
    **_GROUPS))
def j1_identity(t: Tables) -> DataFrame:
    return identity.resolve_identities(prepared_inquiries(t)).select("fila", "lead_consolidado_id")


@query("j3_intake_decision", B.sql("""WITH r AS (SELECT fila AS solicitud_id, empresa_id,
        c_custkey // 3 AS tel FROM inquiries),
    b AS (SELECT DISTINCT empresa_id, lead_consolidado_id, c_custkey // 3 + c_custkey % 2 AS tel,
        c_custkey % 3 <> 0 AS visible FROM leads),
    c AS (SELECT r.solicitud_id, count(lead_consolidado_id) AS n, min(lead_consolidado_id) AS lead,
        bool_and(visible) AS visible FROM r LEFT JOIN b USING (empresa_id, tel) GROUP BY 1)
    SELECT solicitud_id, CASE WHEN n = 0 THEN 'nueva' WHEN n > 1 OR NOT visible
        THEN 'revision_requerida' ELSE 'consulta_existente' END AS estado,
    CASE WHEN n = 1 AND visible THEN lead END AS lead_consolidado_id,
    CASE WHEN n > 1 THEN 'identidad_ambigua' WHEN n = 1 AND NOT visible
        THEN 'coincidencia_fuera_de_cartera' END AS motivo FROM c""", "inquiries", "leads"))
def j3_intake_decision(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    third = F.floor(k / 3)
    r = B.inquiries(t).select(F.col("fila").alias("solicitud_id"), "empresa_id", third.alias("tel"))
    b = B.leads(t).select(
        "empresa_id", "lead_consolidado_id", (third + k % 2).alias("tel"), (k % 3 != 0).alias("visible"))
    return identity.intake_by_phone(r, b, "tel")


def _context_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, cid = F.col("fila"), F.col("conv_id")
    leads = B.leads(t).select("empresa_id", "lead_consolidado_id")
    inquiries = B.inquiries(t).select(
        "empresa_id", "lead_consolidado_id", "lead_id", "canal",
        F.when(k % 4 != 0, F.concat(F.lit("SKU-"), (k % 3).cast("string"))).alias("modelo_sku"),
        F.when(k % 211 != 0, F.date_trunc("year", "o_orderdate")).alias("fecha"),
        (k % 5 != 0).alias("con_hora"),
        F.when(F.col("c_custkey") % 6 == 0, "Descartado").alias("estado_gestion"))
    first = inquiries.groupBy("empresa_id", "lead_consolidado_id").agg(
        F.min("lead_id").alias("lead_id"))
    chats = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "*", F.concat(F.lit("L-"), (cid % 60).cast("string")).alias("lead_consolidado_id"))
    chats = chats.join(first, "lead_consolidado_id").select(
        "empresa_id", "lead_consolidado_id", "lead_id",
        F.concat(F.lit("CONV-"), cid.cast("string")).alias("conversacion_id"),
        F.when(cid % 31 != 7, F.expr(
            "timestamp_ntz '2024-03-01 00:00:00' + make_dt_interval(cast(conv_id % 3 as int), "
            "cast(conv_id % 7 as int))")).alias("fecha"),
        (cid % 4 != 0).alias("con_hora"),
        (cid % 3).alias("menciones"), (cid % 3).alias("skus"),
        F.when(cid % 3 == 1, F.concat(F.lit("SKU-C"), cid.cast("string"))).alias("sku"),
        F.when(cid % 5 == 0, "SI").when(cid % 5 == 1, "NO").otherwise("NO_INFORMA")
        .alias("inicial"),
        F.when(cid % 4 == 1, "credito").when(cid % 4 == 2, "contado").otherwise("mixto")
        .alias("forma_pago"),
        (cid % 7 == 0).alias("cita"))
    return leads, inquiries, chats


_LATEST = """SELECT {k}, {id}, CASE WHEN mal THEN 'fecha_invalida' WHEN n = 1 THEN NULL WHEN sin
        THEN 'orden_intradia_desconocido' WHEN nf > 1 THEN 'empate_fecha' END AS motivo
    FROM (SELECT {k}, bool_or(fecha IS NULL) AS mal, count(*) FILTER (WHERE d = md) AS n,
        bool_or(NOT con_hora) FILTER (WHERE d = md) AS sin, count(*) FILTER (WHERE fecha = mf) AS nf,
        min({id}) FILTER (WHERE fecha = mf) AS {id}
        FROM (SELECT *, CAST(fecha AS DATE) AS d, max(CAST(fecha AS DATE)) OVER w AS md,
            max(fecha) OVER w AS mf FROM {t} WINDOW w AS (PARTITION BY {k})) GROUP BY {k})"""
_CONTEXT = {
    "ci": """SELECT empresa_id, lead_consolidado_id, lead_id, canal, CASE WHEN fila % 4 <> 0
            THEN 'SKU-' || (fila % 3) END AS modelo_sku,
        CASE WHEN fila % 211 <> 0 THEN date_trunc('year', o_orderdate) END AS fecha,
        fila % 5 <> 0 AS con_hora, CASE WHEN c_custkey % 6 = 0 THEN 'Descartado' END
            AS estado_gestion FROM inquiries""",
    "cc": """SELECT f.empresa_id, f.lead_consolidado_id, f.lead_id, 'CONV-' || conv_id
            AS conversacion_id,
        CASE WHEN conv_id % 31 <> 7 THEN TIMESTAMP '2024-03-01 00:00:00'
            + to_days(CAST(conv_id % 3 AS INTEGER)) + to_hours(CAST(conv_id % 7 AS INTEGER)) END
            AS fecha, conv_id % 4 <> 0 AS con_hora, conv_id % 3 AS menciones,
        CASE WHEN conv_id % 3 = 1 THEN 'SKU-C' || conv_id END AS sku,
        CASE conv_id % 5 WHEN 0 THEN 'SI' WHEN 1 THEN 'NO' ELSE 'NO_INFORMA' END AS inicial,
        CASE conv_id % 4 WHEN 1 THEN 'credito' WHEN 2 THEN 'contado' ELSE 'mixto' END AS forma_pago,
        conv_id % 7 = 0 AS cita
        FROM (SELECT DISTINCT conv_id FROM conversations) JOIN (SELECT empresa_id,
            lead_consolidado_id, min(lead_id) AS lead_id FROM ci GROUP BY 1, 2) f
        ON f.lead_consolidado_id = 'L-' || (conv_id % 60)""",
    "lc": _LATEST.format(k="lead_consolidado_id", id="conversacion_id", t="cc"),
    "lq": _LATEST.format(k="lead_consolidado_id", id="lead_id", t="ci"),
    "sh": """SELECT lead_consolidado_id, CASE WHEN count(DISTINCT coalesce(canal, 'DESCONOCIDO')) = 1
            THEN max(coalesce(canal, 'DESCONOCIDO')) ELSE 'DESCONOCIDO' END AS canal,
        CASE WHEN count(DISTINCT coalesce(modelo_sku, 'DESCONOCIDO')) = 1
            THEN max(coalesce(modelo_sku, 'DESCONOCIDO')) ELSE 'DESCONOCIDO' END AS sku,
        bool_and(coalesce(estado_gestion = 'Descartado', false)) AS todas FROM ci GROUP BY 1""",
    "ctx": """SELECT l.empresa_id, l.lead_consolidado_id, c.conversacion_id
            AS conversacion_id_contexto,
        q.lead_id AS lead_id_contexto,
        CASE WHEN q.lead_id IS NOT NULL THEN coalesce(q.canal, 'DESCONOCIDO')
            ELSE coalesce(sh.canal, 'DESCONOCIDO') END AS canal,
        CASE WHEN c.menciones > 0 THEN CASE WHEN c.sku IS NOT NULL THEN c.sku ELSE 'AMBIGUO' END
            WHEN q.lead_id IS NOT NULL THEN coalesce(q.modelo_sku, 'DESCONOCIDO')
            ELSE coalesce(sh.sku, 'DESCONOCIDO') END AS modelo_sku,
        coalesce(c.inicial, 'NO_INFORMA') AS inicial,
        CASE WHEN c.forma_pago IN ('credito', 'contado') THEN c.forma_pago ELSE 'no_informa' END
            AS pago,
        coalesce(c.cita, false) AS cita, sh.todas,
        CASE WHEN c.conversacion_id IS NOT NULL THEN 'conversacion_utilizable'
            WHEN lc.motivo IS NOT NULL THEN 'revision_orden' ELSE 'sin_conversacion_utilizable' END
            AS estado_contexto
        FROM leads l LEFT JOIN lc ON lc.lead_consolidado_id = l.lead_consolidado_id
        LEFT JOIN cc c ON lc.motivo IS NULL AND c.conversacion_id = lc.conversacion_id
        LEFT JOIN lq ON lq.lead_consolidado_id = l.lead_consolidado_id
        LEFT JOIN ci q ON q.lead_consolidado_id = l.lead_consolidado_id AND q.lead_id =
            coalesce(c.lead_id, CASE WHEN lq.motivo IS NULL THEN lq.lead_id END)
        LEFT JOIN sh ON sh.lead_consolidado_id = l.lead_consolidado_id""",
}


@query("j5_context", B.sql("""SELECT lead_consolidado_id, conversacion_id_contexto, lead_id_contexto,
    canal, modelo_sku, inicial, pago, cita, todas, estado_contexto FROM ctx""", "inquiries", "leads",
    **_CONTEXT))
def j5_context(t: Tables) -> DataFrame:
    return priority.context_rows(*_context_inputs(t)).select(
        "lead_consolidado_id", "conversacion_id_contexto", "lead_id_contexto", "canal", "modelo_sku",
        F.col("manifesto_cuota_inicial").alias("inicial"),
        F.col("forma_pago_declarada").alias("pago"),
        (F.col("cita_observada") == "SI").alias("cita"),
        F.col("todas_consultas_descartadas").alias("todas"), "estado_contexto")


@query("j12_ranked_context", B.sql("""WITH p AS (SELECT *, (modelo_sku NOT IN ('DESCONOCIDO',
        'AMBIGUO', ''))::INT * 10 + (inicial = 'SI')::INT * 30 + (pago <> 'no_informa')::INT * 10
        + cita::INT * 40 AS puntos, CASE WHEN cita THEN 'caliente' WHEN inicial = 'SI' OR
        pago <> 'no_informa' THEN 'tibio' ELSE 'sin_informacion_suficiente' END AS temperatura
        FROM ctx),
    c AS (SELECT *, CASE WHEN todas THEN 'revision_descartado_crm' WHEN estado_contexto =
        'revision_orden' THEN 'revision_datos' WHEN temperatura = 'sin_informacion_suficiente'
        THEN 'primer_contacto_o_ampliar_informacion' ELSE 'seguimiento_comercial' END AS cola FROM p)
    SELECT lead_consolidado_id, puntos::BIGINT AS puntos, temperatura, cola, row_number() OVER
        (PARTITION BY empresa_id, cola ORDER BY puntos DESC, lead_consolidado_id) AS posicion
    FROM c""", "inquiries", "leads", **_CONTEXT))
def j12_ranked_context(t: Tables) -> DataFrame:
    done = priority.prioritise(priority.context_rows(*_context_inputs(t)))
    dated = done.withColumns({"fecha": F.lit(None).cast("date"), "hora": F.lit(None).cast("string")})
    return priority.queue_positions(dated).select(
        "lead_consolidado_id", "puntos", "temperatura", "cola", "posicion")


@query("j6_initial_signal", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'NO_INFORMA'
    WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'NO' ELSE 'SI' END
    WHEN o_orderkey % 4 = 2 THEN 'SI' ELSE 'NO_INFORMA' END AS inicial FROM orders""")
def j6_initial_signal(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    value = F.when(k == 1, (F.col("o_custkey") % 2).cast("double"))
    low = F.when(k == 2, F.col("o_totalprice"))
    evidence = F.when(k == 0, 0).otherwise(1)
    return t.orders.select("o_orderkey", signals.initial_signal(value, low, evidence).alias("inicial"))


@query("j7_score", B.sql("SELECT lead_consolidado_id, puntos, CAST(score AS DOUBLE) AS score FROM temps",
                         "temps"))
def j7_score(t: Tables) -> DataFrame:
    return B.priorities(t).select(
        "lead_consolidado_id", "puntos", F.col("score").cast("double").alias("score"))


@query("j8_temperature", B.sql("SELECT lead_consolidado_id, temperatura FROM temps", "temps"))
def j8_temperature(t: Tables) -> DataFrame:
    return B.priorities(t).select("lead_consolidado_id", "temperatura")


@query("j9_queue", B.sql("SELECT lead_consolidado_id, cola FROM priorities", "priorities"))
def j9_queue(t: Tables) -> DataFrame:
    return B.priorities(t).select("lead_consolidado_id", "cola")


@query("j10_explanation", B.sql(f"""SELECT lead_consolidado_id, concat_ws(' ',
    CASE WHEN modelo_sku <> 'DESCONOCIDO' THEN '{V.SIGNAL_TEXT["modelo"]}' END,
    CASE WHEN inicial_positiva THEN '{V.SIGNAL_TEXT["inicial"]}' END,
    CASE WHEN forma_pago IN ('credito', 'contado') THEN '{V.SIGNAL_TEXT["pago"]}' END,
    CASE WHEN pidio_cita THEN '{V.SIGNAL_TEXT["cita"]}' END) || '{V.SCALE_TEXT}' AS explicacion
    FROM signals_frame""", "signals_frame"))
def j10_explanation(t: Tables) -> DataFrame:
    return B.signals_frame(t).select("lead_consolidado_id", signals.explanation(
        "modelo_sku", "inicial_positiva", "forma_pago", "pidio_cita").alias("explicacion"))


@query("j11_action", B.sql(f"""SELECT lead_consolidado_id, CASE WHEN cola = 'seguimiento_comercial'
    AND temperatura = 'caliente' THEN '{V.APPOINTMENT_ACTION}' """ + " ".join(
    f"WHEN cola = '{q}' THEN '{a}'" for q, a in V.QUEUE_ACTION.items()) + """ END AS accion
    FROM priorities""", "priorities"))
def j11_action(t: Tables) -> DataFrame:
    return B.priorities(t).select(
        "lead_consolidado_id", signals.action("cola", "temperatura").alias("accion"))


def _candidates(t: Tables) -> DataFrame:
    """Leads of companies of 3 000 orders, dealt over the four sites of their company."""
    k = F.col("o_orderkey")
    company = F.floor(k / 3000)
    owner = (20 * company + k % 4 + 4 * (k % 5)) * 10 + 1
    return B.priorities(t).select(
        "o_orderkey", F.concat(F.lit("E"), company).alias("empresa_id"), "lead_consolidado_id", "cola", "score",
        "fecha",
        F.when(k % 12 != 5, F.concat(F.lit("PV-"), (k % 4).cast("string"))).alias("punto_venta_id"),
        F.when(k % 3 != 0, F.when(k % 13 == 0, "cerrado").otherwise("abierto")).alias("estado"),
        (k % 17 == 0).alias("requiere_revision"),
        F.when(k % 3 == 1, F.expr(
            "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 5 as int))"))
        .alias("proxima_accion_en"),
        F.when(k % 23 == 1, owner.cast("bigint")).alias("responsable"))


_NOW = "2024-01-03 12:00:00"
_CANDIDATES = """SELECT o_orderkey, lead_consolidado_id, cola, score, fecha, CASE WHEN o_orderkey % 12 <> 5
        THEN 'PV' END AS sede, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 13 = 0
        THEN 'cerrado' ELSE 'abierto' END END AS estado, o_orderkey % 17 = 0 AS rev,
    CASE WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '2024-01-01 00:00:00'
        + to_days(CAST(o_orderkey % 5 AS INTEGER)) END AS proxima FROM priorities"""


@query("j15_eligibility", B.sql(f"""SELECT lead_consolidado_id, CASE WHEN cola LIKE 'revision%'
        THEN 'revision' WHEN sede IS NULL THEN 'sin_sede_verificable'
    WHEN estado <> 'abierto' OR (estado IS NOT NULL AND rev) THEN 'estado_no_elegible'
    WHEN estado IS NOT NULL AND proxima > TIMESTAMP '{_NOW}' THEN 'seguimiento_futuro' END AS motivo
    FROM cand""", "priorities", cand=_CANDIDATES))
def j15_eligibility(t: Tables) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    return _candidates(t).select(
        "lead_consolidado_id", assignment.exclusion_reason(now).alias("motivo"))


@query("d27_exclusions", B.sql(f"""SELECT CASE WHEN cola LIKE 'revision%'
        THEN 'revision' WHEN sede IS NULL THEN 'sin_sede_verificable'
    WHEN estado <> 'abierto' OR (estado IS NOT NULL AND rev) THEN 'estado_no_elegible'
    WHEN estado IS NOT NULL AND proxima > TIMESTAMP '{_NOW}' THEN 'seguimiento_futuro' END AS motivo,
    count(*) AS leads FROM cand GROUP BY 1""", "priorities", cand=_CANDIDATES))
def d27_exclusions(t: Tables) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    return _candidates(t).groupBy(assignment.exclusion_reason(now).alias("motivo")).agg(
        F.count(F.lit(1)).alias("leads"))


def _members(t: Tables) -> DataFrame:
    """Suppliers as the staff of companies of twenty, five to a site; some share an advisor's places."""
    s = F.col("s_suppkey")
    number = s - F.when(s % 20 == 13, 4).otherwise(0)
    return t.supplier.select(
        (s * 10 + 1).cast("bigint").alias("membresia_id"), F.concat(F.lit("E"), F.floor(s / 20)).alias("empresa_id"),
        F.concat(F.lit("AS-"), number.cast("string")).alias("asesor_id"),
        F.concat(F.lit("PV-"), (s % 4).cast("string")).alias("punto_venta_id"),
        F.when(number % 9 != 4, 12 + number % 7).alias("capacidad"), (number % 3).alias("carga"),
        (s % 5).alias("ultima_posicion"))


_STAFF = """SELECT s_suppkey * 10 + 1 AS m, s_suppkey // 20 AS e, s_suppkey % 4 AS pv,
    s_suppkey - CASE WHEN s_suppkey % 20 = 13 THEN 4 ELSE 0 END AS a, s_suppkey % 5 AS pos FROM supplier"""
_DAY = f"""SELECT o_orderkey // 3000 AS e, o_orderkey % 4 AS pv, lead_consolidado_id AS l,
        CASE WHEN o_orderkey % 23 = 1
            THEN (20 * (o_orderkey // 3000) + o_orderkey % 4 + 4 * (o_orderkey % 5)) * 10 + 1 END AS owner,
        row_number() OVER (PARTITION BY o_orderkey // 3000, o_orderkey % 4
            ORDER BY CASE WHEN proxima <= TIMESTAMP '{_NOW}' THEN proxima END NULLS LAST, score DESC NULLS LAST,
            fecha NULLS LAST, lead_consolidado_id) AS n
    FROM cand WHERE o_orderkey % 41 <> 2 AND cola NOT LIKE 'revision%' AND sede IS NOT NULL AND (estado IS NULL
        OR (estado = 'abierto' AND NOT rev AND (proxima IS NULL OR proxima <= TIMESTAMP '{_NOW}')))"""


@query("j14_assignment", B.sql("""SELECT l AS lead_consolidado_id, who.m AS membresia_id,
        map_extract(last, who.m)[1] AS posicion_inicial FROM run WHERE who IS NOT NULL""", "priorities",
    cand=_CANDIDATES, member=_STAFF, day=_DAY,
    site="""SELECT e, pv, list({'m': m, 'a': a, 'cap': CASE WHEN a % 9 = 4 THEN 0 ELSE 12 + a % 7 END}) AS staff,
        map_from_entries(list(DISTINCT (a, a % 3))) AS load, map_from_entries(list((m, pos))) AS last
        FROM member GROUP BY e, pv""",
    run="""SELECT e, pv, CAST(0 AS BIGINT) AS n, staff, load, last, CAST(NULL AS VARCHAR) AS l,
            CAST(NULL AS STRUCT(r BIGINT, m BIGINT, a BIGINT)) AS who FROM site
        UNION ALL
        SELECT e, pv, n, staff, CASE WHEN who IS NULL THEN load
                ELSE map_concat(load, MAP([who.a], [map_extract(load, who.a)[1] + 1])) END,
            CASE WHEN who IS NULL THEN last
                ELSE map_concat(last, MAP([who.m], [map_extract(last, who.m)[1] + 1])) END, l, who
        FROM (SELECT d.e, d.pv, d.n, run.staff, run.load, run.last, d.l, list_sort(list_transform(list_filter(run.staff,
                lambda x: x.cap > map_extract(run.load, x.a)[1] AND (d.owner IS NULL OR d.owner = x.m)),
                lambda x: {'r': map_extract(run.load, x.a)[1] - x.cap, 'm': x.m, 'a': x.a}))[1] AS who
            FROM run JOIN day d ON d.e = run.e AND d.pv = run.pv AND d.n = run.n + 1)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1))
def j14_assignment(t: Tables) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp_ntz")
    candidates = _candidates(t)
    already = candidates.where("o_orderkey % 41 = 2")
    assigned, _ = assignment.daily_assignment(candidates, _members(t), already, now)
    return assigned.select("lead_consolidado_id", "membresia_id", "posicion_inicial")


_DESK = """member AS (SELECT s_suppkey AS m, s_suppkey // 5 AS e, s_suppkey % 23 <> 5 AND s_suppkey % 13 <> 6 AS valid,
        s_suppkey - CASE WHEN s_suppkey % 5 = 3 AND s_suppkey // 5 % 4 = 1 THEN 1 ELSE 0 END AS k,
        s_suppkey % 17 = 3 AS loose, CASE WHEN s_suppkey % 5 = 4 AND s_suppkey // 5 % 3 = 0 THEN 'T' ELSE 'S' END AS sede
        FROM supplier),
    adviser AS (SELECT *, CASE WHEN NOT loose THEN 'AS-' || k END AS a,
        CASE WHEN k % 19 = 8 THEN 0 ELSE 6 + k % 7 END AS cap FROM member),
    lead AS (SELECT c_custkey AS c, c_custkey // 75 AS e, 'L' || c_custkey AS l,
        CASE WHEN c_custkey % 4 <> 0 THEN 5 * (c_custkey // 75) + c_custkey % 5 END AS owner,
        CASE WHEN c_custkey % 29 = 7 THEN NULL WHEN c_custkey % 31 = 9 THEN 'T' ELSE 'S' END AS sede,
        CASE WHEN c_custkey % 3 <> 0 THEN 5 * (c_custkey // 75) + c_custkey % 5 END AS holder,
        (c_custkey % 75) // 5 + 1 AS place, c_custkey % 11 = 0 AS done FROM customer)"""


@query("j16_transfers", f"""WITH RECURSIVE {_DESK},
    req AS (SELECT o_orderkey AS id, l.e, l.l, row_number() OVER (PARTITION BY l.e ORDER BY o_orderkey) AS n, d.a AS too,
        5 * l.e + (o_orderkey * 7 + o_custkey) % 5 + CASE WHEN o_orderkey % 97 = 1 THEN 5 ELSE 0 END AS dest, d.cap,
        coalesce(d.e = l.e AND d.valid, false) AS valid, l.holder IS NOT NULL AND NOT l.done AS open,
        CASE WHEN d.a IS NULL THEN 'sin_asesor_operativo' WHEN l.sede IS NULL THEN 'sin_sede_verificable'
            WHEN d.sede <> l.sede THEN 'sede_distinta' END AS late
        FROM orders JOIN lead l ON l.c = o_custkey LEFT JOIN adviser d
        ON d.m = 5 * l.e + (o_orderkey * 7 + o_custkey) % 5 + CASE WHEN o_orderkey % 97 = 1 THEN 5 ELSE 0 END),
    own0 AS (SELECT e, map_from_entries(list((l, owner))) AS own FROM lead GROUP BY e),
    held0 AS (SELECT l.e, map_from_entries(list((l.l, {{'m': l.holder, 'a': d.a, 'p': l.place}}))) AS held
        FROM lead l JOIN adviser d ON d.m = l.holder GROUP BY l.e),
    run AS (SELECT o.e, CAST(0 AS BIGINT) AS n, own, held, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS l,
            CAST(NULL AS BIGINT) AS dest, CAST(NULL AS BIGINT) AS anterior, CAST(NULL AS VARCHAR) AS decision,
            CAST(NULL AS BIGINT) AS pos FROM own0 o JOIN held0 h ON h.e = o.e
        UNION ALL
        SELECT e, n, CASE WHEN decision = 'transferido' THEN map_concat(own, MAP([l], [dest])) ELSE own END,
            CASE WHEN pos IS NOT NULL THEN map_concat(held, MAP([l], [{{'m': dest, 'a': too, 'p': pos}}])) ELSE held END,
            id, l, dest, anterior, decision, pos
        FROM (SELECT *, CASE WHEN moves AND decision = 'transferido' THEN 1 + coalesce(list_max(list_transform(
                list_filter(map_values(held), lambda x: x.m = dest), lambda x: x.p)), 0) END AS pos
            FROM (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN moves AND len(list_filter(
                    map_values(held), lambda x: x.a = too)) >= cap THEN 'sin_cupo' ELSE 'transferido' END AS decision
                FROM (SELECT *, why IS NULL AND open AND map_extract(held, l)[1].m <> dest AS moves
                    FROM (SELECT *, CASE WHEN NOT valid THEN 'responsable_invalido' WHEN anterior = dest THEN 'sin_cambio'
                            ELSE late END AS why
                        FROM (SELECT r.e, r.n, run.own, run.held, r.id, r.l, r.dest, r.too, r.cap, r.valid, r.open, r.late,
                                map_extract(run.own, r.l)[1] AS anterior
                            FROM run JOIN req r ON r.e = run.e AND r.n = run.n + 1))))))
    SELECT id AS solicitud_id, l AS lead_consolidado_id, anterior, decision, pos AS posicion_inicial
    FROM run WHERE id IS NOT NULL""")
def j16_transfers(t: Tables) -> DataFrame:
    """Orders as transfer requests, customers as leads, suppliers as the staff of companies of five."""
    s, c, o = F.col("s_suppkey"), F.col("c_custkey"), F.col("o_orderkey")
    desk = F.floor(s / 5)
    number = s - F.when((s % 5 == 3) & (desk % 4 == 1), 1).otherwise(0)
    members = t.supplier.select(
        s.cast("bigint").alias("membresia_id"), F.concat(F.lit("E"), desk).alias("empresa_id"),
        F.when(s % 23 == 5, "supervisor").otherwise("asesor").alias("rol"), (s % 13 != 6).alias("activa"),
        F.when(s % 17 != 3, F.concat(F.lit("AS-"), number)).alias("asesor_id"),
        F.when((s % 5 == 4) & (desk % 3 == 0), "T").otherwise("S").alias("punto_venta_id"),
        F.when(number % 19 != 8, 6 + number % 7).alias("capacidad"))
    company = F.floor(c / 75)
    own = (5 * company + c % 5).cast("bigint")
    lead = [F.concat(F.lit("E"), company).alias("empresa_id"), F.concat(F.lit("L"), c).alias("lead_consolidado_id")]
    states = t.customer.select(
        *lead, F.when(c % 4 != 0, own).alias("responsable"),
        F.when(c % 29 == 7, None).when(c % 31 == 9, "T").otherwise("S").alias("punto_venta_id"))
    plan = t.customer.where(c % 3 != 0).select(
        *lead, own.alias("membresia_id"), F.when(c % 11 == 0, "completada").otherwise("pendiente").alias("estado"),
        (F.floor(c % 75 / 5) + 1).cast("bigint").alias("posicion_inicial"))
    company = F.floor(F.col("o_custkey") / 75)
    to = 5 * company + (o * 7 + F.col("o_custkey")) % 5 + F.when(o % 97 == 1, 5).otherwise(0)
    requests = t.orders.join(t.customer.select(c.alias("o_custkey")), "o_custkey").select(
        o.cast("bigint").alias("solicitud_id"), F.concat(F.lit("E"), company).alias("empresa_id"),
        F.concat(F.lit("L"), "o_custkey").alias("lead_consolidado_id"), to.cast("bigint").alias("destino"))
    decisions, _ = assignment.transfer_owners(requests, states, members, plan)
    return decisions.select("solicitud_id", "lead_consolidado_id", "anterior", "decision", "posicion_inicial")


_PUBLISHED = """WITH v AS (SELECT o_custkey AS l, min(o_orderkey) AS p FROM orders
        WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS l, max(o_orderkey) AS p
        FROM orders GROUP BY 1)
    SELECT CAST(coalesce(v.l, n.l) AS VARCHAR) AS lead_consolidado_id,
        CAST(coalesce(v.p, n.p) AS VARCHAR) AS priorizacion_id,
        coalesce(v.p <> n.p, false) AS conflicto_lote,
        CASE WHEN v.p <> n.p THEN CAST(n.p AS VARCHAR) END AS propuesta_lote_id,
        CASE WHEN v.l IS NULL THEN 'lote' ELSE 'captura_manual' END AS origen
    FROM v FULL JOIN n ON v.l = n.l"""


@query("l3_publish", _PUBLISHED)
def l3_publish(t: Tables) -> DataFrame:
    return merge.publish_batch(_published(t), _proposals(t)).select(
        "lead_consolidado_id", "priorizacion_id", "conflicto_lote", "propuesta_lote_id", "origen")


def _published(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("p")).select(
        F.lit("E").alias("empresa_id"), F.col("o_custkey").cast("string").alias("lead_consolidado_id"),
        F.col("p").cast("string").alias("priorizacion_id"),
        (F.col("o_custkey") % 4 + 1).alias("revision_entrada"),
        F.lit("captura_manual").alias("origen"), F.lit(False).alias("conflicto_lote"),
        F.lit(None).cast("string").alias("propuesta_lote_id"),
        F.lit(None).cast("boolean").alias("revision_antes_conflicto"))


def _proposals(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("p")).select(
        F.lit("E").alias("empresa_id"), F.col("o_custkey").cast("string").alias("lead_consolidado_id"),
        F.col("p").cast("string").alias("priorizacion_id"))


@query("l3_buckets", _PUBLISHED)
def l3_buckets(t: Tables) -> DataFrame:
    """The same publication on a stored table of pointers, sent twice."""
    path = f"{checkpoint_dir(t.spark)}/l3-{uuid.uuid4().hex}"
    keyed_table.create(_published(t), path, merge.LEAD)
    for _ in range(2):
        keyed_table.merge(path, _proposals(t), "l1", merge.LEAD, merge.publish_batch)
    return keyed_table.read(t.spark, path).select(
        "lead_consolidado_id", "priorizacion_id", "conflicto_lote", "propuesta_lote_id", "origen")


@query("l4_initial_pointer", """SELECT CAST(o_custkey AS VARCHAR) AS lead_consolidado_id,
    CAST(o_orderkey AS VARCHAR) AS priorizacion_id, CASE WHEN o_orderstatus = 'F' THEN 'lote'
        ELSE 'captura_manual' END AS origen FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn FROM orders
    WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def l4_initial_pointer(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    priorities = t.orders.select(
        F.lit("E").alias("empresa_id"), F.col("o_custkey").cast("string").alias("lead_consolidado_id"),
        key.alias("priorizacion_id"), key.alias("ejecucion_id"))
    runs = t.orders.select(
        key.alias("ejecucion_id"),
        F.when(F.col("o_orderstatus") == "F", "clasificacion_importada").otherwise(
            "prioridad_manual").alias("etapa"),
        F.when(F.col("o_orderstatus") == "P", "en_curso").otherwise("completada").alias("estado"),
        F.col("o_orderdate").alias("registrada_en"))
    return merge.current_from_runs(priorities, runs).select(
        "lead_consolidado_id", "priorizacion_id", "origen")


def _states(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.where(k % 5 != 0).select(
        F.lit("E").alias("empresa_id"), k.cast("string").alias("lead_consolidado_id"),
        F.lit("abierto").alias("estado"), (k % 3 + 1).alias("revision_entrada"),
        F.concat(F.lit("P"), k.cast("string")).alias("priorizacion_vigente_id"),
        F.lit("captura_manual").alias("priorizacion_origen"),
        (k % 7 == 0).alias("requiere_revision"))


@query("l5_guarded", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 + 1 = o_custkey % 3 + 1
    THEN 'aceptado' ELSE 'obsoleto' END AS estado FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_custkey % 5 <> 0""")
def l5_guarded(t: Tables) -> DataFrame:
    results = t.orders.select(
        "o_orderkey", F.lit("E").alias("empresa_id"),
        F.col("o_custkey").cast("string").alias("lead_consolidado_id"),
        (F.col("o_orderkey") % 4 + 1).alias("revision_entrada"))
    good, stale = merge.guarded_publication(_states(t), results)
    return good.select("o_orderkey", F.lit("aceptado").alias("estado")).unionByName(
        stale.select("o_orderkey", F.lit("obsoleto").alias("estado")))


@query("l6_propagate", """WITH s AS (SELECT c_custkey AS l, c_custkey % 3 + 1 AS rev, c_custkey % 7 = 0
        AS flag FROM customer WHERE c_custkey % 5 <> 0),
    p AS (SELECT o_custkey AS l, min(o_orderkey) AS p, o_custkey % 4 + 1 AS rev FROM orders
        WHERE o_orderkey % 2 = 0 GROUP BY 1)
    SELECT CAST(coalesce(s.l, p.l) AS VARCHAR) AS lead_consolidado_id,
        CASE WHEN p.l IS NOT NULL AND (s.l IS NULL OR s.rev <= p.rev) THEN p.rev ELSE s.rev END
            AS revision_entrada,
        CASE WHEN p.l IS NOT NULL AND (s.l IS NULL OR s.rev <= p.rev) THEN CAST(p.p AS VARCHAR)
            ELSE 'P' || s.l END AS priorizacion_vigente_id,
        coalesce(s.flag, false) AS requiere_revision
    FROM s FULL JOIN p ON s.l = p.l""")
def l6_propagate(t: Tables) -> DataFrame:
    return merge.propagate(_states(t), _published(t)).select(
        "lead_consolidado_id", "revision_entrada", "priorizacion_vigente_id", "requiere_revision")


@query("l8_resolve_conflicts", """WITH v AS (SELECT o_custkey AS l, min(o_orderkey) AS p FROM orders
        WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS l, max(o_orderkey) AS p
        FROM orders GROUP BY 1),
    c AS (SELECT coalesce(v.l, n.l) AS l, coalesce(v.p, n.p) AS p, v.p <> n.p AS conf, n.p AS prop,
        coalesce(v.l % 4 + 1, 1) AS rev FROM v FULL JOIN n ON v.l = n.l)
    SELECT CAST(l AS VARCHAR) AS lead_consolidado_id, CASE WHEN conf AND l % 3 = 0 THEN
        CAST(prop AS VARCHAR) ELSE CAST(p AS VARCHAR) END AS priorizacion_id,
        CASE WHEN conf AND l % 3 <> 2 THEN rev + 1 ELSE rev END AS revision_entrada,
        coalesce(conf AND l % 3 = 2, false) AS conflicto_lote FROM c""")
def l8_resolve_conflicts(t: Tables) -> DataFrame:
    published = merge.publish_batch(_published(t), _proposals(t))
    k = F.col("lead_consolidado_id").cast("bigint")
    decisions = published.where("conflicto_lote").select(
        "empresa_id", "lead_consolidado_id",
        F.when(k % 3 == 2, "otra").otherwise(F.col("propuesta_lote_id")).alias("propuesta_id"),
        F.when(k % 3 == 0, "adoptar").otherwise("conservar").alias("accion"),
        F.lit("revisado").alias("nota"))
    audit = decisions.where(F.lit(False))
    pointers, _, _ = merge.resolve_conflicts(published, decisions, audit)
    return pointers.select(
        "lead_consolidado_id", "priorizacion_id", "revision_entrada", "conflicto_lote")


@query("l9_requests", """WITH r AS (SELECT event_id, user_id, event_type, CAST(value AS INT) % 2 AS b
        FROM events), f AS (SELECT *, first_value(event_id) OVER w AS fe, first_value(b) OVER w AS fb
        FROM r WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
    SELECT event_id, CASE WHEN event_id = fe THEN 'efectiva' WHEN b = fb THEN 'repetida'
        ELSE 'conflicto' END AS resultado FROM f""")
def l9_requests(t: Tables) -> DataFrame:
    # half-up like the SQL cast, so both sides see the same body
    r = t.events.withColumn("cuerpo", (F.rint("value").cast("int") % 2).cast("string"))
    return merge.idempotent_requests(
        r, ["user_id", "event_type"], "cuerpo", "event_id"
    ).select("event_id", F.col("resultado_solicitud").alias("resultado"))


@query("l10_fold", B.sql("""SELECT lead_consolidado_id, coalesce(arg_max(resultado, (ts, event_id))
        FILTER (WHERE resultado IN ('cerrado', 'perdido', 'descartado')), 'abierto') AS estado,
    count(*) AS gestiones FROM activities GROUP BY 1""", "activities"))
def l10_fold(t: Tables) -> DataFrame:
    a = B.activities(t).withColumn("proxima_accion_en", F.when(
        F.col("resultado") == "seguimiento_programado", F.col("ts")))
    return merge.fold_activities(a).select("lead_consolidado_id", "estado", "gestiones")


@query("l11_complete", B.sql("""SELECT 'L-' || c_custkey AS lead_consolidado_id, CASE WHEN
    'L-' || c_custkey IN (SELECT lead_consolidado_id FROM activities WHERE CAST(ts AS DATE) =
        DATE '2024-01-10') THEN 'completada' ELSE 'pendiente' END AS estado FROM customer""",
    "activities"))
def l11_complete(t: Tables) -> DataFrame:
    day = F.lit("2024-01-10").cast("date")
    plan = B.leads(t).select(
        "empresa_id", "lead_consolidado_id", day.alias("fecha_operativa"),
        F.lit("pendiente").alias("estado"))
    acts = B.activities(t).withColumn("dia", F.to_date("ts"))
    return merge.complete_assignments(plan, acts).select("lead_consolidado_id", "estado")


def _sha(kind: str, key: str) -> str:
    return f"""'WEB-' || substr(sha256('["{kind}", "' || {key} || '"]'), 1, 32)"""


def _pointers(t: Tables, late: bool) -> DataFrame:
    """The published pointers when a batch is planned, and later, when some leads have moved on."""
    k = F.col("c_custkey")
    moved = (k % 11 == 0) if late else F.lit(False)
    return t.customer.where(k % 6 != 0).select(
        F.concat(F.lit("E"), k % 5).alias("empresa_id"), F.concat(F.lit("L"), k).alias("lead_consolidado_id"),
        F.concat(F.when(moved, "Q").otherwise("P"), k).alias("priorizacion_id"),
        (k % 4 + 1 + moved.cast("int")).cast("bigint").alias("revision_entrada"),
        F.lit("captura_manual").alias("origen"), F.lit(False).alias("conflicto_lote"),
        F.lit(None).cast("string").alias("propuesta_lote_id"),
        F.lit(None).cast("boolean").alias("revision_antes_conflicto"))


@query("l13_intake", f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS ts,
        o_custkey % 3 <> 0 AS known, CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END
        + CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE 0 END + CASE WHEN o_orderkey % 5 < 2 THEN 10 ELSE 0 END
        + CASE WHEN o_orderkey % 7 = 0 THEN 40 ELSE 0 END AS points
        FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey IN (SELECT c_custkey FROM customer)),
    b AS (SELECT CASE WHEN known THEN 'L' || c ELSE {_sha('lead', 'id')} END AS l, any_value(c) AS c, bool_and(known)
            AS known, count(*) AS n, arg_max(id, (ts, CAST(id AS VARCHAR))) AS last,
            arg_max(points, (ts, CAST(id AS VARCHAR))) AS points FROM r GROUP BY 1),
    taken AS (SELECT *, {_sha('prioridad', 'last')} AS p FROM b WHERE NOT known OR c % 11 <> 0)
    SELECT l AS lead_consolidado_id, p AS priorizacion_id, CASE WHEN known THEN c % 4 + 1 + n ELSE n END
        AS revision_entrada, round(points * 100 / 90.0::DOUBLE, 2) AS score FROM taken
    UNION ALL SELECT 'L' || c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'Q' ELSE 'P' END || c_custkey,
        c_custkey % 4 + 1 + CAST(c_custkey % 11 = 0 AS INT), NULL FROM customer
    WHERE c_custkey % 6 <> 0 AND 'L' || c_custkey NOT IN (SELECT l FROM taken)""")
def l13_intake(t: Tables) -> DataFrame:
    """Orders as captures: planned, applied when some leads have moved on, and applied once more."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    requests = t.orders.join(t.customer, c == F.col("c_custkey")).where(k % 4 != 3).select(
        k.cast("string").alias("solicitud_id"), F.concat(F.lit("E"), c % 5).alias("empresa_id"),
        F.lit("u").alias("actor"), F.col("c_name").alias("nombre_limpio"),
        F.lit("+573001112233").alias("telefono_valido"), F.lit(None).cast("string").alias("correo_valido"),
        F.lit("S").alias("sede_id"), F.when(k % 2 == 0, F.concat(F.lit("K"), k % 7)).alias("modelo_sku"),
        F.when(k % 3 == 0, 5.0).when(k % 3 == 1, 0.0).alias("cuota_inicial"),
        F.when(k % 5 == 0, "credito").when(k % 5 == 1, "contado").alias("forma_pago"),
        (k % 7 == 0).alias("cliente_pidio_cita"), F.col("o_orderdate").alias("registrada_en"),
        F.when(c % 3 != 0, F.concat(F.lit("L"), c)).alias("lead_existente"))
    seen = _pointers(t, late=False)
    batch = capture.intake_changes(requests, seen, {"prioridades_publicadas": seen})
    first, _ = changes.apply_changes(batch, {"prioridades_publicadas": _pointers(t, late=True)})
    again, _ = changes.apply_changes(batch, first)
    scores = again["priorizaciones"].select("priorizacion_id", F.col("score_prioridad").cast("double").alias("score"))
    return again["prioridades_publicadas"].join(scores, "priorizacion_id", "left").select(
        "lead_consolidado_id", "priorizacion_id", "revision_entrada", "score")


@query("l12_reviews", """WITH d AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'vincular'
            WHEN 1 THEN 'rechazar' WHEN 2 THEN 'crear_distinto' ELSE 'otra' END AS accion, o_orderkey % 5 <> 0 AS noted,
        o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 OR o_orderkey % 13 = 5 AS led, o_orderkey % 7 = 0 AS settled,
        o_custkey % 6 <> 0 AS known, o_orderkey % 17 = 4 AS first FROM orders),
    j AS (SELECT *, CASE WHEN accion = 'otra' THEN 'decision_invalida'
        WHEN accion = 'vincular' AND NOT led THEN 'falta_lead' WHEN accion <> 'vincular' AND led THEN 'lead_no_admitido'
        WHEN accion <> 'vincular' AND NOT noted THEN 'falta_motivo' WHEN settled THEN 'decision_distinta'
        WHEN accion = 'vincular' AND NOT known THEN 'lead_ajeno' END AS motivo FROM d)
    SELECT CAST(k AS VARCHAR) AS revision_id, motivo, CASE WHEN first AND NOT settled THEN 'en_espera'
        WHEN settled THEN 'resuelta' WHEN motivo IS NOT NULL THEN 'pendiente'
        WHEN accion = 'rechazar' THEN 'rechazada' ELSE 'resuelta' END AS estado FROM j""")
def l12_reviews(t: Tables) -> DataFrame:
    """Orders as reviews with a decision each: some are invalid, some find the review changed meanwhile."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    key, company = k.cast("string").alias("revision_id"), F.concat(F.lit("E"), c % 5).alias("empresa_id")
    settled = k % 7 == 0
    reviews = t.orders.select(
        key, company, F.when(settled, "resuelta").otherwise("pendiente").alias("estado"),
        F.when(settled, "antes").alias("resolucion"))
    led = ((k % 4 == 0) & (k % 3 != 0)) | (k % 13 == 5)
    decisions = t.orders.select(
        key, F.element_at(F.array(*map(F.lit, [*capture.ACTIONS, "otra"])), (k % 4 + 1).cast("int")).alias("accion"),
        F.when(k % 5 != 0, "visto").otherwise(" ").alias("nota"),
        F.when(led, F.concat(F.lit("L"), c)).alias("lead_id"), F.lit("s").alias("actor"))
    batch, refused = capture.review_changes(reviews, decisions, _pointers(t, late=False))
    meanwhile = reviews.withColumn("estado", F.when(
        (F.col("revision_id").cast("bigint") % 17 == 4) & (F.col("estado") == "pendiente"), "en_espera")
        .otherwise(F.col("estado")))
    first, _ = changes.apply_changes(batch, {"revisiones": meanwhile})
    again, _ = changes.apply_changes(batch, first)
    return again["revisiones"].join(refused, "revision_id", "left").select("revision_id", "estado", "motivo")


@query("l15_publication", """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 <> 1 THEN 10 ELSE 0 END
        + CASE WHEN o_orderkey % 9 <> 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 8 = 2) THEN 30 ELSE 0 END
        + CASE WHEN o_orderkey % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN o_orderkey % 10 = 3 THEN 40 ELSE 0 END AS points
        FROM orders WHERE o_custkey % 6 <> 0 AND o_orderkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)),
    b AS (SELECT c, arg_max(k, CAST(k AS VARCHAR)) AS k, arg_max(points, CAST(k AS VARCHAR)) AS points
        FROM r WHERE c % 11 <> 0 GROUP BY c)
    SELECT 'L' || c AS lead_consolidado_id, 'IA-' || k AS priorizacion_id, 'gemini' AS origen, c % 4 + 1
        AS revision_entrada, round(points * 100 / 90.0::DOUBLE, 2) AS score, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END
        AS menciones, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS sin_identificar FROM b
    UNION ALL SELECT 'L' || c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'Q' ELSE 'P' END || c_custkey, 'captura_manual',
        c_custkey % 4 + 1 + CAST(c_custkey % 11 = 0 AS INT), NULL, NULL, NULL FROM customer
    WHERE c_custkey % 6 <> 0 AND c_custkey NOT IN (SELECT c FROM b)""")
def l15_publication(t: Tables) -> DataFrame:
    """Orders as finished chat extractions: some for an old revision, some whose lead moves on meanwhile."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat_ws(" ", "p_brand", F.lit("M"), "p_partkey")
    catalogue = t.part.select(
        F.concat(F.lit("S"), "p_partkey").alias("sku"), F.col("p_brand").alias("marca"),
        F.concat(F.lit("M "), "p_partkey").alias("linea"))
    rows = t.orders.join(t.customer, c == F.col("c_custkey")).join(t.part, F.col("p_partkey") == k % 50 + 1)
    results = rows.select(
        k.cast("string").alias("trabajo_id"), F.concat(F.lit("E"), c % 5).alias("empresa_id"),
        F.concat(F.lit("L"), c).alias("lead_consolidado_id"), F.concat(F.lit("C"), k).alias("lead_id_origen"),
        F.concat(F.lit("CONV-"), k).alias("conversacion_id"),
        (c % 4 + 1 + (k % 5 == 0).cast("int")).cast("bigint").alias("revision_entrada"),
        F.when(k % 3 == 0, F.array(name)).when(k % 3 == 1, F.array(name, F.lit("otra")))
        .otherwise(F.array(F.upper(name), name)).alias("modelos_interes"),
        F.when(k % 4 == 0, 5.0).when(k % 4 == 1, 0.0).alias("cuota_inicial"),
        F.when(k % 8 == 2, 3.0).alias("inicial_minimo"), F.when(k % 9 != 0, 1).otherwise(0).alias("inicial_evidencias"),
        F.when(k % 7 == 0, "credito").alias("forma_pago"), (k % 10 == 3).alias("cliente_pidio_cita"))
    seen = _pointers(t, late=False)
    batch, _ = capture.publication_changes(results, catalogue, seen, {"prioridades_publicadas": seen})
    first, _ = changes.apply_changes(batch, {"prioridades_publicadas": _pointers(t, late=True)})
    again, _ = changes.apply_changes(batch, first)
    scores = again["priorizaciones"].select("priorizacion_id", F.col("score_prioridad").cast("double").alias("score"))
    named = again["intereses_modelo"].groupBy(F.col("extraccion_id").alias("priorizacion_id")).agg(
        F.count(F.lit(1)).alias("menciones"), F.count_if(F.col("modelo_sku").isNull()).alias("sin_identificar"))
    return again["prioridades_publicadas"].join(scores, "priorizacion_id", "left").join(
        named, "priorizacion_id", "left").select(
        "lead_consolidado_id", "priorizacion_id", "origen", "revision_entrada", "score", "menciones", "sin_identificar")


@query("l14_jobs", """WITH j AS (SELECT *, o_orderkey % 3 AS e, o_orderkey % 5 AS intentos,
        o_orderdate < TIMESTAMP '1999-01-01' AS vencido FROM (SELECT *, row_number() OVER (PARTITION
        BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1)
    SELECT o_orderkey AS trabajo_id, CASE WHEN e = 0 AND vencido AND intentos >= 3 THEN 'fallido'
        WHEN e = 0 AND vencido THEN 'reintento' WHEN e = 1 AND o_custkey % 4 = 0 THEN 'obsoleto'
        WHEN e = 0 THEN 'ejecutando' WHEN e = 1 THEN 'completado' ELSE 'pendiente' END AS estado
    FROM j""")
def l14_jobs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    jobs = t.orders.select(
        k.alias("trabajo_id"), F.lit("E").alias("empresa_id"), F.lit("chat").alias("tipo_entidad"),
        F.col("o_custkey").alias("entidad_id"), F.col("o_orderpriority").alias("tipo_trabajo"),
        F.lit(1).alias("revision_entrada"), (k % 5).alias("intentos"),
        F.lit(3).alias("max_intentos"),
        F.when(k % 3 == 0, "ejecutando").when(k % 3 == 1, "completado").otherwise("pendiente")
        .alias("estado"),
        F.col("o_orderdate").alias("lease_hasta"), F.col("o_orderdate").alias("disponible_en"))
    revisions = t.customer.select(
        F.col("c_custkey").alias("entidad_id"),
        F.when(F.col("c_custkey") % 4 == 0, 2).otherwise(1).alias("revision"))
    now = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    return merge.settle_jobs(jobs, now, revisions).select("trabajo_id", "estado")


@query("l16_seed", """SELECT CAST(o_custkey AS VARCHAR) AS lead_consolidado_id,
    CAST(min(o_orderkey) AS VARCHAR) AS priorizacion_vigente_id FROM orders
    WHERE o_orderkey % 2 = 0 AND o_custkey % 5 = 0 GROUP BY o_custkey""")
def l16_seed(t: Tables) -> DataFrame:
    return merge.seed_states(_states(t), _published(t)).select(
        "lead_consolidado_id", "priorizacion_vigente_id")


@query("m1_scoped", B.sql("SELECT lead_consolidado_id FROM leads WHERE empresa_id = 'EMP-11'", "leads"))
def m1_scoped(t: Tables) -> DataFrame:
    return scope.scoped(B.leads(t), " EMP-11 ").select("lead_consolidado_id")


@query("m2_children", B.sql("""SELECT event_id FROM activities a WHERE a.lead_consolidado_id IN
    (SELECT lead_consolidado_id FROM leads WHERE empresa_id = 'EMP-11')""", "activities", "leads"))
def m2_children(t: Tables) -> DataFrame:
    return scope.scoped_children(
        B.activities(t), B.leads(t), "lead_consolidado_id", "EMP-11").select("event_id")


_MEMBERS = """SELECT s_suppkey AS membresia_id, 'EMP-' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')
    AS empresa_id, 'u' || s_suppkey AS usuario, CASE WHEN s_suppkey % 11 = 0 THEN 'lector'
    WHEN s_suppkey % 4 = 0 THEN 'supervisor' ELSE 'asesor' END AS rol, s_acctbal > 0 AS activa
    FROM supplier"""
_VISIBLE = """SELECT m.membresia_id, l.lead_consolidado_id, c_custkey FROM memb m JOIN leads l
    ON l.empresa_id = m.empresa_id
    WHERE m.activa AND ((rol = 'supervisor') OR (rol = 'asesor' AND c_custkey % 2 = 0
        AND membresia_id = c_custkey % 10) OR (rol = 'asesor' AND c_custkey % 2 = 1
        AND c_custkey % 3 = 0 AND usuario = 'u' || (c_custkey % 7)))"""


def _scope_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    members = t.supplier.select(
        s.alias("membresia_id"), B.company("s_nationkey").alias("empresa_id"),
        F.concat(F.lit("u"), s.cast("string")).alias("usuario"),
        F.when(s % 11 == 0, "lector").when(s % 4 == 0, "supervisor").otherwise("asesor")
        .alias("rol"), (F.col("s_acctbal") > 0).alias("activa"))
    states = B.leads(t).select(
        "empresa_id", "lead_consolidado_id", F.when(k % 2 == 0, k % 10).alias("responsable"),
        "c_custkey")
    captures = B.leads(t).where("c_custkey % 3 = 0").select(
        "empresa_id", "lead_consolidado_id",
        F.concat(F.lit("u"), (k % 7).cast("string")).alias("autor"))
    return states, captures, members


@query("m3_visible", B.sql("""SELECT membresia_id, empresa_id, NULL AS lead_consolidado_id, true AS todo
    FROM memb WHERE activa AND rol = 'supervisor' UNION ALL
    SELECT v.membresia_id, m.empresa_id, lead_consolidado_id, false FROM vis v
        JOIN memb m USING (membresia_id) WHERE rol = 'asesor'""", "leads",
                           memb=_MEMBERS, vis=_VISIBLE))
def m3_visible(t: Tables) -> DataFrame:
    return scope.grants(*_scope_inputs(t))


@query("m3_of_member", B.sql("""SELECT lead_consolidado_id FROM vis WHERE membresia_id =
    (SELECT min(membresia_id) FROM memb WHERE activa AND rol = 'supervisor')""", "leads",
                             memb=_MEMBERS, vis=_VISIBLE))
def m3_of_member(t: Tables) -> DataFrame:
    states, captures, members = _scope_inputs(t)
    first = members.where("activa AND rol = 'supervisor'").agg(F.min("membresia_id").alias("m"))
    member = members.join(F.broadcast(first), F.col("membresia_id") == F.col("m")).drop("m")
    return scope.visible_states(states, captures, member).select("lead_consolidado_id")


@query("m4_todays_queue", B.sql("""SELECT membresia_id, lead_consolidado_id, c_custkey AS posicion
    FROM vis WHERE membresia_id = c_custkey % 10 AND c_custkey % 3 = 0""", "leads", memb=_MEMBERS,
    vis=_VISIBLE))
def m4_todays_queue(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    plan = B.leads(t).select(
        (k % 10).alias("membresia_id"), "empresa_id", "lead_consolidado_id", k.alias("posicion"),
        F.when(k % 3 == 0, F.lit("2024-01-10")).otherwise("2024-01-09").cast("date")
        .alias("fecha_operativa"))
    return scope.todays_queue(plan, scope.grants(*_scope_inputs(t)), "2024-01-10").select(
        "membresia_id", "lead_consolidado_id", "posicion")


@query("m5_membership", B.sql("""SELECT membresia_id, rol FROM memb WHERE activa AND
    empresa_id = 'EMP-15' AND usuario = 'u0'""", memb=_MEMBERS))
def m5_membership(t: Tables) -> DataFrame:
    members = _scope_inputs(t)[2]
    return scope.active_membership(members, "u0", "EMP-15").select("membresia_id", "rol")


@query("m6_discard_visibility", """SELECT 'asesor' AS rol, count(*) AS chats FROM
        (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 <> 0
    UNION ALL SELECT 'supervisor', count(DISTINCT conv_id) FROM conversations""")
def m6_discard_visibility(t: Tables) -> DataFrame:
    chats = t.conversations.select("conv_id").distinct().withColumn(
        "descartada", F.col("conv_id") % 4 == 0)
    out = []
    for role, everything in (("asesor", False), ("supervisor", True)):
        out.append(scope.usable_chats(chats, everything).agg(
            F.count(F.lit(1)).alias("chats")).select(F.lit(role).alias("rol"), "chats"))
    return out[0].unionByName(out[1])
