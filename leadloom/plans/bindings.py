"""Driver tables seen as the sales domain, in Spark and (``CTES``) as SQL for the checks.

The driver tables are clean, so dates, phones, names and links get fixed, key-derived defects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import ids, signals
from leadloom.operators.ranking import Key, with_positions
from leadloom.plans.registry import Tables


def _lpad(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def company(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("EMP-"), _lpad(c, 2))


def _tag(prefix: str, c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), c.cast("string"))


def sites(t: Tables) -> DataFrame:
    return t.supplier.select(
        _tag("PV-", "s_suppkey").alias("punto_venta_id"),
        company("s_nationkey").alias("empresa_id"),
        F.col("s_name").alias("nombre"),
    )


def advisors(t: Tables) -> DataFrame:
    return t.supplier.select(
        _tag("AS-", "s_suppkey").alias("asesor_id"),
        company("s_nationkey").alias("empresa_id"),
        _tag("PV-", F.floor(F.col("s_suppkey") / 2)).alias("punto_venta_id"),
        F.when(F.col("s_suppkey") % 13 != 0, (F.col("s_suppkey") % 7).cast("bigint"))
        .alias("capacidad"),
        F.when(F.col("s_suppkey") % 17 != 0, F.col("s_acctbal") > 0).alias("activo"),
    )


def catalogue(t: Tables) -> DataFrame:
    return t.part.select(
        _tag("SKU-", "p_partkey").alias("sku"),
        F.col("p_brand").alias("marca"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("linea"),
        F.col("p_retailprice").alias("precio_lista"),
        F.col("p_size").cast("bigint").alias("unidades"),
    )


def availability(t: Tables) -> DataFrame:
    return t.lineitem.select(
        _tag("SKU-", "l_partkey").alias("sku"), _tag("PV-", "l_suppkey").alias("punto_venta_id")
    ).distinct()


def leads(t: Tables) -> DataFrame:
    return t.customer.select(
        _tag("L-", "c_custkey").alias("lead_consolidado_id"),
        company("c_nationkey").alias("empresa_id"),
        F.col("c_name").alias("nombre_presentacion"),
        F.col("c_mktsegment").alias("segmento"),
        F.col("c_custkey"),
    )


def signals_frame(t: Tables) -> DataFrame:
    """One scorable row per order; the customer brings company and payment form."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    seg = F.col("c_mktsegment")
    key = F.col("o_orderkey")
    return joined.select(
        company("c_nationkey").alias("empresa_id"),
        ids.lead_identity(company("c_nationkey"), _tag("pedido:", key)).alias(
            "lead_consolidado_id"),
        key.alias("o_orderkey"),
        F.when(F.col("o_orderstatus") == "P", "DESCONOCIDO")
        .otherwise(_tag("SKU-", key % 100)).alias("modelo_sku"),
        (F.col("o_totalprice") > 300000).alias("inicial_positiva"),
        F.when(seg == "BUILDING", "credito").when(seg == "MACHINERY", "contado")
        .when(seg == "HOUSEHOLD", "mixto").alias("forma_pago"),
        (F.col("o_orderpriority") == "1-URGENT").alias("pidio_cita"),
        F.when(key % 19 != 0, F.col("o_orderdate").cast("date")).alias("fecha"),
        F.when(key % 3 != 0, F.concat(_lpad(key % 24, 2), F.lit(":00:00"))).alias("hora"),
        (key % 11 == 0).alias("todas_descartadas"),
        F.when(key % 7 == 0, "revision_orden").otherwise("sin_conversacion_utilizable")
        .alias("estado_contexto"),
    )


def priorities(t: Tables) -> DataFrame:
    args = ("modelo_sku", "inicial_positiva", "forma_pago", "pidio_cita")
    base = signals_frame(t).withColumn("puntos", signals.points(*args).cast("bigint"))
    base = base.withColumns({
        "score": signals.score(F.col("puntos")),
        "temperatura": signals.temperature(*args[1:]),
    })
    return base.withColumn(
        "cola", signals.queue("temperatura", "todas_descartadas", "estado_contexto"))


def inquiries(t: Tables) -> DataFrame:
    """Orders as received inquiries with dirty names, phones and dates."""
    k = F.col("o_orderkey")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    number = _lpad(F.col("c_custkey") % 400, 9)
    seg = F.initcap(F.lower("c_mktsegment"))
    day = F.col("o_orderdate")
    later = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 5 - 1 as int))")

    def shown(d: Column, pick: Column) -> Column:
        return (
            F.when(pick == 0, F.date_format(d, "dd/MM/yyyy"))
            .when(pick == 1, F.date_format(d, "MM/dd/yyyy"))
            .when(pick == 2, F.date_format(d, "yyyy-MM-dd"))
            .when(pick == 3, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:30:00")))
            .when(pick == 4, F.date_format(d, "dd-MM-yyyy"))
            .otherwise("")
        )

    return joined.select(
        k.alias("fila"),
        _tag("C-", k).alias("lead_id"),
        company("c_nationkey").alias("empresa_id"),
        _tag("L-", "c_custkey").alias("lead_consolidado_id"),
        F.when(k % 4 == 0, F.concat(F.lit("José "), seg, F.lit(" Pérez")))
        .when(k % 4 == 1, "  JOSE   perez ")
        .when((k % 4 == 2) & (F.col("c_custkey") % 3 == 0), "J. Pérez")
        .when((k % 4 == 2) & (F.col("c_custkey") % 3 == 1), "Ana Pérez")
        .otherwise("José Pérez")
        .alias("nombre_cliente"),
        F.when(k % 6 == 0, F.concat(F.lit("+57 3"), number))
        .when(k % 6 == 1, F.concat(F.lit("(3"), F.substring(number, 1, 2), F.lit(") "),
                                   F.substring(number, 3, 7)))
        .when(k % 6 == 2, F.concat(F.lit("3"), number))
        .when(k % 6 == 3, F.concat(F.lit("4"), number))
        .when(k % 6 == 4, "prueba")
        .alias("telefono"),
        F.when(k % 9 == 0, F.concat(F.lit("Cliente"), (F.col("c_custkey") % 50).cast("string"),
                                    F.lit("@Correo.CO")))
        .when(k % 9 == 1, "sin correo")
        .alias("email"),
        shown(day, k % 6).alias("fecha_registro"),
        shown(later, F.floor(k / 6) % 6).alias("fecha_primer_contacto"),
        F.when(k % 5 == 0, "DESCARTADO").when(k % 5 == 1, " sin  gestion ")
        .when(k % 5 == 2, "raro").when(k % 5 == 3, "Contactado").alias("estado_gestion"),
        F.when(k % 8 == 0, "BOGOTA D.C.").when(k % 8 == 1, "medellin").when(k % 8 == 2, "Quito")
        .when(k % 8 == 3, "itagui").alias("ciudad"),
        F.when(k % 3 == 0, "meta ads").when(k % 3 == 1, "WHATSAPP").otherwise("fax").alias("canal"),
        F.col("o_totalprice"),
        F.col("o_orderdate"),
        F.col("c_custkey"),
    )


FIRST_NAMES = ["José", "J.", "Ana", "María José", "A.", "jose", "Ana  Lucía"]
LAST_NAMES = ["Pérez", "Gómez Pérez", "Pérez Ruiz", "P.", "perez", "Ruiz"]


def mixed_name(number: Column) -> Column:
    """One of many names, alike in parts."""
    first = F.element_at(F.array(*[F.lit(x) for x in FIRST_NAMES]), (number % 7 + 1).cast("int"))
    last = F.element_at(F.array(*[F.lit(x) for x in LAST_NAMES]), (F.floor(number / 7) % 6 + 1).cast("int"))
    return F.concat_ws(" ", first, last)


def mixed_name_sql(number: str) -> str:
    """The folded words of the same name, without dots."""
    name = f"{FIRST_NAMES}[{number} % 7 + 1] || ' ' || {LAST_NAMES}[({number} // 7) % 6 + 1]"
    return ("list_transform(string_split(regexp_replace(lower(strip_accents(" + name + ")), ' +', ' ', 'g'), ' '), "
            "lambda x: trim(x, '.'))")


def names_agree_sql(a: str, b: str) -> str:
    """The comparison rule over two lists of words, the shorter first."""
    full = "len(list_filter({}, lambda x: length(x) < 2)) = 0"
    shorter = (f"(len({a}) < len({b}) OR (len({a}) = len({b}) AND length(array_to_string({a}, '')) <= "
               f"length(array_to_string({b}, ''))))")
    s, m = f"(CASE WHEN {shorter} THEN {a} ELSE {b} END)", f"(CASE WHEN {shorter} THEN {b} ELSE {a} END)"
    pattern = f"' ' || array_to_string({s}[2:], ' (.* )?') || ' '"
    ordered = (f"{full.format(m)} AND {full.format(s + '[2:]')} AND ({s}[1] = {m}[1] OR (length({s}[1]) = 1 AND "
               f"starts_with({m}[1], {s}[1]))) AND regexp_matches(' ' || array_to_string({m}[2:], ' ') || ' ', {pattern})")
    return (f"(len({a}) >= 2 AND len({b}) >= 2 AND CASE WHEN {a} = {b} THEN {full.format(a)} "
            f"ELSE {ordered} END)")


MESSAGE_SUFFIX = [
    "Tengo 2 millones de inicial",
    "Con esa inicial la cuota le queda en 300 mil a 36 meses",
    "De contado, ya tengo la plata lista, 8 millones",
    "Le puedo dejar el estudio de crédito",
    "Quiero algo más económico",
    "Cuesta $ 7.290.000",
    "Pago a crédito",
    "Cuesta $9.500.000",
    "Corrijo: tengo 3 millones de inicial",
]


def messages(t: Tables) -> DataFrame:
    """Chat turns as client/advisor messages, with one domain sentence after the whole text."""
    base = t.conversations.where(F.col("role") != "system")
    base = with_positions(
        base, ["conv_id"], [Key("turn")], [Key(F.floor(F.col("turn") / 4096))], out="posicion")
    pick = (F.col("conv_id") * 5 + F.col("turn") * 4) % 9
    suffix = F.element_at(F.array(*[F.lit(s) for s in MESSAGE_SUFFIX]), (pick + 1).cast("int"))
    return base.select(
        F.concat(F.lit("CONV-"), _lpad(F.col("conv_id"), 6)).alias("conversacion_id"),
        F.col("conv_id"),
        F.col("posicion"),
        F.when(F.col("role") == "user", "cliente").otherwise("asesor").alias("emisor"),
        F.concat_ws(" ", "text", suffix).alias("texto"),
    )


def activities(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select(
        F.col("event_id"),
        company("c_nationkey").alias("empresa_id"),
        _tag("L-", "user_id").alias("lead_consolidado_id"),
        F.when(kind == "view", "sin_respuesta").when(kind == "click", "contactado")
        .when(kind == "signup", "seguimiento_programado").when(kind == "purchase", "cerrado")
        .when(kind == "error", "perdido").alias("resultado"),
        F.col("ts"),
        F.col("value"),
    )


def history(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.concat_ws("-", F.lit("H"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("lead_id"),
        _tag("EMP-", F.col("l_suppkey") % 5).alias("empresa_id"),
        F.col("l_shipdate").cast("date").alias("fecha"),
        F.when(flag == "R", "Cerrado").when(flag == "A", "Perdido").otherwise("Sin gestión")
        .alias("desenlace"),
        F.when(F.col("l_linestatus") == "F", "WhatsApp").otherwise("Meta Ads").alias("canal"),
        F.when(F.col("l_partkey") % 6 != 0, _tag("SKU-", F.col("l_partkey") % 24)).alias(
            "modelo_sku"),
        F.when(F.col("l_quantity") > 40, "SI").when(F.col("l_quantity") < 10, "NO").alias(
            "manifesto_cuota_inicial"),
        F.when(F.col("l_discount") > 0.07, "credito").when(F.col("l_discount") < 0.03, "contado")
        .otherwise("no_informa").alias("forma_pago_declarada"),
        F.when(F.col("l_tax") >= 0.06, "SI").otherwise("NO").alias("pidio_cita"),
    )


def scored_labels(t: Tables) -> DataFrame:
    """Observed label, a fixed score of the document and its group."""
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id",
        F.col("quality").cast("bigint").alias("y"),
        ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"),
        F.col("lang").alias("grupo"),
        F.col("n_chars"),
    )


def _company_sql(c: str) -> str:
    return f"'EMP-' || lpad(CAST({c} AS VARCHAR), 2, '0')"


def _shown_sql(d: str, pick: str) -> str:
    return f"""CASE {pick} WHEN 0 THEN strftime({d}, '%d/%m/%Y')
        WHEN 1 THEN strftime({d}, '%m/%d/%Y') WHEN 2 THEN strftime({d}, '%Y-%m-%d')
        WHEN 3 THEN strftime({d}, '%Y-%m-%d') || ' 10:30:00'
        WHEN 4 THEN strftime({d}, '%d-%m-%Y') ELSE '' END"""


CTES = {
    "sites": f"""SELECT 'PV-' || s_suppkey AS punto_venta_id,
        {_company_sql('s_nationkey')} AS empresa_id, s_name AS nombre FROM supplier""",
    "advisors": f"""SELECT 'AS-' || s_suppkey AS asesor_id,
        {_company_sql('s_nationkey')} AS empresa_id,
        'PV-' || (s_suppkey // 2) AS punto_venta_id,
        CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 7 END AS capacidad,
        CASE WHEN s_suppkey % 17 <> 0 THEN s_acctbal > 0 END AS activo FROM supplier""",
    "catalogue": """SELECT 'SKU-' || p_partkey AS sku, p_brand AS marca,
        p_name || ' ' || p_size AS linea, p_retailprice AS precio_lista,
        CAST(p_size AS BIGINT) AS unidades FROM part""",
    "availability": """SELECT DISTINCT 'SKU-' || l_partkey AS sku,
        'PV-' || l_suppkey AS punto_venta_id FROM lineitem""",
    "leads": f"""SELECT 'L-' || c_custkey AS lead_consolidado_id,
        {_company_sql('c_nationkey')} AS empresa_id, c_name AS nombre_presentacion,
        c_mktsegment AS segmento, c_custkey FROM customer""",
    "signals_frame": f"""SELECT {_company_sql('c_nationkey')} AS empresa_id,
        'LC-' || substr(sha256('["' || {_company_sql('c_nationkey')} || '", "pedido:' ||
            o_orderkey || '"]'), 1, 20) AS lead_consolidado_id,
        o_orderkey,
        CASE WHEN o_orderstatus = 'P' THEN 'DESCONOCIDO' ELSE 'SKU-' || (o_orderkey % 100) END
            AS modelo_sku,
        o_totalprice > 300000 AS inicial_positiva,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'credito' WHEN 'MACHINERY' THEN 'contado'
            WHEN 'HOUSEHOLD' THEN 'mixto' END AS forma_pago,
        o_orderpriority = '1-URGENT' AS pidio_cita,
        CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS fecha,
        CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0')
            || ':00:00' END AS hora,
        o_orderkey % 11 = 0 AS todas_descartadas,
        CASE WHEN o_orderkey % 7 = 0 THEN 'revision_orden'
            ELSE 'sin_conversacion_utilizable' END AS estado_contexto
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "points": """SELECT *, CAST(
        CASE WHEN modelo_sku <> 'DESCONOCIDO' THEN 10 ELSE 0 END
        + CASE WHEN inicial_positiva THEN 30 ELSE 0 END
        + CASE WHEN forma_pago IN ('credito', 'contado') THEN 10 ELSE 0 END
        + CASE WHEN pidio_cita THEN 40 ELSE 0 END AS BIGINT) AS puntos FROM signals_frame""",
    "temps": """SELECT *, CAST(round(CAST(puntos * 100 AS DECIMAL(18, 8)) / 90, 2)
            AS DECIMAL(18, 2)) AS score,
        CASE WHEN pidio_cita THEN 'caliente'
            WHEN inicial_positiva OR forma_pago IN ('credito', 'contado') THEN 'tibio'
            ELSE 'sin_informacion_suficiente' END AS temperatura FROM points""",
    "priorities": """SELECT *, CASE WHEN todas_descartadas THEN 'revision_descartado_crm'
        WHEN estado_contexto = 'revision_orden' THEN 'revision_datos'
        WHEN temperatura = 'sin_informacion_suficiente'
            THEN 'primer_contacto_o_ampliar_informacion'
        ELSE 'seguimiento_comercial' END AS cola FROM temps""",
    "inquiries": f"""SELECT o_orderkey AS fila, 'C-' || o_orderkey AS lead_id,
        {_company_sql('c_nationkey')} AS empresa_id,
        'L-' || c_custkey AS lead_consolidado_id,
        CASE WHEN o_orderkey % 4 = 0 THEN 'José ' || upper(c_mktsegment[1]) ||
                lower(c_mktsegment[2:]) || ' Pérez'
            WHEN o_orderkey % 4 = 1 THEN '  JOSE   perez '
            WHEN o_orderkey % 4 = 2 AND c_custkey % 3 = 0 THEN 'J. Pérez'
            WHEN o_orderkey % 4 = 2 AND c_custkey % 3 = 1 THEN 'Ana Pérez'
            ELSE 'José Pérez' END AS nombre_cliente,
        CASE o_orderkey % 6 WHEN 0 THEN '+57 3' || lpad(CAST(c_custkey % 400 AS VARCHAR), 9, '0')
            WHEN 1 THEN '(3' || substr(lpad(CAST(c_custkey % 400 AS VARCHAR), 9, '0'), 1, 2)
                || ') ' || substr(lpad(CAST(c_custkey % 400 AS VARCHAR), 9, '0'), 3, 7)
            WHEN 2 THEN '3' || lpad(CAST(c_custkey % 400 AS VARCHAR), 9, '0')
            WHEN 3 THEN '4' || lpad(CAST(c_custkey % 400 AS VARCHAR), 9, '0')
            WHEN 4 THEN 'prueba' END AS telefono,
        CASE o_orderkey % 9 WHEN 0 THEN 'Cliente' || (c_custkey % 50) || '@Correo.CO'
            WHEN 1 THEN 'sin correo' END AS email,
        {_shown_sql('o_orderdate', 'o_orderkey % 6')} AS fecha_registro,
        {_shown_sql('(o_orderdate + to_days(CAST(o_orderkey % 5 - 1 AS INTEGER)))',
                    '(o_orderkey // 6) % 6')} AS fecha_primer_contacto,
        CASE o_orderkey % 5 WHEN 0 THEN 'DESCARTADO' WHEN 1 THEN ' sin  gestion '
            WHEN 2 THEN 'raro' WHEN 3 THEN 'Contactado' END AS estado_gestion,
        CASE o_orderkey % 8 WHEN 0 THEN 'BOGOTA D.C.' WHEN 1 THEN 'medellin' WHEN 2 THEN 'Quito'
            WHEN 3 THEN 'itagui' END AS ciudad,
        CASE o_orderkey % 3 WHEN 0 THEN 'meta ads' WHEN 1 THEN 'WHATSAPP' ELSE 'fax' END AS canal,
        o_totalprice, o_orderdate, c_custkey
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "messages": """SELECT 'CONV-' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS conversacion_id,
        conv_id,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS posicion,
        CASE WHEN role = 'user' THEN 'cliente' ELSE 'asesor' END AS emisor,
        text || ' ' || ([""" + ", ".join(f"'{s}'" for s in MESSAGE_SUFFIX) + """])[
            CAST((conv_id * 5 + turn * 4) % 9 + 1 AS INTEGER)] AS texto
        FROM conversations WHERE role <> 'system'""",
    "activities": f"""SELECT event_id, {_company_sql('c_nationkey')} AS empresa_id,
        'L-' || user_id AS lead_consolidado_id,
        CASE event_type WHEN 'view' THEN 'sin_respuesta' WHEN 'click' THEN 'contactado'
            WHEN 'signup' THEN 'seguimiento_programado' WHEN 'purchase' THEN 'cerrado'
            WHEN 'error' THEN 'perdido' END AS resultado, ts, value
        FROM events JOIN customer ON user_id = c_custkey""",
    "history": """SELECT concat_ws('-', 'H', l_orderkey, l_linenumber, l_partkey, l_suppkey)
            AS lead_id,
        'EMP-' || (l_suppkey % 5) AS empresa_id, CAST(l_shipdate AS DATE) AS fecha,
        CASE l_returnflag WHEN 'R' THEN 'Cerrado' WHEN 'A' THEN 'Perdido' ELSE 'Sin gestión' END
            AS desenlace,
        CASE WHEN l_linestatus = 'F' THEN 'WhatsApp' ELSE 'Meta Ads' END AS canal,
        CASE WHEN l_partkey % 6 <> 0 THEN 'SKU-' || (l_partkey % 24) END AS modelo_sku,
        CASE WHEN l_quantity > 40 THEN 'SI' WHEN l_quantity < 10 THEN 'NO' END
            AS manifesto_cuota_inicial,
        CASE WHEN l_discount > 0.07 THEN 'credito' WHEN l_discount < 0.03 THEN 'contado'
            ELSE 'no_informa' END AS forma_pago_declarada,
        CASE WHEN l_tax >= 0.06 THEN 'SI' ELSE 'NO' END AS pidio_cita FROM lineitem""",
    "scored_labels": """SELECT l.doc_id, CAST(quality AS BIGINT) AS y,
        (n_chars % 97) / 97.0::DOUBLE AS score, lang AS grupo, n_chars
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}
_NEEDS = {
    "points": ["signals_frame"],
    "temps": ["points"],
    "priorities": ["temps"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``WITH`` the named domain frames (and their parents) put in front of ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for parent in _NEEDS.get(name, []):
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({s})" for n, s in extra.items()]
    if not parts:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body.lstrip()[5:]}"
    return f"WITH {', '.join(parts)} {body}"
