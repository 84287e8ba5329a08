"""Value-level queries: text, phones, categories, numbers, dates, money, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions import dates, ids, money, names, numbers, text
from leadloom.operators import catalog, identity, intake
from leadloom.operators.ranking import attach_single
from leadloom.plans import bindings as B
from leadloom.plans.registry import Tables, query

_CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_FOLD = "replace(strip_accents(lower({0})), 'ß', 'ss')"


def _clean(c: str) -> str:
    return f"nullif({_CLEAN.format(c)}, '')"


def _fold(c: str) -> str:
    return _FOLD.format(_clean(c))


@query("b1_clean", f"""SELECT doc_id, md5({_clean('text')}) AS limpio,
    CAST(length({_clean('text')}) AS BIGINT) AS largo FROM documents""")
def b1_clean(t: Tables) -> DataFrame:
    c = text.clean("text")
    return t.documents.select(
        "doc_id", F.md5(c).alias("limpio"), F.length(c).cast("bigint").alias("largo"))


@query("b2_key", f"SELECT doc_id, md5({_fold('text')}) AS clave FROM documents")
def b2_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.fold_key("text")).alias("clave"))


@query("b3_ascii", """SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)),
    '[^\\x00-\\x7F]', '', 'g')) AS ascii FROM documents""")
def b3_ascii(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.ascii_fold("text")).alias("ascii"))


@query("b4_mention_key", """SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)),
    '[^a-z0-9]', '', 'g')) AS clave FROM documents""")
def b4_mention_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.alnum_key("text")).alias("clave"))


@query("b5_text_columns", B.sql(f"""SELECT fila, upper({_clean('lead_id')}) AS lead_id_normalizado,
    upper({_clean('empresa_id')}) AS empresa_id_normalizado,
    {_clean('nombre_cliente')} AS nombre_cliente_normalizado,
    lower({_clean('email')}) AS email_normalizado, {_clean('ciudad')} AS ciudad_normalizado
    FROM inquiries""", "inquiries"))
def b5_text_columns(t: Tables) -> DataFrame:
    out = text.normalize_text_columns(
        B.inquiries(t).select("fila", "lead_id", "empresa_id", "nombre_cliente", "email", "ciudad"))
    return out.select("fila", *[c for c in out.columns if c.endswith("_normalizado")])


_MODEL_TEXT_SQL = """CASE p_partkey % 5 WHEN 0 THEN 'HNDA ' || p_name || ' 2024'
    WHEN 1 THEN ' A.K.T  ' || upper(p_name) WHEN 2 THEN 'Suzuky ' || p_name
    WHEN 3 THEN p_brand || ' ' || p_name || '  2019' ELSE 'Bájai ' || p_name END"""


def _model_text():
    k = F.col("p_partkey") % 5
    return (
        F.when(k == 0, F.concat_ws(" ", F.lit("HNDA"), "p_name", F.lit("2024")))
        .when(k == 1, F.concat(F.lit(" A.K.T  "), F.upper("p_name")))
        .when(k == 2, F.concat_ws(" ", F.lit("Suzuky"), "p_name"))
        .when(k == 3, F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit("  2019")))
        .otherwise(F.concat_ws(" ", F.lit("Bájai"), "p_name"))
    )


def _model_key_sql(c: str) -> str:
    out = f"regexp_replace({_fold(c)}, '^a\\.k\\.t\\b', 'akt')"
    for a, b in V.BRAND_TYPOS.items():
        out = f"regexp_replace({out}, '^{a}\\b', '{b}')"
    return f"trim(regexp_replace({out}, '\\s+20\\d{{2}}$', ''))"


@query("b6_model_key",
       f"SELECT p_partkey, {_model_key_sql(_MODEL_TEXT_SQL)} AS clave FROM part")
def b6_model_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.model_key(_model_text()).alias("clave"))


_PHONE_CTE = f"""SELECT *, {_clean('telefono')} AS tt,
    regexp_replace({_clean('telefono')}, '\\D', '', 'g') AS dd FROM inquiries"""
_PHONE_LOCAL = """SELECT *, CASE WHEN length(dd) = 12 AND dd LIKE '57%' THEN substr(dd, 3)
    ELSE dd END AS local FROM p0"""
_PHONE_STATE = """SELECT *, CASE WHEN tt IS NULL THEN 'faltante'
    WHEN NOT regexp_full_match(tt, '\\+?[0-9\\s().-]+') THEN 'caracteres_no_permitidos'
    WHEN length(local) <> 10 THEN 'longitud_invalida'
    WHEN local NOT LIKE '3%' THEN 'revisar_prefijo_movil' ELSE 'valido' END AS telefono_estado
    FROM p1"""
PHONES = {"p0": _PHONE_CTE, "p1": _PHONE_LOCAL, "phones": _PHONE_STATE}


@query("b7_phone", B.sql("""SELECT fila, telefono_estado,
    CASE WHEN telefono_estado = 'valido' THEN '+57' || local END AS telefono_normalizado
    FROM phones""", "inquiries", **PHONES))
def b7_phone(t: Tables) -> DataFrame:
    p = text.phone("telefono")
    return B.inquiries(t).select(
        "fila", p["estado"].alias("telefono_estado"), p["valor"].alias("telefono_normalizado"))


def _category_sql(c: str, domain: str) -> tuple[str, str]:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.CATEGORIES[domain].items())
    value = f"CASE {_fold(c)} {cases} END"
    return value, (f"CASE WHEN {_fold(c)} IS NULL THEN 'faltante' WHEN {value} IS NULL THEN "
                   "'no_reconocido' ELSE 'valido' END")


_CATS = [("ciudad", "ciudad"), ("estado_gestion", "estado_gestion"), ("canal", "canal")]


@query("b8_category", B.sql("SELECT fila, " + ", ".join(
    f"{_category_sql(c, d)[0]} AS {c}_normalizado, {_category_sql(c, d)[1]} AS {c}_estado"
    for c, d in _CATS) + " FROM inquiries", "inquiries"))
def b8_category(t: Tables) -> DataFrame:
    out = []
    for c, domain in _CATS:
        s = text.category(c, domain)
        out += [s["valor"].alias(f"{c}_normalizado"), s["estado"].alias(f"{c}_estado")]
    return B.inquiries(t).select("fila", *out)


@query("b9_email", B.sql(f"""SELECT fila, CASE WHEN regexp_full_match({_clean('email')},
    '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN lower({_clean('email')}) END AS correo
    FROM inquiries""", "inquiries"))
def b9_email(t: Tables) -> DataFrame:
    return B.inquiries(t).select("fila", text.email("email").alias("correo"))


_NUMBER_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN 'inf'
    WHEN 3 THEN '-' || o_custkey WHEN 4 THEN '0' WHEN 5 THEN o_custkey || '.5'
    WHEN 6 THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || '.0' END"""


def _number_text():
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    return (
        F.when(k == 0, "").when(k == 1, "abc").when(k == 2, "inf")
        .when(k == 3, F.concat(F.lit("-"), c)).when(k == 4, "0")
        .when(k == 5, F.concat(c, F.lit(".5"))).when(k == 6, c).otherwise(F.concat(c, F.lit(".0")))
    )


@query("b10_number_state", f"""WITH s AS (SELECT o_orderkey, {_NUMBER_TEXT} AS x FROM orders),
    n AS (SELECT *, TRY_CAST(nullif(nullif(x, ''), 'inf') AS DOUBLE) AS v FROM s),
    e AS (SELECT *, CASE WHEN x = '' THEN 'faltante' WHEN x = 'inf' THEN 'no_finito'
        WHEN v IS NULL THEN 'no_numerico' WHEN v < 0 THEN 'negativo'
        WHEN v = 0 THEN 'cero_no_permitido' WHEN v % 1 <> 0 THEN 'debe_ser_entero'
        ELSE 'valido' END AS estado FROM n)
    SELECT o_orderkey, estado, CASE WHEN estado = 'valido' THEN v END AS valor FROM e""")
def b10_number_state(t: Tables) -> DataFrame:
    n = numbers.checked_number(_number_text(), integer=True, zero_allowed=False)
    return t.orders.select("o_orderkey", n["estado"].alias("estado"), n["valor"].alias("valor"))


@query("b11_decimal", f"""WITH s AS (SELECT o_orderkey, nullif({_NUMBER_TEXT}, '') AS x FROM orders)
    SELECT o_orderkey, CAST(TRY_CAST(nullif(x, 'inf') AS DECIMAL(38, 6)) AS DOUBLE) AS valor,
    CASE WHEN x IS NOT NULL AND TRY_CAST(nullif(x, 'inf') AS DECIMAL(38, 6)) IS NULL
        THEN 'numero_invalido' END AS violacion FROM s""")
def b11_decimal(t: Tables) -> DataFrame:
    n = numbers.strict_decimal(_number_text())
    return t.orders.select(
        "o_orderkey", n["valor"].cast("double").alias("valor"), n["violacion"].alias("violacion"))


@query("b12_integer", f"""WITH s AS (SELECT o_orderkey, nullif({_NUMBER_TEXT}, '') AS x FROM orders),
    d AS (SELECT *, TRY_CAST(nullif(x, 'inf') AS DECIMAL(38, 6)) AS v FROM s)
    SELECT o_orderkey, CASE WHEN v = floor(v) THEN CAST(v AS BIGINT) END AS valor,
    CASE WHEN x IS NOT NULL AND v IS NULL THEN 'numero_invalido'
        WHEN v <> floor(v) THEN 'entero_con_fraccion' END AS violacion FROM d""")
def b12_integer(t: Tables) -> DataFrame:
    n = numbers.strict_integer(_number_text())
    return t.orders.select("o_orderkey", n["valor"].alias("valor"), n["violacion"].alias("violacion"))


_BOOL_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN 'SI' WHEN 1 THEN 'no' WHEN 2 THEN 'True'
    WHEN 3 THEN 'FALSE' WHEN 4 THEN '' ELSE 'tal vez' END"""


@query("b13_boolean", f"""WITH s AS (SELECT o_orderkey, {_BOOL_TEXT} AS x FROM orders)
    SELECT o_orderkey, CASE WHEN lower(x) IN ('si', 'true') THEN true
        WHEN lower(x) IN ('no', 'false') THEN false END AS valor,
    CASE WHEN x = 'tal vez' THEN 'booleano_invalido' END AS violacion FROM s""")
def b13_boolean(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    x = (F.when(k == 0, "SI").when(k == 1, "no").when(k == 2, "True").when(k == 3, "FALSE")
         .when(k == 4, "").otherwise("tal vez"))
    b = numbers.strict_boolean(x)
    return t.orders.select("o_orderkey", b["valor"].alias("valor"), b["violacion"].alias("violacion"))


@query("b14_blank", B.sql("SELECT fila, nullif(fecha_registro, '') AS fecha FROM inquiries",
                          "inquiries"))
def b14_blank(t: Tables) -> DataFrame:
    return B.inquiries(t).select("fila", numbers.blank_to_null("fecha_registro").alias("fecha"))


def _parse_sql(c: str, order: str) -> str:
    """Date of a text in one of the five shapes the bindings produce."""
    last = "'%d/%m/%Y'" if order == "DMY" else "'%m/%d/%Y'"
    return (f"CASE WHEN {c} LIKE '____-__-__' THEN try_strptime({c}, '%Y-%m-%d') "
            f"WHEN {c} LIKE '____-__-__ %' THEN try_strptime({c}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE try_strptime(replace({c}, '-', '/'), {last}) END")


def _precision_sql(c: str) -> str:
    return (f"CASE WHEN {c} = '' THEN NULL WHEN length({c}) > 10 THEN 'fecha_hora' "
            "ELSE 'fecha' END")


@query("b15_date", B.sql(f"""SELECT fila,
    strftime({_parse_sql('fecha_registro', 'DMY')}, '%Y-%m-%d %H:%M:%S') AS valor,
    CASE WHEN fecha_registro = '' THEN 'faltante'
        WHEN {_parse_sql('fecha_registro', 'DMY')} IS NULL THEN 'invalida' ELSE 'valida' END
        AS estado,
    {_precision_sql('fecha_registro')} AS precision FROM inquiries""", "inquiries"))
def b15_date(t: Tables) -> DataFrame:
    d = dates.parse_date("fecha_registro")
    return B.inquiries(t).select(
        "fila", dates.date_text(d["valor"]).alias("valor"), d["estado"].alias("estado"),
        d["precision"].alias("precision"))


def _part_sql(c: str, g: int) -> str:
    return (f"TRY_CAST(regexp_extract({c}, '^(\\d{{1,2}})[-/](\\d{{1,2}})[-/]\\d{{4}}(?:\\D|$)', "
            f"{g}) AS INTEGER)")


def _evidence_sql(c: str) -> str:
    a, b = _part_sql(c, 1), _part_sql(c, 2)
    return (f"CASE WHEN {a} BETWEEN 1 AND 12 AND {b} BETWEEN 13 AND 31 THEN 'MDY' "
            f"WHEN {a} BETWEEN 13 AND 31 AND {b} BETWEEN 1 AND 12 THEN 'DMY' END")


@query("b16_order_evidence", B.sql(
    f"SELECT fila, {_evidence_sql('fecha_registro')} AS orden FROM inquiries", "inquiries"))
def b16_order_evidence(t: Tables) -> DataFrame:
    return B.inquiries(t).select("fila", dates.order_evidence("fecha_registro").alias("orden"))


def _sequence_sql(a: str, pa: str, b: str, pb: str) -> str:
    return (f"CASE WHEN {pa} = 'fecha' OR {pb} = 'fecha' "
            f"THEN CAST({a} AS DATE) <= CAST({b} AS DATE) ELSE {a} <= {b} END")


_DATES_CTE = f"""SELECT fila, lead_id, empresa_id, lead_consolidado_id, fecha_registro AS a,
    fecha_primer_contacto AS b,
    {_evidence_sql('fecha_registro')} AS ea, {_evidence_sql('fecha_primer_contacto')} AS eb,
    {_parse_sql('fecha_registro', 'DMY')} AS ad, {_parse_sql('fecha_registro', 'MDY')} AS am,
    {_parse_sql('fecha_primer_contacto', 'DMY')} AS bd,
    {_parse_sql('fecha_primer_contacto', 'MDY')} AS bm,
    {_precision_sql('fecha_registro')} AS pa, {_precision_sql('fecha_primer_contacto')} AS pb,
    coalesce({_part_sql('fecha_registro', 1)} BETWEEN 1 AND 12
        AND {_part_sql('fecha_registro', 2)} BETWEEN 1 AND 12, false) AS xa,
    coalesce({_part_sql('fecha_primer_contacto', 1)} BETWEEN 1 AND 12
        AND {_part_sql('fecha_primer_contacto', 2)} BETWEEN 1 AND 12, false) AS xb
    FROM inquiries"""
_DATES_BASE = """SELECT *, CASE WHEN ea IS DISTINCT FROM eb AND ea IS NOT NULL AND eb IS NOT NULL
        THEN 'origen_mixto_resuelto_por_valores'
        WHEN ea = 'MDY' OR eb = 'MDY' THEN 'MDY_por_evidencia_del_lead'
        WHEN ea = 'DMY' OR eb = 'DMY' THEN 'DMY_por_evidencia_del_lead'
        ELSE 'DMY_por_defecto' END AS r0,
    CASE WHEN ea IS DISTINCT FROM eb AND ea IS NOT NULL AND eb IS NOT NULL
        THEN CASE WHEN ea = 'MDY' THEN am ELSE ad END
        WHEN ea = 'MDY' OR eb = 'MDY' THEN am ELSE ad END AS a0,
    CASE WHEN ea IS DISTINCT FROM eb AND ea IS NOT NULL AND eb IS NOT NULL
        THEN CASE WHEN eb = 'MDY' THEN bm ELSE bd END
        WHEN ea = 'MDY' OR eb = 'MDY' THEN bm ELSE bd END AS b0 FROM d0"""
_DATES_FLIP = f"""SELECT * EXCLUDE (r0, a0, b0), CASE WHEN flip THEN 'MDY_por_coherencia_del_lead'
        ELSE r0 END AS r1,
    CASE WHEN flip THEN am ELSE a0 END AS a1, CASE WHEN flip THEN bm ELSE b0 END AS b1
    FROM (SELECT *, coalesce(ea IS NULL AND eb IS NULL
        AND NOT {_sequence_sql('a0', 'pa', 'b0', 'pb')}
        AND {_sequence_sql('am', 'pa', 'bm', 'pb')}, false) AS flip FROM d1)"""
_DATES_PAIRS = f"""SELECT fila, list(DISTINCT (va, vb)) AS pairs FROM (
    SELECT fila, pa, pb, unnest(CASE WHEN xa THEN [ad, am] ELSE [a1] END) AS va,
        CASE WHEN xb THEN [bd, bm] ELSE [b1] END AS vbs FROM d2) s, unnest(vbs) AS u(vb)
    WHERE {_sequence_sql('va', 'pa', 'vb', 'pb')} GROUP BY fila"""
_DATES_DONE = f"""SELECT d2.*, coalesce(len(pairs) = 1
        AND NOT {_sequence_sql('a1', 'pa', 'b1', 'pb')}, false) AS combined, pairs
    FROM d2 LEFT JOIN d3 ON d2.fila = d3.fila"""
_DATES_FINAL = """SELECT * EXCLUDE (pairs),
    CASE WHEN combined THEN 'origen_mixto_por_coherencia_unica' ELSE r1 END AS regla,
    CASE WHEN combined THEN pairs[1][1] ELSE a1 END AS registro,
    CASE WHEN combined THEN pairs[1][2] ELSE b1 END AS contacto FROM d4"""
RESOLVED_DATES = {"d0": _DATES_CTE, "d1": _DATES_BASE, "d2": _DATES_FLIP, "d3": _DATES_PAIRS,
                  "d4": _DATES_DONE, "resolved": _DATES_FINAL}


def resolved_dates(t: Tables) -> DataFrame:
    return B.inquiries(t).withColumn(
        "f", dates.resolve_pair("fecha_registro", "fecha_primer_contacto"))


@query("b17_sequence", B.sql(
    f"SELECT fila, {_sequence_sql('ad', 'pa', 'bd', 'pb')} AS posible FROM d0", "inquiries",
    d0=_DATES_CTE))
def b17_sequence(t: Tables) -> DataFrame:
    return B.inquiries(t).select("fila", dates.sequence_possible(
        dates.parse_date("fecha_registro"), dates.parse_date("fecha_primer_contacto"))
        .alias("posible"))


@query("b18_date_order", B.sql("""SELECT fila, regla,
    strftime(registro, '%Y-%m-%d %H:%M:%S') AS registro,
    strftime(contacto, '%Y-%m-%d %H:%M:%S') AS contacto FROM resolved""", "inquiries",
                               **RESOLVED_DATES))
def b18_date_order(t: Tables) -> DataFrame:
    return resolved_dates(t).select(
        "fila", "f.regla", dates.date_text(F.col("f.registro.valor")).alias("registro"),
        dates.date_text(F.col("f.contacto.valor")).alias("contacto"))


@query("b19_sequence_state", B.sql(f"""WITH s AS (SELECT fila, lead_id,
        {_sequence_sql('registro', 'pa', 'contacto', 'pb')} AS ok, registro, contacto, a, b
        FROM resolved)
    SELECT fila, lead_id, CASE WHEN ok IS NULL THEN 'no_evaluable' WHEN ok THEN 'coherente'
        ELSE 'contacto_anterior_registro' END AS estado FROM s""", "inquiries", **RESOLVED_DATES))
def b19_sequence_state(t: Tables) -> DataFrame:
    s = dates.sequence_state(F.col("f.registro"), F.col("f.contacto"))
    return resolved_dates(t).select("fila", "lead_id", s["estado"].alias("estado"))


@query("b20_date_text", B.sql("""SELECT fila, CASE WHEN pa = 'fecha'
    THEN strftime(registro, '%Y-%m-%d') ELSE strftime(registro, '%Y-%m-%d %H:%M:%S') END AS texto
    FROM resolved""", "inquiries", **RESOLVED_DATES))
def b20_date_text(t: Tables) -> DataFrame:
    return resolved_dates(t).select("fila", dates.date_text(
        F.col("f.registro.valor"), F.col("f.registro.precision")).alias("texto"))


_ISO_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00')
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT09:15:00')
    WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '' END"""


@query("b21_date_parts", f"""WITH s AS (SELECT o_orderkey, o_orderdate, {_ISO_TEXT} AS x,
        o_orderkey % 2 = 0 AS dia FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END
        AS fecha,
    CASE WHEN dia THEN NULL WHEN o_orderkey % 5 = 1 THEN '00:00:00'
        WHEN o_orderkey % 5 = 2 THEN '09:15:00' END AS hora,
    CASE WHEN o_orderkey % 5 IN (1, 2) AND NOT dia THEN 'fecha_hora'
        WHEN o_orderkey % 5 < 3 THEN 'fecha' END AS precision,
    CASE WHEN o_orderkey % 5 = 3 THEN 'fecha_incompatible' END AS violacion FROM s""")
def b21_date_parts(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    x = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
         .when(k == 1, F.date_format(d, "yyyy-MM-dd 00:00:00"))
         .when(k == 2, F.date_format(d, "yyyy-MM-dd'T'09:15:00"))
         .when(k == 3, F.date_format(d, "dd/MM/yyyy")).otherwise(""))
    precision = F.when(F.col("o_orderkey") % 2 == 0, "fecha")
    p = dates.date_parts(x, precision)
    return t.orders.select(
        "o_orderkey", p["fecha"].cast("string").alias("fecha"), p["hora"].alias("hora"),
        p["precision"].alias("precision"), p["violacion"].alias("violacion"))


@query("b22_aggregate_precision", B.sql("""WITH x AS (SELECT lead_consolidado_id,
        min(registro) AS primera, max(registro) AS ultima FROM resolved GROUP BY 1)
    SELECT x.lead_consolidado_id, strftime(primera, '%Y-%m-%d') AS primera,
        strftime(ultima, '%Y-%m-%d') AS ultima,
        bool_or(CAST(registro AS DATE) = CAST(primera AS DATE) AND pa = 'fecha') AS primera_es_dia,
        bool_or(CAST(registro AS DATE) = CAST(ultima AS DATE) AND pa = 'fecha') AS ultima_es_dia
    FROM x JOIN resolved r ON x.lead_consolidado_id = r.lead_consolidado_id
    WHERE primera IS NOT NULL AND registro IS NOT NULL GROUP BY ALL""", "inquiries",
                                        **RESOLVED_DATES))
def b22_aggregate_precision(t: Tables) -> DataFrame:
    base = resolved_dates(t).select(
        "lead_consolidado_id", F.col("f.registro.valor").alias("fecha"),
        F.col("f.registro.precision").alias("precision"))
    return intake.date_extremes(base, ["lead_consolidado_id"], "fecha", "precision").select(
        "lead_consolidado_id",
        F.date_format("primera", "yyyy-MM-dd").alias("primera"),
        F.date_format("ultima", "yyyy-MM-dd").alias("ultima"),
        "primera_es_dia", "ultima_es_dia")


_WANTED_SQL = """CASE o_orderkey % 6 WHEN 0 THEN p_brand || ' ' || p_name || ' ' || p_size
    WHEN 1 THEN upper(p_name) || ' ' || p_size WHEN 2 THEN p_brand || ' ' || p_name
    WHEN 3 THEN p_brand WHEN 4 THEN 'zzz ' || p_name END"""
_WANTED_CTES = {
    "wanted": f"""SELECT o_orderkey AS fila, {_WANTED_SQL} AS texto FROM orders
        LEFT JOIN part ON p_partkey = (o_orderkey * 7) % (SELECT count(*) FROM part)""",
    "refs": """SELECT 'SKU-' || p_partkey AS sku, lower(p_brand) AS marca,
        p_brand || ' ' || p_name || ' ' || p_size AS nombre,
        lower(p_brand || ' ' || p_name || ' ' || p_size) AS completo,
        lower(p_name || ' ' || p_size) AS linea FROM part""",
    "keyed": """SELECT fila, lower(texto) AS clave FROM wanted""",
    "keys": """SELECT DISTINCT clave FROM keyed WHERE clave IS NOT NULL""",
    "cands": """SELECT k.clave, r.*, (k.clave = completo OR k.clave = linea) AS exacta
        FROM keys k JOIN refs r ON k.clave = completo OR k.clave = linea
            OR starts_with(completo, k.clave || ' ') OR starts_with(linea, k.clave || ' ')""",
    "decided": """SELECT clave, count(*) AS n, max(sku) AS sku, max(nombre) AS nombre,
        max(marca) AS marca, bool_and(exacta) AS exacta FROM cands c
        WHERE exacta OR NOT EXISTS (SELECT 1 FROM cands e WHERE e.clave = c.clave AND e.exacta)
        GROUP BY clave""",
}


def wanted_models(t: Tables) -> DataFrame:
    """Orders with a free-text wish built from some catalogue row."""
    n = t.part.agg(F.count(F.lit(1)).alias("_n"))
    k = F.col("o_orderkey") % 6
    picked = attach_single(t.orders.select("o_orderkey"), n).withColumn(
        "p_partkey", (F.col("o_orderkey") * 7) % F.col("_n"))
    # the file of a catalogue is far smaller than its rows, so its size would have them broadcast
    return picked.join(t.part.hint("merge"), "p_partkey", "left").select(
        F.col("o_orderkey").alias("fila"),
        F.when(k == 0, F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string")))
        .when(k == 1, F.concat_ws(" ", F.upper("p_name"), F.col("p_size").cast("string")))
        .when(k == 2, F.concat_ws(" ", "p_brand", "p_name"))
        .when(k == 3, F.col("p_brand"))
        .when(k == 4, F.concat_ws(" ", F.lit("zzz"), "p_name"))
        .alias("texto"),
    )


@query("b23_catalog_match", B.sql("""SELECT fila,
    CASE WHEN n = 1 AND d.clave <> d.marca THEN d.sku END AS modelo_sku,
    CASE WHEN k.clave IS NULL THEN 'faltante' WHEN n IS NULL THEN 'sin_coincidencia'
        WHEN n = 1 AND d.clave <> d.marca THEN
            CASE WHEN exacta THEN 'coincidencia_exacta' ELSE 'abreviatura_unica' END
        ELSE 'ambiguo' END AS modelo_estado,
    coalesce(n, 0) AS candidatos FROM keyed k LEFT JOIN decided d ON k.clave = d.clave""",
    **_WANTED_CTES))
def b23_catalog_match(t: Tables) -> DataFrame:
    return catalog.match_models(wanted_models(t), "texto", B.catalogue(t)).select(
        "fila", "modelo_sku", "modelo_estado", "candidatos")


@query("b23_candidates", B.sql("""SELECT DISTINCT c.clave, c.sku, c.nombre FROM keyed k
    JOIN cands c ON k.clave = c.clave WHERE c.exacta OR NOT EXISTS
        (SELECT 1 FROM cands e WHERE e.clave = c.clave AND e.exacta)""", **_WANTED_CTES))
def b23_candidates(t: Tables) -> DataFrame:
    return catalog.candidates_by_key(wanted_models(t), "texto", B.catalogue(t))


@query("b24_names_compatible", B.sql(f"""WITH w AS (SELECT fila, {B.mixed_name_sql('fila')} AS a,
        {B.mixed_name_sql('(fila * 5 + 3)')} AS b FROM inquiries)
    SELECT fila, {B.names_agree_sql('a', 'b')} AS compatible FROM w""", "inquiries"))
def b24_names_compatible(t: Tables) -> DataFrame:
    k = F.col("fila")
    return B.inquiries(t).select("fila", names.names_compatible(
        B.mixed_name(k), B.mixed_name(k * 5 + 3)).alias("compatible"))


@query("b25_full_name", B.sql(f"""SELECT fila, len(string_split({_fold('nombre_cliente')}, ' ')) >= 2
    AND len(list_filter(string_split({_fold('nombre_cliente')}, ' '),
        lambda x: length(trim(x, '.')) <= 1)) = 0 AS completo FROM inquiries""", "inquiries"))
def b25_full_name(t: Tables) -> DataFrame:
    return B.inquiries(t).select("fila", names.is_full_name("nombre_cliente").alias("completo"))


@query("b26_best_name", B.sql(f"""WITH n AS (SELECT DISTINCT lead_consolidado_id,
        {_clean('nombre_cliente')} AS nombre FROM inquiries),
    r AS (SELECT *, row_number() OVER (PARTITION BY lead_consolidado_id ORDER BY
        len(list_filter(string_split(nombre, ' '), lambda x: length(trim(x, '.')) > 1)) DESC,
        length(nombre) DESC, nombre) AS rn FROM n)
    SELECT lead_consolidado_id, nombre AS nombre_presentacion FROM r WHERE rn = 1""", "inquiries"))
def b26_best_name(t: Tables) -> DataFrame:
    return B.inquiries(t).groupBy("lead_consolidado_id").agg(
        identity.best_name(text.clean("nombre_cliente")).alias("nombre_presentacion"))


@query("b27_identity", B.sql("""SELECT lead_id, 'LC-' || substr(sha256('["' || empresa_id ||
    '", "consulta:' || lead_id || '"]'), 1, 20) AS id FROM inquiries""", "inquiries"))
def b27_identity(t: Tables) -> DataFrame:
    return B.inquiries(t).select("lead_id", ids.lead_identity(
        "empresa_id", F.concat(F.lit("consulta:"), "lead_id")).alias("id"))


@query("b28_row_id", """SELECT conv_id, turn, sha256('["CONV-' || conv_id || '", ' || turn || ']')
    AS mensaje_id FROM conversations""")
def b28_row_id(t: Tables) -> DataFrame:
    conv = F.concat(F.lit("CONV-"), F.col("conv_id").cast("string"))
    return t.conversations.select("conv_id", "turn", ids.stable_id(
        ids.json_string(conv), ids.json_number("turn")).alias("mensaje_id"))


@query("b29_number_text", """SELECT p_partkey, CASE p_partkey % 5
    WHEN 0 THEN p_size * 1000000.0 WHEN 1 THEN p_size * 1000.0
    WHEN 2 THEN p_size * 1000.0 + 500 WHEN 3 THEN (p_size + 0.5) * 1000000.0 END AS valor
    FROM part""")
def b29_number_text(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    number = (F.when(k < 2, s).when(k == 2, F.concat(s, F.lit(".500")))
              .when(k == 3, F.concat(s, F.lit(",5"))).otherwise(F.concat(s, F.lit(",345"))))
    unit = F.when(k == 0, "millones").when(k == 1, "mil").when(k == 3, "palos").otherwise("")
    return t.part.select("p_partkey", money.localized_number(number, unit).alias("valor"))


@query("b30_money", """WITH s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS v, p_partkey % 8 AS k
        FROM part)
    SELECT p_partkey,
    CASE k WHEN 1 THEN v * 1e6 WHEN 2 THEN v * 1e3 WHEN 3 THEN 0 WHEN 4 THEN v * 1e6 + 5e5 END
        AS valor,
    CASE WHEN k = 0 THEN v * 1e6 WHEN k = 5 AND v <= 30 THEN v * 1e3 END AS minimo,
    CASE WHEN k = 0 THEN (v + 5) * 1e6 WHEN k = 5 AND v <= 30 THEN 30e3 END AS maximo,
    CASE WHEN k IN (0, 2, 3, 4) OR (k = 5 AND v <= 30) THEN false WHEN k = 1 THEN true END
        AS aproximado,
    CASE WHEN k = 2 THEN 'COP' END AS moneda,
    CASE WHEN k = 5 AND v > 30 THEN 'Rango invertido'
        WHEN k = 6 THEN 'Dos cantidades sin marcador de rango'
        WHEN k = 7 THEN 'Cantidad negativa o rango no admitido' END AS error FROM s""")
def b30_money(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    more = (F.col("p_size") + 5).cast("string")
    x = (
        F.when(k == 0, F.concat(F.lit("entre "), s, F.lit(" y "), more, F.lit(" millones")))
        .when(k == 1, F.concat(F.lit("Como "), s, F.lit(" millonzitos")))
        .when(k == 2, F.concat(s, F.lit("mil COP")))
        .when(k == 3, "No tengo con qué dar la inicial ahora")
        .when(k == 4, F.concat(s, F.lit(",5 millones")))
        .when(k == 5, F.concat(F.lit("de "), s, F.lit(" a 30 mil")))
        .when(k == 6, F.concat(s, F.lit(" millones "), s, F.lit(" mil")))
        .otherwise(F.concat(F.lit("-"), s))
    )
    m = money.money(x)
    return t.part.withColumn("m", m).select("p_partkey", "m.*")


@query("b31_price", B.sql("""WITH f AS (SELECT conversacion_id, posicion,
        regexp_extract_all(texto, '\\$\\s*(\\d{1,3}(?:\\.\\d{3})+|\\d+)', 1) AS p FROM messages)
    SELECT conversacion_id, posicion, CASE WHEN len(p) = 1
        THEN CAST(replace(p[1], '.', '') AS DOUBLE) END AS precio FROM f""", "messages"))
def b31_price(t: Tables) -> DataFrame:
    return B.messages(t).select("conversacion_id", "posicion",
                                money.listed_price("texto").cast("double").alias("precio"))


_S = "lower(strip_accents(texto))"


@query("b34_keywords", B.sql(f"""SELECT conversacion_id, posicion,
    regexp_matches({_S}, 'credito|financiacion|financiamiento') AS credito,
    contains({_S}, 'contado') AS contado,
    regexp_matches({_S}, 'corrijo|me equivoque|cambie|en realidad|ahora tengo|ya no tengo')
        AS correccion,
    regexp_matches({_S}, 'le puedo dejar el estudio de credito|con esa inicial la cuota le queda .* a \\d+ meses')
        AS oferta FROM messages""", "messages"))
def b34_keywords(t: Tables) -> DataFrame:
    p = V.CHAT_PATTERNS
    return B.messages(t).withColumn("s", text.ascii_fold("texto")).select(
        "conversacion_id", "posicion",
        F.col("s").rlike(p["credit"]).alias("credito"),
        F.col("s").contains(p["cash"]).alias("contado"),
        F.col("s").rlike(p["correction"]).alias("correccion"),
        F.col("s").rlike(p["concrete_offer"]).alias("oferta"))


@query("b35_transcript", B.sql("""SELECT conversacion_id, 0 AS pagina,
    md5(string_agg(posicion || '. ' || emisor || ': ' || texto, chr(10) ORDER BY posicion))
        AS transcripcion FROM messages GROUP BY 1""", "messages"))
def b35_transcript(t: Tables) -> DataFrame:
    pages = intake.transcript_pages(B.messages(t), "conversacion_id")
    return pages.select("conversacion_id", F.col("pagina").cast("int").alias("pagina"),
                        F.md5("transcripcion").alias("transcripcion"))


@query("b36_first_key", B.sql("""SELECT fila, coalesce(nullif(email, ''), nullif(telefono, ''),
    lead_id) AS referencia FROM inquiries""", "inquiries"))
def b36_first_key(t: Tables) -> DataFrame:
    return B.inquiries(t).select(
        "fila", intake.first_informed("email", "telefono", "lead_id").alias("referencia"))


@query("b37_embedded_ids", """WITH e AS (SELECT event_id, '{"conv":"CONV-' ||
        lpad(CAST(user_id % 200 AS VARCHAR), 6, '0') || '","p":' || props || '}' AS j FROM events)
    SELECT DISTINCT event_id, regexp_extract(j, 'CONV-\\d+') AS conversacion_id FROM e
    WHERE regexp_extract(j, 'CONV-\\d+') IN (SELECT 'CONV-' || lpad(CAST(conv_id AS VARCHAR), 6,
        '0') FROM conversations)""")
def b37_embedded_ids(t: Tables) -> DataFrame:
    conv = F.concat(F.lit("CONV-"), F.lpad((F.col("user_id") % 200).cast("string"), 6, "0"))
    log = t.events.select("event_id", conv.alias("nota"), "props")
    known = t.conversations.select(
        F.concat(F.lit("CONV-"), F.lpad(F.col("conv_id").cast("string"), 6, "0"))
        .alias("conversacion_id"))
    return intake.embedded_ids(log, "event_id", r"CONV-\d+", known, "conversacion_id")


@query("b38_map_suffix", B.sql("""SELECT fila, concat_ws(',',
    'ciudad_estado=' || coalesce(ciudad, 'NULO'), 'fecha_criterio=' || fecha_registro) AS calidad
    FROM inquiries""", "inquiries"))
def b38_map_suffix(t: Tables) -> DataFrame:
    m = F.create_map(
        F.lit("ciudad_estado"), F.coalesce("ciudad", F.lit("NULO")),
        F.lit("nombre"), F.col("nombre_cliente"),
        F.lit("fecha_criterio"), F.col("fecha_registro"))
    kept = intake.keep_suffixes(m)
    return B.inquiries(t).select("fila", F.array_join(F.transform(
        F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
        .alias("calidad"))


@query("b39_flag", """SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false
    END AS bandera FROM events""")
def b39_flag(t: Tables) -> DataFrame:
    state = (F.when(F.col("event_type") == "click", "si")
             .when(F.col("event_type") == "view", "no_explicito").otherwise("no_mencionado"))
    return t.events.select("event_id", numbers.state_flag(state).alias("bandera"))


@query("b40_default", B.sql("""SELECT lead_id, coalesce(modelo_sku, 'DESCONOCIDO') AS modelo_sku,
    coalesce(manifesto_cuota_inicial, 'DESCONOCIDO') AS manifesto_cuota_inicial FROM history""",
                            "history"))
def b40_default(t: Tables) -> DataFrame:
    return intake.default_categories(
        B.history(t), ["modelo_sku", "manifesto_cuota_inicial"]).select(
        "lead_id", "modelo_sku", "manifesto_cuota_inicial")


_PREP_SQL = f"""SELECT p.fila, p.lead_id, p.empresa_id, p.telefono AS telefono_original,
    telefono_estado, nombre_cliente, email, ciudad, r.registro, r.contacto,
    {_category_sql('ciudad', 'ciudad')[0]} AS ciudad_n, {_category_sql('canal', 'canal')[0]} AS canal_n,
    {_category_sql('estado_gestion', 'estado_gestion')[0]} AS gestion
    FROM phones p JOIN resolved r ON p.fila = r.fila"""


def prepared_inquiries(t: Tables) -> DataFrame:
    """Inquiries with the normalised fields the identity rules need."""
    p = text.phone("telefono")
    base = resolved_dates(t).withColumn("_p", p)
    return base.select(
        "fila", "lead_id", "empresa_id", F.col("telefono").alias("telefono_original"),
        F.col("_p.valor").alias("telefono"), F.col("_p.estado").alias("telefono_estado"),
        F.when(F.col("fila") % 12 == 3, "prueba").otherwise(F.col("nombre_cliente"))
        .alias("nombre"),
        F.lower(text.clean("email")).alias("email"),
        F.lit(None).cast("string").alias("modelo_interes_texto"),
        text.category("ciudad", "ciudad")["valor"].alias("ciudad"),
        text.category("canal", "canal")["valor"].alias("canal"),
        F.lit(None).cast("string").alias("campania"),
        F.when(F.col("fila") % 12 != 3, F.col("f.registro.valor")).alias("fecha_registro"),
        F.when(F.col("fila") % 12 != 3, F.col("f.contacto.valor")).alias("fecha_primer_contacto"),
        text.category("estado_gestion", "estado_gestion")["valor"].alias("estado_gestion"),
    )


@query("b41_keep_or_exclude", B.sql(f"""WITH u AS (SELECT *, concat_ws(', ',
        CASE WHEN fila % 12 <> 3 THEN 'nombre distinto de un marcador de prueba' END,
        CASE WHEN {_clean('email')} IS NOT NULL THEN 'email_normalizado' END,
        CASE WHEN ciudad_n IS NOT NULL THEN 'ciudad_normalizado' END,
        CASE WHEN canal_n IS NOT NULL THEN 'canal_normalizado' END,
        CASE WHEN fila % 12 <> 3 AND registro IS NOT NULL THEN 'fecha de registro válida' END,
        CASE WHEN fila % 12 <> 3 AND contacto IS NOT NULL THEN 'primer contacto válido' END,
        CASE WHEN gestion <> 'Sin gestión' THEN 'gestión comercial registrada' END,
        CASE WHEN fila % 24 = 3 THEN 'conversación asociada' END) AS utiles
        FROM prep WHERE telefono_estado <> 'valido')
    SELECT fila, telefono_estado, CASE WHEN utiles <> '' THEN 'conservar_con_anotacion'
        ELSE 'excluir_sin_valor_recuperable' END AS decision,
    CASE WHEN utiles <> '' THEN 'Teléfono inválido; conservar porque contiene: ' || utiles || '.'
        ELSE '{V.EXCLUSION_TEXT}' END AS comentario FROM u""", "inquiries", **PHONES,
    **RESOLVED_DATES, prep=_PREP_SQL))
def b41_keep_or_exclude(t: Tables) -> DataFrame:
    chats = B.inquiries(t).where(F.col("fila") % 24 == 3).select("lead_id")
    return identity.phone_exclusions(prepared_inquiries(t), chats).select(
        "fila", "telefono_estado", "decision", "comentario")


@query("b42_intake_rules", B.sql("""WITH r AS (SELECT fila, telefono_estado,
        CASE WHEN fila % 10 = 0 THEN NULL ELSE nombre_cliente END AS nombre,
        email, CASE WHEN fila % 4 = 0 THEN o_totalprice WHEN fila % 4 = 1 THEN -1.0 END AS inicial,
        CASE WHEN fila % 3 = 0 THEN 200000.0 END AS presupuesto,
        CASE WHEN fila % 2 = 0 THEN 'COP' ELSE 'USD' END AS moneda,
        fila % 5 = 0 AS contado, fila % 7 = 0 AS credito FROM phones)
    SELECT fila, concat_ws(',',
        CASE WHEN nombre IS NULL THEN 'nombre_obligatorio' END,
        CASE WHEN email IS NOT NULL AND NOT contains(email, '@') THEN 'correo_invalido' END,
        CASE WHEN telefono_estado <> 'valido' AND (email IS NULL OR NOT contains(email, '@'))
            THEN 'sin_contacto_utilizable' END,
        CASE WHEN inicial < 0 THEN 'cuota_inicial_negativa' END,
        CASE WHEN (inicial IS NOT NULL OR presupuesto IS NOT NULL) AND moneda <> 'COP'
            THEN 'moneda_no_declarada' END,
        CASE WHEN contado AND credito THEN 'contado_y_credito' END,
        CASE WHEN inicial > presupuesto THEN 'inicial_supera_presupuesto' END) AS violaciones
    FROM r""", "inquiries", **PHONES))
def b42_intake_rules(t: Tables) -> DataFrame:
    k = F.col("fila")
    r = B.inquiries(t).select(
        "fila", "empresa_id", "telefono", F.col("email").alias("correo"),
        F.when(k % 10 != 0, F.col("nombre_cliente")).alias("nombre_cliente"),
        F.when(k % 4 == 0, F.col("o_totalprice")).when(k % 4 == 1, -1.0).alias("cuota_inicial"),
        F.when(k % 3 == 0, 200000.0).alias("presupuesto"),
        F.when(k % 2 == 0, "COP").otherwise("USD").alias("moneda"),
        F.when(k % 5 == 0, "contado").alias("forma_pago"),
        (k % 7 == 0).alias("cliente_pidio_credito"))
    return intake.check_intake(r).select(
        "fila", F.array_join("violaciones", ",").alias("violaciones"))


@query("b43_activity_rules", B.sql("""WITH r AS (SELECT event_id, resultado,
        CASE WHEN event_id % 3 = 0 THEN 'motivo' ELSE ' ' END AS nota,
        event_id % 4 = 0 AS confirmar,
        CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 1 DAY WHEN event_id % 5 = 1
            THEN ts - INTERVAL 1 DAY END AS proxima, ts FROM activities)
    SELECT event_id, concat_ws(',',
        CASE WHEN resultado IN ('perdido', 'descartado') AND nota = ' ' THEN 'falta_motivo' END,
        CASE WHEN resultado = 'cerrado' AND NOT confirmar THEN 'cierre_sin_confirmar' END,
        CASE WHEN resultado = 'seguimiento_programado' AND proxima IS NULL
            THEN 'seguimiento_sin_fecha' END,
        CASE WHEN resultado <> 'seguimiento_programado' AND proxima IS NOT NULL
            THEN 'fecha_sin_seguimiento' END,
        CASE WHEN proxima <= ts THEN 'fecha_no_futura' END) AS violaciones FROM r""",
                                  "activities"))
def b43_activity_rules(t: Tables) -> DataFrame:
    k = F.col("event_id")
    r = B.activities(t).select(
        "event_id", "resultado", F.when(k % 3 == 0, "motivo").otherwise(" ").alias("nota"),
        (k % 4 == 0).alias("confirmar_cierre"), k.cast("string").alias("clave"),
        F.when(k % 5 == 0, F.expr("ts + interval 1 day"))
        .when(k % 5 == 1, F.expr("ts - interval 1 day")).alias("proxima_accion_en"),
        F.col("ts").alias("registrada_en"))
    return intake.check_activity(r).select(
        "event_id", F.array_join("violaciones", ",").alias("violaciones"))
