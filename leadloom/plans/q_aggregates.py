"""Aggregation queries: profiles, groups, indicators, service level, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text
from leadloom.operators import checks, identity, profile
from leadloom.plans import bindings as B
from leadloom.plans.q_values import PHONES, prepared_inquiries
from leadloom.plans.registry import Tables, query

_KEY = "replace(strip_accents(lower(trim(regexp_replace(nombre, '\\s+', ' ', 'g')))), 'ß', 'ss')"
_PREP = """SELECT fila, lead_id, empresa_id, CASE WHEN telefono_estado = 'valido'
        THEN '+57' || local END AS telefono,
    CASE WHEN fila % 12 = 3 THEN 'prueba' ELSE nombre_cliente END AS nombre,
    lower(email) AS email, CASE WHEN canal = 'meta ads' THEN 'Meta Ads'
        WHEN canal = 'WHATSAPP' THEN 'WhatsApp' END AS canal, telefono_estado FROM phones"""
_GROUPS = {**PHONES, "prep": _PREP}


def _digest_sql(table: str, columns: list[str]) -> str:
    """Rows and the two sums of row digest slices, as exact integers."""
    key = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(columns))
    part = "CAST(sum(CAST(CAST('0x' || substr(h, {at}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
    return (f"SELECT count(*) AS filas, {part.format(at=1)} AS huella_a, {part.format(at=16)} AS huella_b "
            f"FROM (SELECT sha256(concat_ws(chr(31), 'k', {key})) AS h FROM {table})")


_DIGESTS = {
    "orders": _digest_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                     "o_orderdate", "o_orderpriority"]),
    "customer": _digest_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
}


@query("a12_manifest", " UNION ALL ".join(
    f"SELECT '{name}' AS tabla, filas, sha256(huella_a || '|' || huella_b) AS huella FROM ({sql})"
    for name, sql in _DIGESTS.items()))
def a12_manifest(t: Tables) -> DataFrame:
    from leadloom.sources.manifest import manifest

    return manifest({"customer": t.customer, "orders": t.orders})


@query("d1_profile", """SELECT o_custkey, count(*) AS filas, count(DISTINCT st) AS distintas,
    count(*) - count(st) AS faltantes, CASE WHEN count(DISTINCT st) = 1 AND count(*) = count(st)
        THEN max(st) END AS identificada
    FROM (SELECT o_custkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS st FROM orders)
    GROUP BY 1""")
def d1_profile(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", F.when(
        F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("st"))
    return profile.owner_reference(o, "o_custkey", "st")


@query("d2_key_quality", """WITH k AS (SELECT CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS k
        FROM orders), n AS (SELECT k, count(*) AS n FROM k GROUP BY 1),
    e AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1)
    SELECT 'orders' AS tabla, CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT)
        AS ids_faltantes, count(*) FILTER (WHERE k IS NOT NULL AND n > 1)
        AS ids_repetidos_distintos,
        CAST(coalesce(sum(n) FILTER (WHERE k IS NOT NULL AND n > 1), 0) AS BIGINT)
        AS filas_con_id_repetido FROM n
    UNION ALL SELECT 'events', CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT),
        count(*) FILTER (WHERE k IS NOT NULL AND n > 1),
        CAST(coalesce(sum(n) FILTER (WHERE k IS NOT NULL AND n > 1), 0) AS BIGINT) FROM e""")
def d2_key_quality(t: Tables) -> DataFrame:
    o = t.orders.select(F.when(F.col("o_orderkey") % 17 != 0, F.col("o_custkey")).alias("k"))
    return profile.key_quality(o, "k", "orders").unionByName(
        profile.key_quality(t.events, "user_id", "events"))


@query("d3_state_frequency", B.sql("""WITH s AS (SELECT telefono_estado,
        CASE WHEN canal = 'fax' THEN 'no_reconocido' ELSE 'valido' END AS canal_estado FROM phones)
    SELECT 'leads' AS tabla, 'telefono_estado' AS campo, telefono_estado AS estado,
        count(*) AS registros FROM s GROUP BY ALL
    UNION ALL SELECT 'leads', 'canal_estado', canal_estado, count(*) FROM s GROUP BY ALL""",
    "inquiries", **PHONES))
def d3_state_frequency(t: Tables) -> DataFrame:
    i = B.inquiries(t).select(
        text.phone("telefono")["estado"].alias("telefono_estado"),
        text.category("canal", "canal")["estado"].alias("canal_estado"))
    return profile.state_frequencies(i, "leads", ["telefono_estado", "canal_estado"])


def _duplicated(t: Tables) -> DataFrame:
    p = prepared_inquiries(t).select(
        "fila", "lead_id", "empresa_id", "telefono", "nombre", "email", "canal", "telefono_estado")
    again = p.where("fila % 5 = 0")
    return p.unionByName(again).withColumn(
        "copia", F.concat(F.lit("r"), F.col("fila").cast("string")))


@query("d4_duplicate_groups", B.sql(f"""WITH p AS (SELECT * FROM prep UNION ALL
        SELECT * FROM prep WHERE fila % 5 = 0),
    g AS (SELECT *, {_KEY} AS k, count(*) OVER (PARTITION BY fila) > 1 AS rep FROM p
        WHERE telefono IS NOT NULL)
    SELECT empresa_id, telefono, count(*) AS filas, count(DISTINCT lead_id) AS ids_distintos,
        count(DISTINCT fila) AS filas_originales_distintas,
        count(*) FILTER (WHERE rep) AS filas_en_repeticiones_exactas,
        count(DISTINCT k) AS nombres_distintos, count(*) - count(k) AS nombres_faltantes,
        count(DISTINCT email) AS correos_distintos, count(*) - count(email) AS correos_faltantes,
        count(DISTINCT canal) AS canales_distintos,
        CASE WHEN count(DISTINCT fila) = 1 THEN 'Todas las filas son idénticas'
            WHEN count(DISTINCT k) > 1 OR count(DISTINCT email) > 1
                THEN 'Revisar diferencias de nombre o correo'
            ELSE 'Datos de identidad compatibles; revisar consultas y faltantes' END
            AS lectura_inicial
    FROM g GROUP BY 1, 2 HAVING count(*) > 1""", "inquiries", **_GROUPS))
def d4_duplicate_groups(t: Tables) -> DataFrame:
    return identity.duplicate_summary(_duplicated(t))


@query("d5_identity_proposal", B.sql(f"""WITH g AS (SELECT *, {_KEY} AS k FROM prep
        WHERE telefono IS NOT NULL),
    s AS (SELECT empresa_id, telefono, count(*) AS consultas, count(DISTINCT k) AS nk,
        count(DISTINCT email) AS ne, bool_or(email IS NULL) AS sin_correo,
        bool_and(len(string_split(k, ' ')) >= 2 AND NOT regexp_matches(k, '(^| )[a-z]\\.?( |$)'))
            AS completo FROM g GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT empresa_id, telefono, consultas,
        CASE WHEN nk = 1 AND completo AND ne <= 1 THEN 'agrupar_cliente_conservar_consultas'
            ELSE 'revision_manual_identidad' END AS propuesta,
        coalesce(nullif(concat_ws('; ', CASE WHEN nk = 1 AND completo AND ne <= 1 THEN
            'mismo nombre completo normalizado y sin correos contradictorios' END,
            CASE WHEN nk > 1 THEN 'nombres diferentes; pueden incluir abreviaturas' END,
            CASE WHEN NOT completo THEN 'nombre incompleto o con iniciales' END,
            CASE WHEN ne > 1 THEN 'correos diferentes' END,
            CASE WHEN sin_correo THEN 'correo faltante en alguna consulta' END), ''),
            'revisar evidencia de identidad') AS motivo FROM s""", "inquiries", **_GROUPS))
def d5_identity_proposal(t: Tables) -> DataFrame:
    return identity.identity_proposals(prepared_inquiries(t))


@query("d6_consolidate", B.sql("""WITH i AS (SELECT *, trim(regexp_replace(nombre, '\\s+', ' ', 'g'))
        AS n, 'ID' || (fila % 900) AS lid FROM prep),
    r AS (SELECT lid, n, row_number() OVER (PARTITION BY lid ORDER BY
        len(list_filter(string_split(n, ' '), lambda x: length(trim(x, '.')) > 1)) DESC,
        length(n) DESC, n) AS rn FROM (SELECT DISTINCT lid, n FROM i))
    SELECT i.lid AS lead_consolidado_id, max(r.n) AS nombre_presentacion,
        bool_and(telefono_estado = 'valido') AS telefono_utilizable,
        count(DISTINCT email) > 1 AS varios_correos, count(DISTINCT canal) AS canales,
        count(DISTINCT telefono) AS telefonos, count(*) AS numero_consultas,
        min(fila) AS primera, max(fila) AS ultima
    FROM i JOIN r ON i.lid = r.lid AND rn = 1 GROUP BY 1""", "inquiries", **_GROUPS))
def d6_consolidate(t: Tables) -> DataFrame:
    resolved = prepared_inquiries(t).select(
        "*", F.concat(F.lit("ID"), (F.col("fila") % 900).cast("string")).alias(
            "lead_consolidado_id"),
        F.lit(None).cast("string").alias("modelo_estado"),
    ).withColumn("empresa_id", F.lit("E")).withColumn("fecha_registro", F.col("fila"))
    return identity.consolidate(resolved).select(
        "lead_consolidado_id", "nombre_presentacion", "telefono_utilizable", "varios_correos",
        "canales", "telefonos", "numero_consultas",
        F.col("primera_fecha_registro").alias("primera"),
        F.col("ultima_fecha_registro").alias("ultima"))


@query("d7_informed_values", B.sql("""WITH v AS (SELECT DISTINCT lead_consolidado_id, 'canal' AS
        campo, canal AS valor FROM inquiries UNION SELECT DISTINCT lead_consolidado_id, 'ciudad',
        ciudad FROM inquiries WHERE ciudad IS NOT NULL)
    SELECT *, row_number() OVER (PARTITION BY lead_consolidado_id, campo ORDER BY valor) AS orden
    FROM v""", "inquiries"))
def d7_informed_values(t: Tables) -> DataFrame:
    return identity.informed_values(B.inquiries(t), ["lead_consolidado_id"], ["canal", "ciudad"])


@query("d7_listed_values", B.sql("""SELECT lead_consolidado_id, 'canal' AS campo, 0 AS pagina,
    string_agg(DISTINCT canal, ',' ORDER BY canal) AS valores FROM inquiries GROUP BY 1""",
    "inquiries"))
def d7_listed_values(t: Tables) -> DataFrame:
    out = identity.listed_values(B.inquiries(t), ["lead_consolidado_id"], ["canal"])
    return out.withColumns({"pagina": F.col("pagina").cast("int"),
                            "valores": F.array_join("valores", ",")})


@query("d8_coverage", B.sql("""SELECT empresa_id, punto_venta_id, count(*) AS asesores,
    count(*) FILTER (WHERE activo) AS activos,
    count(*) FILTER (WHERE activo IS NULL) AS estado_desconocido,
    CAST(CASE WHEN count(*) FILTER (WHERE activo AND capacidad IS NULL) = 0
        THEN coalesce(sum(capacidad) FILTER (WHERE activo), 0) END AS BIGINT) AS capacidad_activos
    FROM advisors GROUP BY 1, 2""", "advisors"))
def d8_coverage(t: Tables) -> DataFrame:
    return profile.site_coverage(B.advisors(t))


@query("d9_shared_sites", B.sql("""SELECT punto_venta_id, count(DISTINCT empresa_id) AS empresas,
    count(*) AS filas FROM advisors GROUP BY 1 HAVING count(DISTINCT empresa_id) > 1""",
    "advisors"))
def d9_shared_sites(t: Tables) -> DataFrame:
    return profile.shared_across_owners(B.advisors(t), "punto_venta_id", "empresa_id")


@query("d10_shared_phones", B.sql("""SELECT telefono, count(DISTINCT empresa_id) AS empresas,
    count(*) AS filas FROM prep WHERE telefono IS NOT NULL GROUP BY 1
    HAVING count(DISTINCT empresa_id) > 1""", "inquiries", **_GROUPS))
def d10_shared_phones(t: Tables) -> DataFrame:
    i = B.inquiries(t).select("empresa_id", text.phone("telefono")["valor"].alias("telefono"))
    return profile.shared_across_owners(i, "telefono", "empresa_id")


@query("d11_event_counts", "SELECT event_type AS tipo, count(*) AS eventos FROM events GROUP BY 1")
def d11_event_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("tipo")).agg(
        F.count(F.lit(1)).alias("eventos"))


@query("d12_nulls", B.sql("""SELECT 'email' AS campo, count(*) - count(email) AS nulos,
        round(100.0 * (count(*) - count(email)) / count(*), 4) AS porcentaje FROM inquiries
    UNION ALL SELECT 'ciudad', count(*) - count(ciudad),
        round(100.0 * (count(*) - count(ciudad)) / count(*), 4) FROM inquiries
    UNION ALL SELECT 'telefono', count(*) - count(telefono),
        round(100.0 * (count(*) - count(telefono)) / count(*), 4) FROM inquiries""", "inquiries"))
def d12_nulls(t: Tables) -> DataFrame:
    return profile.null_profile(B.inquiries(t), ["email", "ciudad", "telefono"])


@query("d13_categories", B.sql(
    "SELECT estado_gestion, count(*) AS filas FROM inquiries GROUP BY 1", "inquiries"))
def d13_categories(t: Tables) -> DataFrame:
    return B.inquiries(t).groupBy("estado_gestion").agg(F.count(F.lit(1)).alias("filas"))


@query("d14_pivot", B.sql("""SELECT empresa_id, count(*) FILTER (WHERE temperatura = 'caliente')
        AS caliente, count(*) FILTER (WHERE temperatura = 'tibio') AS tibio,
        count(*) FILTER (WHERE temperatura = 'sin_informacion_suficiente')
        AS sin_informacion_suficiente FROM priorities GROUP BY 1""", "priorities"))
def d14_pivot(t: Tables) -> DataFrame:
    return profile.crosstab(
        B.priorities(t), "empresa_id", "temperatura",
        ["caliente", "tibio", "sin_informacion_suficiente"])


@query("d15_closing_rate", B.sql("""SELECT empresa_id, count(*) AS observados,
    round(avg(CASE WHEN desenlace = 'Cerrado' THEN 1.0 ELSE 0 END), 6) AS tasa FROM history
    WHERE desenlace IN ('Cerrado', 'Perdido') GROUP BY 1""", "history"))
def d15_closing_rate(t: Tables) -> DataFrame:
    return B.history(t).where(F.col("desenlace").isin("Cerrado", "Perdido")).groupBy(
        "empresa_id").agg(
        F.count(F.lit(1)).alias("observados"),
        F.round(F.avg((F.col("desenlace") == "Cerrado").cast("int")), 6).alias("tasa"))


@query("d16_contacts", B.sql("""SELECT lead_consolidado_id, 0 AS pagina,
    string_agg(lead_id || '=' || coalesce(telefono, 'NULO'), ';' ORDER BY lead_id) AS contactos
    FROM inquiries GROUP BY 1""", "inquiries"))
def d16_contacts(t: Tables) -> DataFrame:
    base = B.inquiries(t).select("lead_consolidado_id", F.concat(
        "lead_id", F.lit("="), F.coalesce("telefono", F.lit("NULO"))).alias("contacto"), "lead_id")
    pages = identity.listed_values(
        base.withColumn("contacto", F.concat("lead_id", F.lit("\x01"), "contacto")),
        ["lead_consolidado_id"], ["contacto"])
    return pages.select(
        "lead_consolidado_id", F.col("pagina").cast("int").alias("pagina"),
        F.array_join(F.transform("valores", lambda v: F.substring_index(v, "\x01", -1)), ";")
        .alias("contactos"))


@query("d17_filtered", B.sql("""SELECT lead_consolidado_id,
    strftime(min(ts) FILTER (WHERE resultado = 'contactado'), '%Y-%m-%d %H:%M:%S') AS contacto,
    bool_or(resultado = 'perdido') AS perdido FROM activities GROUP BY 1""", "activities"))
def d17_filtered(t: Tables) -> DataFrame:
    return B.activities(t).groupBy("lead_consolidado_id").agg(
        F.date_format(F.min(F.when(F.col("resultado") == "contactado", F.col("ts"))),
                      "yyyy-MM-dd HH:mm:ss").alias("contacto"),
        F.bool_or(F.col("resultado") == "perdido").alias("perdido"))


_SLA_ROWS = """SELECT l.empresa_id, l.lead_consolidado_id, CASE WHEN l.c_custkey % 9 <> 0
        THEN TIMESTAMP '2024-01-05 00:00:00' + to_hours(CAST(l.c_custkey % 500 AS INTEGER)) END
        AS inicio, min(a.ts) FILTER (WHERE resultado = 'contactado' AND a.ts >=
        TIMESTAMP '2024-01-05 00:00:00') AS contacto, l.c_custkey % 8 = 0 AS impreciso
    FROM leads l LEFT JOIN activities a USING (empresa_id, lead_consolidado_id)
    GROUP BY l.empresa_id, l.lead_consolidado_id, l.c_custkey"""
_SLA_CLASS = """SELECT *, CASE WHEN inicio IS NULL OR inicio > TIMESTAMP '2024-01-20 00:00:00'
        OR impreciso OR contacto < inicio OR contacto > TIMESTAMP '2024-01-20 00:00:00'
        THEN 'no_medibles' WHEN contacto <= inicio + INTERVAL 24 HOURS THEN 'cumplen'
    WHEN contacto IS NULL AND TIMESTAMP '2024-01-20 00:00:00' < inicio + INTERVAL 24 HOURS
        THEN 'en_plazo' ELSE 'vencidos' END AS clase FROM sla_rows"""


def sla_rows(t: Tables) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    first = B.activities(t).where(
        (F.col("resultado") == "contactado") & (F.col("ts") >= F.lit("2024-01-05 00:00:00"))
    ).groupBy("empresa_id", "lead_consolidado_id").agg(F.min("ts").alias("contacto"))
    start = F.expr("timestamp_ntz '2024-01-05 00:00:00' + make_dt_interval(0, "
                   "cast(c_custkey % 500 as int))")
    return B.leads(t).join(first, ["empresa_id", "lead_consolidado_id"], "left").withColumns({
        "inicio": F.when(F.col("c_custkey") % 9 != 0, start),
        "impreciso": F.col("c_custkey") % 8 == 0,
    }).withColumn("clase", profile.sla_class(
        F.col("inicio"), F.col("contacto"), F.col("impreciso"), now))


@query("d18_sla", B.sql("""SELECT empresa_id, count(*) FILTER (WHERE clase = 'cumplen') AS cumplen,
    count(*) FILTER (WHERE clase = 'vencidos') AS vencidos,
    count(*) FILTER (WHERE clase = 'en_plazo') AS en_plazo,
    count(*) FILTER (WHERE clase = 'no_medibles') AS no_medibles,
    count(*) FILTER (WHERE clase IN ('cumplen', 'vencidos')) AS denominador,
    round(100.0 * count(*) FILTER (WHERE clase = 'cumplen')
        / nullif(count(*) FILTER (WHERE clase IN ('cumplen', 'vencidos')), 0), 2) AS porcentaje
    FROM sla GROUP BY 1""", "leads", "activities", sla_rows=_SLA_ROWS, sla=_SLA_CLASS))
def d18_sla(t: Tables) -> DataFrame:
    return profile.sla_summary(sla_rows(t), ["empresa_id"])


@query("d19_indicators", B.sql("""WITH s AS (SELECT empresa_id, lead_consolidado_id,
        CASE WHEN c_custkey % 5 = 0 THEN 'cerrado' ELSE 'abierto' END AS estado,
        c_custkey % 7 = 0 AS requiere_revision, c_custkey % 3 = 0 AS vencido, c_custkey FROM leads),
    a AS (SELECT * FROM activities WHERE CAST(ts - INTERVAL 5 HOURS AS DATE) = DATE '2024-01-10')
    SELECT s.empresa_id, count(*) FILTER (WHERE estado = 'abierto') AS leads_activos,
        count(*) FILTER (WHERE requiere_revision) AS requieren_revision,
        count(*) FILTER (WHERE estado = 'abierto' AND vencido) AS seguimientos_vencidos,
        (SELECT count(DISTINCT lead_consolidado_id) FROM a WHERE a.empresa_id = s.empresa_id)
            AS gestionados_hoy,
        (SELECT count(*) FROM a WHERE a.empresa_id = s.empresa_id AND resultado = 'sin_respuesta')
            AS intentos_hoy,
        (SELECT count(*) FROM a WHERE a.empresa_id = s.empresa_id AND resultado = 'contactado')
            AS contactos_hoy,
        count(*) FILTER (WHERE c_custkey % 4 = 0) AS asignados_hoy
    FROM s GROUP BY s.empresa_id""", "leads", "activities"))
def d19_indicators(t: Tables) -> DataFrame:
    now = F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")
    k = F.col("c_custkey")
    states = B.leads(t).select(
        "empresa_id", "lead_consolidado_id",
        F.when(k % 5 == 0, "cerrado").otherwise("abierto").alias("estado"),
        (k % 7 == 0).alias("requiere_revision"),
        F.when(k % 3 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("proxima_accion_en"))
    today = B.activities(t).where(
        F.to_date(F.col("ts") - F.expr("interval 5 hours")) == F.lit("2024-01-10").cast("date"))
    return profile.dashboard(states, today, B.leads(t).where(k % 4 == 0), now)


@query("d20_all_discarded", B.sql("""SELECT lead_consolidado_id,
    bool_and(coalesce(estado_gestion = 'DESCARTADO', false)) AS todas FROM inquiries GROUP BY 1""",
    "inquiries"))
def d20_all_discarded(t: Tables) -> DataFrame:
    return B.inquiries(t).groupBy("lead_consolidado_id").agg(F.bool_and(
        F.coalesce(F.col("estado_gestion") == "DESCARTADO", F.lit(False))).alias("todas"))


@query("d21_load_today", """SELECT l_suppkey AS asesor, strftime(l_shipdate, '%Y-%m-%d') AS dia,
    count(*) AS carga, CAST(max(l_linenumber) AS BIGINT) AS ultima_posicion FROM lineitem
    GROUP BY 1, 2""")
def d21_load_today(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("asesor"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("dia")
    ).agg(F.count(F.lit(1)).alias("carga"),
          F.max("l_linenumber").cast("bigint").alias("ultima_posicion"))


@query("d22_candidate_means", """SELECT l_suppkey AS candidato, round(avg(q), 6) AS media,
    round(min(q), 6) AS minima FROM (SELECT l_suppkey, l_returnflag AS ronda, avg(l_quantity) AS q
        FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def d22_candidate_means(t: Tables) -> DataFrame:
    rounds = t.lineitem.groupBy(F.col("l_suppkey").alias("candidato"), "l_returnflag").agg(
        F.avg("l_quantity").alias("q"))
    return rounds.groupBy("candidato").agg(
        F.round(F.avg("q"), 6).alias("media"), F.round(F.min("q"), 6).alias("minima"))


@query("d23_usage", """SELECT event_type AS modelo, count(*) AS peticiones,
    CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS entrada, 0 AS salida,
    CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events
    GROUP BY 1""")
def d23_usage(t: Tables) -> DataFrame:
    log = t.events.withColumn("uso", F.regexp_replace(
        "props", r'\{"k": (\d+)\}', r'{"prompt": $1, "total": $1}'))
    return profile.usage_ledger(log, "uso", ["event_type"]).select(
        F.col("event_type").alias("modelo"), "peticiones", "entrada", "salida", "total")


@query("d24_fingerprint", " UNION ALL ".join(_DIGESTS.values()))
def d24_fingerprint(t: Tables) -> DataFrame:
    return checks.fingerprint(t.orders).unionByName(checks.fingerprint(t.customer))


@query("d25_counts", B.sql("""SELECT empresa_id, cola, count(*) AS leads FROM priorities
    GROUP BY ROLLUP (empresa_id, cola)""", "priorities"))
def d25_counts(t: Tables) -> DataFrame:
    return B.priorities(t).rollup("empresa_id", "cola").agg(F.count(F.lit(1)).alias("leads"))


@query("d26_batch_summary", B.sql("""WITH c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT 'conversaciones' AS tabla, count(*) AS filas, count(*) FILTER (WHERE conv_id % 4 = 0)
        AS descartadas FROM c
    UNION ALL SELECT 'mensajes', count(*), count(*) FILTER (WHERE conv_id % 4 = 0)
        FROM messages""", "messages"))
def d26_batch_summary(t: Tables) -> DataFrame:
    chats = t.conversations.select("conv_id").distinct()
    rows = chats.select(F.lit("conversaciones").alias("tabla"), "conv_id").unionByName(
        B.messages(t).select(F.lit("mensajes").alias("tabla"), "conv_id"))
    return rows.groupBy("tabla").agg(
        F.count(F.lit(1)).alias("filas"),
        F.count_if(F.col("conv_id") % 4 == 0).alias("descartadas"))


@query("d28_single_owner", """SELECT o_custkey AS referencia, CASE WHEN count(DISTINCT o_orderstatus)
    = 1 THEN max(o_orderstatus) END AS propietario FROM orders GROUP BY 1""")
def d28_single_owner(t: Tables) -> DataFrame:
    return profile.single_owner(
        t.orders.withColumnRenamed("o_custkey", "referencia"), "referencia", "o_orderstatus")
