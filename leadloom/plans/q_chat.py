"""Chat queries over flat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.operators import catalog, chat, checks
from leadloom.plans import bindings as B
from leadloom.plans.registry import Tables, query

_S = "lower(strip_accents(texto))"
_FOLDED = f"""SELECT *, {_S} AS s, CASE WHEN emisor = 'asesor' AND
    len(regexp_extract_all(texto, '\\$\\s*(\\d{{1,3}}(?:\\.\\d{{3}})+|\\d+)', 1)) = 1
    THEN CAST(replace(regexp_extract(texto, '\\$\\s*(\\d{{1,3}}(?:\\.\\d{{3}})+|\\d+)', 1), '.', '')
        AS DOUBLE) END AS precio FROM messages"""


@query("c19_asof", B.sql("""SELECT conversacion_id, posicion, md5(last_value(CASE WHEN emisor =
    'asesor' THEN texto END IGNORE NULLS) OVER (PARTITION BY conversacion_id ORDER BY posicion
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS asesor_previo FROM messages""",
    "messages"))
def c19_asof(t: Tables) -> DataFrame:
    return chat.previous_advisor_text(B.messages(t)).select(
        "conversacion_id", "posicion", F.md5("asesor_previo").alias("asesor_previo"))


_NEIGHBOURS = """SELECT *, last_value(CASE WHEN precio IS NOT NULL THEN posicion END IGNORE NULLS)
        OVER a AS posicion_antes, last_value(precio IGNORE NULLS) OVER a AS precio_antes,
    first_value(CASE WHEN precio IS NOT NULL THEN posicion END IGNORE NULLS) OVER d
        AS posicion_despues, first_value(precio IGNORE NULLS) OVER d AS precio_despues
    FROM folded WINDOW a AS (PARTITION BY conversacion_id ORDER BY posicion
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    d AS (PARTITION BY conversacion_id ORDER BY posicion
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


@query("c20_nearest", B.sql("""SELECT conversacion_id, posicion, posicion_antes, precio_antes,
    posicion_despues, precio_despues FROM vecinos""", "messages", folded=_FOLDED,
    vecinos=_NEIGHBOURS))
def c20_nearest(t: Tables) -> DataFrame:
    return chat.neighbouring_prices(B.messages(t)).select(
        "conversacion_id", "posicion", "posicion_antes", "precio_antes", "posicion_despues",
        "precio_despues")


_PAID = f"""SELECT *, last_value(pago IGNORE NULLS) OVER w AS posicion_pago,
    last_value(es_contado IGNORE NULLS) OVER w AS contado FROM (SELECT *,
        CASE WHEN emisor = 'cliente' AND regexp_matches(s, '{V.CHAT_PATTERNS["payment_declaration"]}')
            THEN posicion END AS pago,
        CASE WHEN emisor = 'cliente' AND regexp_matches(s, '{V.CHAT_PATTERNS["payment_declaration"]}')
            THEN contains(s, 'de contado') END AS es_contado FROM folded)
    WINDOW w AS (PARTITION BY conversacion_id ORDER BY posicion
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("c21_last_payment", B.sql("SELECT conversacion_id, posicion, posicion_pago, contado FROM pagos",
                                 "messages", folded=_FOLDED, pagos=_PAID))
def c21_last_payment(t: Tables) -> DataFrame:
    return chat.last_payment_declaration(B.messages(t)).select(
        "conversacion_id", "posicion", "posicion_pago", "contado")


_INITIAL = """SELECT *, coalesce(max(nombra) OVER (PARTITION BY conversacion_id ORDER BY posicion
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS inicial_previa FROM (SELECT *,
    CASE WHEN emisor = 'cliente' AND contains(s, 'millones de inicial')
        AND NOT regexp_matches(s, '[0-9].*[0-9]') AND NOT regexp_matches(s, '-\\s*\\d')
        THEN 1 ELSE 0 END AS nombra FROM folded)"""


@query("c22_initial_before", B.sql("""SELECT conversacion_id, posicion, inicial_previa
    FROM iniciales""", "messages", folded=_FOLDED, iniciales=_INITIAL))
def c22_initial_before(t: Tables) -> DataFrame:
    return chat.declared_initial_before(B.messages(t)).select(
        "conversacion_id", "posicion", "inicial_previa")


_FOUND = """SELECT conversacion_id, posicion, 'referencia_a_inicial_no_declarada' AS tipo,
        NULL::BIGINT AS desde, posicion AS hasta FROM iniciales
    WHERE emisor = 'asesor' AND contains(s, 'con esa inicial') AND NOT inicial_previa
    UNION ALL SELECT conversacion_id, posicion, 'estudio_credito_tras_contado', posicion_pago,
        posicion FROM pagos WHERE emisor = 'asesor' AND contains(s, 'estudio de credito') AND contado
    UNION ALL SELECT conversacion_id, posicion, 'alternativa_mas_economica_con_precio_superior',
        posicion_antes, posicion_despues FROM vecinos
    WHERE emisor = 'cliente' AND contains(s, 'mas economico') AND precio_despues > precio_antes"""
_CHAT = {"folded": _FOLDED, "vecinos": _NEIGHBOURS, "pagos": _PAID, "iniciales": _INITIAL,
         "found": _FOUND}


@query("h23_source_findings", B.sql("SELECT * FROM found", "messages", **_CHAT))
def h23_source_findings(t: Tables) -> DataFrame:
    return chat.source_contradictions(B.messages(t)).select(
        "conversacion_id", "posicion", "tipo", "desde", "hasta")


@query("h24_partition", B.sql("""SELECT DISTINCT conversacion_id, conversacion_id IN
    (SELECT conversacion_id FROM found) AS descartada FROM messages""", "messages", **_CHAT))
def h24_partition(t: Tables) -> DataFrame:
    m = B.messages(t)
    chats = m.select("conversacion_id").distinct()
    usable, out = chat.discard_split(chats, chat.source_contradictions(m))
    return usable.select("conversacion_id", F.lit(False).alias("descartada")).unionByName(
        out.select("conversacion_id", F.lit(True).alias("descartada")))


@query("h2_id_contract", """WITH p AS (SELECT DISTINCT conv_id FROM conversations),
    r AS (SELECT conv_id + (CASE WHEN conv_id % 9 = 0 THEN 1000000 ELSE 0 END) AS conv_id FROM p)
    SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, p.conv_id IS NOT NULL AS en_a,
        r.conv_id IS NOT NULL AS en_b FROM p FULL JOIN r ON p.conv_id = r.conv_id
    WHERE p.conv_id IS NULL OR r.conv_id IS NULL""")
def h2_id_contract(t: Tables) -> DataFrame:
    asked = t.conversations.select("conv_id").distinct()
    received = asked.select((F.col("conv_id") + F.when(
        F.col("conv_id") % 9 == 0, 1000000).otherwise(0)).alias("conv_id"))
    return checks.key_differences(asked, received, ["conv_id"])


_AMOUNTS = """SELECT conversacion_id, posicion, s, CASE WHEN starts_with(s,
        'de contado, ya tengo la plata lista, ') THEN 'presupuesto_total'
    WHEN contains(s, 'tengo') AND contains(s, 'inicial') THEN 'cuota_inicial' END AS campo,
    CASE WHEN contains(s, 'tengo 2 millones') THEN 2000000.0 WHEN contains(s, 'tengo 3 millones')
        THEN 3000000.0 END AS v FROM folded WHERE emisor = 'cliente'
    AND NOT regexp_matches(s, '-\\s*\\d') AND NOT regexp_matches(s, '[0-9].*[0-9]')"""


@query("h12_settled_amounts", B.sql("""WITH c AS (SELECT * FROM amounts WHERE campo IS NOT NULL
        AND v IS NOT NULL),
    g AS (SELECT conversacion_id, campo, count(*) AS declaraciones, count(DISTINCT v) AS n,
        arg_max(v, posicion) AS ultimo, arg_max(contains(s, 'corrijo'), posicion) AS corrige
        FROM c GROUP BY 1, 2)
    SELECT conversacion_id, campo, declaraciones, CASE WHEN n = 1 THEN 'importe_unico'
        WHEN corrige THEN 'cambio_importe_explicito' ELSE 'importes_contradictorios' END
        AS decision, CASE WHEN n = 1 OR corrige THEN ultimo END AS valor FROM g""", "messages",
    folded=_FOLDED, amounts=_AMOUNTS))
def h12_settled_amounts(t: Tables) -> DataFrame:
    return chat.settled_amounts(chat.amount_candidates(B.messages(t))).select(
        "conversacion_id", "campo", "declaraciones", "decision", "valor")


@query("h20_record_status", """SELECT conv_id, CASE WHEN bool_or(turn % 5 = 4) THEN
    'requiere_revision' ELSE 'validada_automaticamente' END AS estado FROM conversations
    GROUP BY 1""")
def h20_record_status(t: Tables) -> DataFrame:
    from leadloom.operators.extraction import record_status

    log = t.conversations.select("conv_id", F.when(
        F.col("turn") % 5 == 4, "pendiente_revision").otherwise("corregido_por_regla")
        .alias("estado"))
    return record_status(log, ["conv_id"]).withColumnRenamed("estado_extraccion", "estado")


@query("h26_model_audit", B.sql("""WITH cat AS (SELECT sku, lower(marca || ' ' || linea) AS nombre
        FROM catalogue), m AS (SELECT conversacion_id, lower(strip_accents(texto)) || ' ' || wish AS s
        FROM (SELECT m.*, coalesce(lower(p_brand || ' ' || p_name || ' ' || p_size), '') AS wish
            FROM messages m LEFT JOIN part ON p_partkey = conv_id) WHERE emisor = 'cliente'),
    e AS (SELECT DISTINCT conversacion_id, sku FROM m JOIN cat ON contains(s, nombre)),
    a AS (SELECT DISTINCT conversacion_id, 'SKU-' || conv_id AS sku FROM messages
        WHERE conv_id % 5 <> 0 AND emisor = 'cliente')
    SELECT coalesce(e.conversacion_id, a.conversacion_id) AS conversacion_id,
        coalesce(e.sku, a.sku) AS sku, e.sku IS NOT NULL AS en_a, a.sku IS NOT NULL AS en_b
    FROM e FULL JOIN a ON e.conversacion_id = a.conversacion_id AND e.sku = a.sku
    WHERE e.sku IS NULL OR a.sku IS NULL""", "messages", "catalogue"))
def h26_model_audit(t: Tables) -> DataFrame:
    wish = F.lower(F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string")))
    said = B.messages(t).where("emisor = 'cliente'").join(
        t.part, F.col("p_partkey") == F.col("conv_id"), "left"
    ).select("conversacion_id", "conv_id", F.concat_ws(" ", "texto", wish).alias("texto"))
    expected = catalog.names_in_text(said, "conversacion_id", "texto", B.catalogue(t), each_row=False)
    extracted = said.where("conv_id % 5 <> 0").select(
        "conversacion_id", F.concat(F.lit("SKU-"), F.col("conv_id").cast("string")).alias("sku")
    ).distinct()
    return checks.key_differences(expected, extracted, ["conversacion_id", "sku"])


_SLICE = "CAST(sum(CAST(CAST('0x' || substr(h, {at}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"


@query("h30_fingerprint", B.sql(f"""SELECT conversacion_id, sha256('modelo|2.0|2.5|' || conversacion_id || '|' ||
        count(*) || '|' || {_SLICE.format(at=1)} || '|' || {_SLICE.format(at=16)}) AS huella
    FROM (SELECT conversacion_id, sha256(CAST(to_json({{'posicion': posicion, 'emisor': emisor, 'texto': texto}})
        AS VARCHAR)) AS h FROM messages) GROUP BY 1""", "messages"))
def h30_fingerprint(t: Tables) -> DataFrame:
    return chat.chat_fingerprint(B.messages(t), "modelo|2.0|2.5")


@query("h31_technical_errors", """SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0
    AND turn % 3 <> 0) AS errores FROM conversations GROUP BY 1""")
def h31_technical_errors(t: Tables) -> DataFrame:
    from leadloom.operators.extraction import technical_errors

    log = t.conversations.select(
        "conv_id",
        F.when(F.col("turn") % 2 == 0, "pendiente_revision").otherwise("corregido_por_regla")
        .alias("estado"),
        F.when(F.col("turn") % 3 == 0, "importes_contradictorios").otherwise("evidencia_invalida")
        .alias("tipo"))
    return technical_errors(log, ["conv_id"])


@query("h32_adopt", """WITH o AS (SELECT conv_id AS conversacion_id, count(*) AS errores
        FROM conversations GROUP BY 1)
    SELECT conversacion_id, CASE WHEN conversacion_id % 2 = 0 THEN errores - 1 ELSE errores END
        AS errores, conversacion_id % 2 = 0 AS adoptada FROM o""")
def h32_adopt(t: Tables) -> DataFrame:
    old = t.conversations.groupBy(F.col("conv_id").alias("conversacion_id")).agg(
        F.count(F.lit(1)).alias("errores"))
    new = old.withColumn("errores", F.col("errores") - F.when(
        F.col("conversacion_id") % 2 == 0, 1).otherwise(0))
    return chat.adopt_if_better(old, new)


@query("h33_link_integrity", """SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
    WHERE conv_id % 7 = 3""")
def h33_link_integrity(t: Tables) -> DataFrame:
    source = t.conversations.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") % 25).alias("empresa_id"), F.lit("L").alias("lead_id"))
    result = source.withColumn("empresa_id", F.col("empresa_id") + F.when(
        F.col("conv_id") % 7 == 3, 100).otherwise(0))
    return checks.owner_mismatch(result, source, ["conv_id"], ["empresa_id", "lead_id"]).select(
        "conv_id")


@query("h34_mention_rows", """SELECT event_id, 0 AS orden, CAST(json_extract(props, '$.k') AS BIGINT)
    AS valor FROM events UNION ALL SELECT event_id, 1, user_id FROM events""")
def h34_mention_rows(t: Tables) -> DataFrame:
    listed = t.events.select("event_id", F.array(
        F.get_json_object("props", "$.k").cast("bigint"), "user_id").alias("m"))
    return listed.select("event_id", F.posexplode("m").alias("orden", "valor"))


@query("h35_pilot_checks", """SELECT event_id, json_extract_string(props, '$.k') AS obtenido,
    json_extract_string(props, '$.k') = CAST(event_id % 100 AS VARCHAR) AS cumple FROM events""")
def h35_pilot_checks(t: Tables) -> DataFrame:
    from leadloom.operators.extraction import evaluate_paths

    payloads = t.events.select("event_id", "props")
    expected = t.events.select(
        "event_id", F.lit("k").alias("campo"),
        (F.col("event_id") % 100).cast("string").alias("esperado"))
    return evaluate_paths(payloads, "props", expected, "event_id", ["k"]).select(
        "event_id", "obtenido", "cumple")
