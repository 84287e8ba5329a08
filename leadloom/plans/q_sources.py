"""Round trips through files, and small projections of verified chats and decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import schemas as S
from leadloom.operators import extraction as X
from leadloom.operators import identity, incidents, merge, scope
from leadloom.plans import bindings as B
from leadloom.plans.q_verification import _CTES, verified
from leadloom.plans.registry import Tables, query
from leadloom.session import checkpoint_dir
from leadloom.sources import manifest, readers, writers
from leadloom.streaming import timers


def place(t: Tables) -> str:
    """A new folder in the shared place of the session."""
    return f"{checkpoint_dir(t.spark)}/sinks/{uuid.uuid4().hex}"


def _people(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.cast("string").alias("fila"),
        F.lpad((k % 400).cast("string"), 9, "0").alias("telefono"),
        F.concat(F.lit('Ana "'), "c_mktsegment", F.lit('", S.A.')).alias("nombre"),
        F.when(k % 5 != 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@x.co"))).alias("correo"),
        F.array(F.col("c_nationkey").cast("bigint"), (k % 3).cast("bigint")).alias("ids"))


_PEOPLE = """SELECT CAST(c_custkey AS VARCHAR) AS fila, lpad(CAST(c_custkey % 400 AS VARCHAR), 9, '0')
    AS telefono, 'Ana "' || c_mktsegment || '", S.A.' AS nombre, {mail} AS correo,
    '[' || c_nationkey || ',' || c_custkey % 3 || ']' AS ids FROM customer"""
_MAIL = "CASE WHEN c_custkey % 5 <> 0 THEN 'c' || c_custkey || '@x.co' END"


@query("a1_csv", _PEOPLE.format(mail=_MAIL))
def a1_csv(t: Tables) -> DataFrame:
    path = place(t)
    writers.write_csv(_people(t), path)
    text = T.StructType([T.StructField(c, T.StringType()) for c in ("fila", "telefono", "nombre", "correo", "ids")])
    return readers.read_csv(t.spark, path, text)


@query("a3_processed_csv", _PEOPLE.format(mail=f"coalesce({_MAIL}, '')"))
def a3_processed_csv(t: Tables) -> DataFrame:
    path = place(t)
    writers.write_csv(_people(t), path)
    return readers.read_processed_csv(t.spark, path)


@query("a2_chats", B.sql("""SELECT conversacion_id, posicion, emisor, md5(texto) AS texto FROM messages""",
                         "messages"))
def a2_chats(t: Tables) -> DataFrame:
    path = place(t)
    kept = {f.name for f in S.MESSAGE.fields}
    chats = B.messages(t).groupBy("conversacion_id").agg(
        F.sort_array(F.collect_list(F.struct("posicion", "emisor", "texto"))).alias("m")).select(
        "conversacion_id", F.transform("m", lambda m: F.struct(
            *[m[c].alias(c) for c in ("emisor", "texto") if c in kept])).alias("mensajes"))
    chats.write.json(path)
    back = readers.read_chats(t.spark, path, lines=True)
    return back.select("conversacion_id", F.posexplode("mensajes")).select(
        "conversacion_id", (F.col("pos") + 1).cast("bigint").alias("posicion"), "col.emisor",
        F.md5("col.texto").alias("texto"))


@query("a9_json", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS valor,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS fecha FROM orders""")
def a9_json(t: Tables) -> DataFrame:
    path = place(t)
    writers.write_json(t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice"))
        .alias("valor"), F.col("o_orderdate").cast("timestamp_ntz").alias("fecha")), path)
    return readers.read_json(
        t.spark, path, T.StructType.fromDDL("o_orderkey bigint, valor double, fecha string"), multiline=False)


@query("a8_csv", """SELECT CAST(o_custkey AS VARCHAR) AS cliente, '[' || string_agg('{"k":' || o_orderkey || ',"s":"'
        || o_orderstatus || ', \\"' || o_orderkey % 3 || '\\""}', ',' ORDER BY o_orderkey) || ']' AS pedidos,
    strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS ultimo,
    CASE WHEN o_custkey % 3 <> 0 THEN 'línea' || chr(10) || '"dos", tres' END AS nota FROM orders GROUP BY o_custkey""")
def a8_csv(t: Tables) -> DataFrame:
    """Nested columns, quotes, commas, line breaks and nulls through a CSV file, read back as text."""
    path, k = place(t), F.col("o_orderkey")
    quoted = F.concat("o_orderstatus", F.lit(', "'), k % 3, F.lit('"'))
    writers.write_csv(t.orders.groupBy(F.col("o_custkey").alias("cliente")).agg(
        F.sort_array(F.collect_list(F.struct(k.alias("k"), quoted.alias("s")))).alias("pedidos"),
        F.max("o_orderdate").cast("timestamp_ntz").alias("ultimo")).withColumn(
        "nota", F.when(F.col("cliente") % 3 != 0, 'línea\n"dos", tres')), path)
    return t.spark.read.options(header=True, multiLine=True, escape='"').csv(path)


@query("a11_portable", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS valor,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS fecha, o_orderstatus AS texto FROM orders""")
def a11_portable(t: Tables) -> DataFrame:
    k, odd = F.col("o_orderkey"), [float("nan"), float("inf"), float("-inf")]
    value = F.when(k % 4 == 0, F.col("o_totalprice"))
    for i, x in enumerate(odd):
        value = value.when(k % 4 == i + 1, x)
    return writers.portable(t.orders.select(
        "o_orderkey", value.alias("valor"), F.col("o_orderdate").cast("timestamp_ntz").alias("fecha"),
        F.col("o_orderstatus").alias("texto")))


_LINES = """CASE o_orderkey % 5 WHEN 0 THEN '[1,2]' WHEN 1 THEN '{"o_orderkey": "x' || o_orderkey || '"}'
    WHEN 2 THEN 'no' || o_orderkey ELSE '{"o_orderkey": ' || o_orderkey || '}' END"""


@query("a5_shape", f"SELECT linea FROM (SELECT {_LINES} AS linea, o_orderkey FROM orders) WHERE o_orderkey % 5 < 3")
def a5_shape(t: Tables) -> DataFrame:
    path = place(t)
    t.orders.select(F.expr(_LINES).alias("value")).write.text(path)
    wrong = readers.shape_violations(t.spark, path, T.StructType.fromDDL("o_orderkey bigint"))
    return wrong.select(F.col(readers.CORRUPT).alias("linea"))


@query("a10_side_by_side", """SELECT c_custkey, c_name AS c_name_original, upper(c_name) AS c_name,
    c_mktsegment FROM customer""")
def a10_side_by_side(t: Tables) -> DataFrame:
    normal = t.customer.select(
        "c_custkey", "c_name", "c_mktsegment", F.upper("c_name").alias("c_name_normalizado"))
    return writers.export_table(normal, ["c_custkey", "c_name", "c_mktsegment"])


@query("a13_round_trip", """SELECT 'corta' AS tabla, count(*) AS filas,
    count(*) FILTER (WHERE o_orderkey % 10 <> 0) AS filas_leidas FROM orders""")
def a13_round_trip(t: Tables) -> DataFrame:
    path = place(t)
    df = t.orders.select("o_orderkey", "o_totalprice", F.col("o_custkey") % 4)
    df = df.toDF("o_orderkey", "o_totalprice", "parte")
    writers.write_table(df, path, ["parte"])
    back = t.spark.read.parquet(path).select("o_orderkey", "o_totalprice", F.col("parte").cast("bigint").alias("parte"))
    cut = back.where("o_orderkey % 10 <> 0")
    return manifest.verify_round_trip({"entera": df, "corta": df}, {"entera": back, "corta": cut}).select(
        "tabla", "filas", "filas_leidas")


@query("i8_phone_log", B.sql("""SELECT fila, CASE WHEN fila % 2 = 0 THEN 'exclusion_registro'
        ELSE 'telefono_invalido_con_valor' END AS tipo, telefono AS valor_original FROM inquiries
    WHERE telefono = 'prueba' OR telefono IS NULL""", "inquiries"))
def i8_phone_log(t: Tables) -> DataFrame:
    wrong = B.inquiries(t).where("telefono = 'prueba' OR telefono IS NULL").select(
        "fila", "lead_id", F.col("telefono").alias("telefono_original"),
        F.when(F.col("fila") % 2 == 0, "excluir_sin_valor_recuperable").otherwise(
            "conservar_con_anotacion").alias("decision"), F.lit("c").alias("comentario"))
    return incidents.phone_log(wrong).select("fila", "tipo", "valor_original")


@query("l17_audit", B.sql("""SELECT empresa_id, 'u' || c_custkey % 7 AS actor, 'transferir' AS accion,
    'lead' AS tipo_entidad, lead_consolidado_id AS entidad_id, '{"segmento":"' || segmento ||
        '","nota":' || CASE WHEN c_custkey % 2 = 0 THEN '"n' || c_custkey || '"' ELSE 'null' END || '}' AS detalle
    FROM leads""", "leads"))
def l17_audit(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = B.leads(t).select(
        "*", F.concat(F.lit("u"), (k % 7).cast("string")).alias("actor"),
        F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("nota"))
    return merge.audit_events(rows, "transferir", "lead", "lead_consolidado_id", ["segmento", "nota"])


@query("l7_review_flag", B.sql("""SELECT lead_consolidado_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0
        AND c_custkey % 13 <> 0 THEN (CASE WHEN c_custkey % 5 = 0 THEN true ELSE c_custkey % 3 = 0 END)
            OR c_custkey % 7 = 0 ELSE c_custkey % 11 = 0 END AS requiere_revision FROM leads""", "leads"))
def l7_review_flag(t: Tables) -> DataFrame:
    k, lead = F.col("c_custkey"), ["empresa_id", "lead_consolidado_id"]
    base = B.leads(t)
    before = base.select(*lead, (k % 2 == 0).alias("conflicto_lote"),
                         F.when(k % 5 != 0, k % 3 == 0).alias("revision_antes_conflicto"))
    after = base.select(*lead, (k % 4 == 0).alias("conflicto_lote"), k.alias("priorizacion_id"),
                        (k % 3).alias("revision_entrada"))
    queues = base.select(k.alias("priorizacion_id"),
                         F.when(k % 7 == 0, "revision_orden").otherwise("activa").alias("cola"))
    states = base.select(*lead, (k % 11 == 0).alias("requiere_revision"),
                         F.when(k % 13 == 0, 9).otherwise(k % 3).alias("revision_entrada"))
    return merge.restore_review_flag(states, before, after, queues).select(
        "lead_consolidado_id", "requiere_revision")


@query("m7_usable_chats", """SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 <> 0""")
def m7_usable_chats(t: Tables) -> DataFrame:
    chats = t.conversations.select("conv_id", (F.col("conv_id") % 4 == 0).alias("descartada")).distinct()
    return scope.usable_chats(chats).select("conv_id")


@query("h27_pending_amounts", B.sql("""SELECT id AS conversacion_id, 'dinero.cuota_inicial' AS campo,
    len(montos) AS declaraciones FROM states WHERE conflicto""", "messages", **_CTES))
def h27_pending_amounts(t: Tables) -> DataFrame:
    return X.pending_amounts(verified(t)).select(
        "conversacion_id", "campo", F.size("declaraciones").cast("bigint").alias("declaraciones"))


@query("h29_review_rows", B.sql("""SELECT id AS conversacion_id, cita AS pidio_cita, monto AS inicial,
    CASE WHEN k % 2 = 0 AND paga THEN 'contado' ELSE 'desconocida' END AS forma_pago, md5(t) AS mensajes
    FROM states JOIN (SELECT conversacion_id AS id, string_agg(posicion || '. ' || emisor || ': ' || texto,
        chr(10) ORDER BY posicion) AS t FROM messages GROUP BY 1) USING (id)""", "messages", **_CTES))
def h29_review_rows(t: Tables) -> DataFrame:
    return X.review_rows(verified(t)).select(
        "conversacion_id", "pidio_cita", "inicial", "forma_pago", F.md5("mensajes_originales").alias("mensajes"))


@query("h19_finding_origin", B.sql("""SELECT id AS conversacion_id, 'regla_local' AS origen,
    corregido AS corregido FROM states WHERE corregido OR conflicto""", "messages", **_CTES))
def h19_finding_origin(t: Tables) -> DataFrame:
    e = F.col("extraccion")
    found = F.concat(
        F.transform(e["cambios_de_declaracion"], lambda c: F.struct(c["origen"].alias("origen"), F.lit(True).alias("corregido"))),
        F.transform(e["inconsistencias"], lambda c: F.struct(c["origen"].alias("origen"), F.lit(False).alias("corregido"))))
    return verified(t).select(e["conversacion_id"].alias("conversacion_id"), F.inline(found))


@query("j2_reconcile", B.sql("""WITH o AS (SELECT c_custkey AS k, empresa_id, bool_or(fila % 3 = 0) AS ref
        FROM inquiries GROUP BY 1, 2)
    -- a stored reference first; else the only person who has that phone, if the names agree
    SELECT 'N-' || o.k AS lead_consolidado_id, CASE WHEN o.ref THEN 'L-' || o.k
        WHEN (o.k // 2) % 2 = 0 AND n.ref THEN 'L-' || n.k ELSE 'N-' || o.k END AS destino
    FROM o LEFT JOIN o n ON n.k = xor(o.k, 1) AND n.empresa_id = o.empresa_id""", "inquiries"))
def j2_reconcile(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pair = F.floor(k / 2)
    name = F.when((pair % 2 == 0) | (k % 2 == 0), "Ana Pérez").otherwise("Luis Gómez")
    rows = B.inquiries(t).select(
        "fila", F.col("lead_id").alias("lead_id_origen"), "empresa_id", "c_custkey",
        F.concat(F.lit("T"), pair.cast("string")).alias("telefono"))
    old, new = F.concat(F.lit("L-"), k.cast("string")), F.concat(F.lit("N-"), k.cast("string"))
    base = rows.where("fila % 3 = 0").select(
        "lead_id_origen", old.alias("lead_consolidado_id"), "empresa_id", "telefono")
    people = B.leads(t).select("lead_consolidado_id", "empresa_id", name.alias("nombre_presentacion"))
    batch = rows.select("lead_id_origen", new.alias("lead_consolidado_id"), "telefono")
    leads = rows.select(
        new.alias("lead_consolidado_id"), "empresa_id", name.alias("nombre_presentacion")).distinct()
    return identity.reconcile_identities(people, base, leads, batch)[0]


@query("st1_snapshots", """SELECT o_custkey % 2 AS parte, count(*) AS filas, sum(o_orderkey) AS suma
    FROM orders GROUP BY 1""")
def st1_snapshots(t: Tables) -> DataFrame:
    path = place(t)
    for name, part in (("a", 0), ("b", 1), ("otra_vez", 0)):  # the third repeats the first
        t.orders.where(F.col("o_custkey") % 2 == part).select(
            "o_orderkey", (F.col("o_custkey") % 2).alias("parte")).write.json(f"{path}/{name}")
        t.spark.range(1).select(F.lit(f"{path}/{name}").alias("carpeta")).write.mode("append").json(
            f"{path}/manifiestos")
    timers.on_new_snapshot(
        t.spark, f"{path}/manifiestos", T.StructType.fromDDL("o_orderkey bigint, parte bigint"),
        f"{path}/resultados", f"{path}/progreso",
        lambda df, _: df.groupBy("parte").agg(
            F.count(F.lit(1)).alias("filas"), F.sum("o_orderkey").alias("suma")),
    ).awaitTermination()
    return t.spark.read.schema("parte bigint, filas bigint, suma bigint").parquet(
        f"{path}/resultados/huella=*")
