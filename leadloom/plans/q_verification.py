"""Evidence verification over whole chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom import schemas as S
from leadloom.operators import extraction as X
from leadloom.plans import bindings as B
from leadloom.plans.q_chat import _FOLDED
from leadloom.plans.registry import Tables, query


def exchanges(t: Tables) -> DataFrame:
    """Whole chats, nested as they arrive, with a declared extraction.

    The declared facts quote the first client message rightly, by the wrong speaker, at a missing
    position, as an unsupported denial, or with a stray leading symbol.
    """
    chats = B.messages(t).groupBy("conversacion_id", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("posicion", "emisor", "texto"))).alias("_m"))
    chats = chats.withColumn("mensajes", F.transform("_m", lambda m: F.struct(m["emisor"], m["texto"])))
    client = F.filter(
        F.transform("mensajes", lambda m, i: F.struct(
            (i + 1).alias("i"), m["emisor"].alias("e"), m["texto"].alias("t"))),
        lambda m: m["e"] == "cliente")
    chats = chats.withColumn("_c", F.get(client, F.lit(0)))
    return chats.withColumn("k", F.col("conv_id") % 6).select(
        F.col("conversacion_id").alias("id"), "k", "mensajes", _declared().alias("extraccion"))


def _declared() -> Column:
    k, c = F.col("k"), F.col("_c")
    start = F.substring(c["t"], 1, 15)
    none = F.array().cast(X.EV)

    def quoted(i: Column, who: str, text: Column) -> Column:
        return F.array(F.struct(
            i.cast("int").alias("mensaje"), F.lit(who).alias("emisor"), text.alias("texto")))

    evidence = (
        F.when(c.isNull() | (k == 5), none)
        .when(k == 1, quoted(c["i"], "asesor", start))
        .when(k == 2, quoted(F.lit(1_000_000), "cliente", start))
        .when(k == 4, quoted(c["i"], "cliente", F.concat(F.lit("¿"), start)))
        .otherwise(quoted(c["i"], "cliente", start)))
    state = F.when(k == 5, "no_mencionado").when(k == 3, "no_explicito").otherwise("si")
    cash = k % 2 == 0

    def signal(s: Column | None = None, ev: Column | None = None) -> Column:
        return F.struct(
            (F.lit("no_mencionado") if s is None else s).alias("estado"),
            (none if ev is None else ev).alias("evidencias"))

    def event(fields: list[str], **given: Column) -> Column:
        return F.struct(*[given.get(f, signal()).alias(f) for f in fields])

    def statement(value: Column | None = None, ev: Column | None = None) -> Column:
        return F.struct(
            (F.lit(None).cast("string") if value is None else value).alias("valor"),
            (none if ev is None else ev).alias("evidencias"))

    return F.struct(
        F.col("conversacion_id"),
        F.array().cast(S.PAYLOAD["modelos_interes"].dataType).alias("modelos_interes"),
        F.struct(*[
            F.struct(F.lit(None).cast("string").alias("expresion_original"),
                     none.alias("evidencias")).alias(f) for f in S.AMOUNT_FIELDS]).alias("dinero"),
        event(S.CREDIT_FIELDS).alias("credito"),
        statement(F.when(cash, "contado").otherwise("desconocida"),
                  F.when(cash & c.isNotNull(), quoted(c["i"], "cliente", c["t"])).otherwise(none))
        .alias("forma_pago"),
        statement().alias("intencion_declarada"),
        statement().alias("objecion_principal"),
        event(S.EVENT_FIELDS, cliente_solicito=signal(state, evidence)).alias("cita"),
        event(S.EVENT_FIELDS).alias("cotizacion"),
        F.array().cast(S.PAYLOAD["cambios_de_declaracion"].dataType).alias("cambios_de_declaracion"),
        F.array().cast(S.PAYLOAD["inconsistencias"].dataType).alias("inconsistencias"),
        F.array().cast("array<string>").alias("limitaciones"))


def verified(t: Tables) -> DataFrame:
    return X.verify_extractions(exchanges(t))


# one row per chat with its first client message and the facts the rules look at
_PAIRS = f"""SELECT conversacion_id AS id, any_value(conv_id % 6) AS k,
    arg_min(texto, posicion) FILTER (WHERE emisor = 'cliente') AS c,
    arg_min(s, posicion) FILTER (WHERE emisor = 'cliente') AS cs,
    coalesce(bool_or(emisor = 'asesor' AND regexp_matches(s, '{V.CHAT_PATTERNS["concrete_offer"]}')), false)
        AS oferta FROM folded GROUP BY 1"""
_FACTS = r"""SELECT *, substr(c, 1, 15) AS q,
    regexp_replace('¿' || substr(c, 1, 15), '^[^\p{L}\p{N}_]+', '') AS bare,
    regexp_matches(lower(strip_accents(substr(c, 1, 15))),
        '\bno\b|\bnunca\b|\bjamas\b|rechaz|niego') AS niega,
    c IS NOT NULL AND contains(cs, 'contado') AS paga,
    CASE WHEN corregido THEN ultimo_monto WHEN len(montos) = 1 THEN montos[1] END AS monto
    FROM pairs LEFT JOIN amounts USING (id)"""
# every amount a client names; a later one counts if it corrects, else they contradict each other
_AMOUNTS = f"""SELECT *, muchos AND regexp_matches(ultimo, '{V.CHAT_PATTERNS["correction"]}') AS corregido,
    muchos AND NOT regexp_matches(ultimo, '{V.CHAT_PATTERNS["correction"]}') AS conflicto FROM (
    SELECT conversacion_id AS id, list(m ORDER BY posicion) AS montos, arg_max(s, posicion) AS ultimo,
        arg_max(m, posicion) AS ultimo_monto, count(DISTINCT m) > 1 AS muchos
    FROM (SELECT *, CASE WHEN contains(s, 'tengo') AND contains(s, 'inicial')
            AND NOT regexp_matches(s, '-\\s*\\d') AND NOT regexp_matches(s, '[0-9].*[0-9]') THEN
            CASE WHEN contains(s, 'tengo 2 millones') THEN 2000000.0
                WHEN contains(s, 'tengo 3 millones') THEN 3000000.0 END END AS m
        FROM folded WHERE emisor = 'cliente') WHERE m IS NOT NULL GROUP BY 1)"""
_STATES = """SELECT *, CASE WHEN c IS NULL THEN 'no_mencionado' WHEN k IN (0, 4) THEN 'si'
    WHEN k = 3 AND niega THEN 'no_explicito' ELSE 'no_mencionado' END AS cita FROM facts"""
_CTES = {"folded": _FOLDED, "pairs": _PAIRS, "amounts": _AMOUNTS, "facts": _FACTS, "states": _STATES}


@query("h5_verified_states", B.sql("""SELECT id, cita,
    CASE WHEN cita = 'si' THEN md5(CASE WHEN k = 4 THEN bare ELSE q END) END AS intencion,
    CASE WHEN k % 2 = 0 AND paga THEN 'contado' ELSE 'desconocida' END AS forma_pago,
    CASE WHEN oferta THEN 'si' ELSE 'no_mencionado' END AS oferta,
    CASE WHEN (c IS NOT NULL AND k IN (1, 2)) OR (c IS NULL AND (k IN (0, 1, 2, 4)
        OR k % 2 = 0)) OR conflicto THEN 'requiere_revision' ELSE 'validada_automaticamente' END AS estado
    FROM states""", "messages", **_CTES))
def h5_verified_states(t: Tables) -> DataFrame:
    e = F.col("extraccion")
    return verified(t).select(
        "id", e["cita"]["cliente_solicito"]["estado"].alias("cita"),
        F.md5(e["intencion_declarada"]["valor"]).alias("intencion"),
        e["forma_pago"]["valor"].alias("forma_pago"),
        e["credito"]["asesor_ofrecio"]["estado"].alias("oferta"),
        F.col("estado_extraccion").alias("estado"))


@query("h4_incidents", B.sql("""SELECT id, concat_ws(',',
    CASE WHEN oferta THEN 'oferta_explicita_recuperada' END,
    CASE WHEN k % 2 = 0 AND c IS NULL THEN 'valor_sin_evidencia'
        WHEN k % 2 = 0 AND NOT paga THEN 'forma_pago_no_declarada' END,
    CASE WHEN cita = 'si' THEN 'frase_explicita_recuperada' END,
    CASE WHEN c IS NOT NULL AND k IN (1, 2) THEN 'evidencia_invalida,estado_sin_evidencia'
        WHEN c IS NOT NULL AND k = 4 THEN 'formato_cita_reparado'
        WHEN c IS NOT NULL AND k = 3 AND NOT niega THEN 'negativa_no_sustentada'
        WHEN c IS NULL AND k <> 5 THEN 'estado_sin_evidencia' END,
    CASE WHEN corregido THEN 'cambio_importe_explicito' WHEN conflicto THEN 'importes_contradictorios'
        WHEN monto IS NOT NULL THEN 'importe_explicito_recuperado' END) AS tipos FROM states""",
    "messages", **_CTES))
def h4_incidents(t: Tables) -> DataFrame:
    return verified(t).select(
        "id", F.array_join(F.transform("incidencias", lambda i: i["tipo"]), ",").alias("tipos"))


@query("h13_recovered_amounts", B.sql("SELECT id, monto AS valor, monto IS NOT NULL AS con_cita "
                                      "FROM states", "messages", **_CTES))
def h13_recovered_amounts(t: Tables) -> DataFrame:
    m = F.col("extraccion.dinero.cuota_inicial")
    return verified(t).select(
        "id", m["valor"].alias("valor"), (F.size(m["evidencias"]) > 0).alias("con_cita"))


@query("h3_evidence_rows", B.sql("""SELECT id AS conversacion_id, 'forma_pago' AS ruta, md5(c) AS cita
        FROM states WHERE k % 2 = 0 AND c IS NOT NULL
    UNION ALL SELECT id, 'cita.cliente_solicito', md5(CASE WHEN k = 4 THEN '¿' || q ELSE q END)
        FROM states WHERE k <> 5 AND c IS NOT NULL""", "messages", **_CTES))
def h3_evidence_rows(t: Tables) -> DataFrame:
    return X.evidence_rows(exchanges(t)).select(
        "conversacion_id", "ruta", F.md5("texto").alias("cita"))


@query("b32_invalid_evidence", B.sql("""SELECT id AS conversacion_id, k FROM states
    WHERE c IS NOT NULL AND k IN (1, 2, 4) AND (k <> 4 OR NOT contains(c, '¿' || q))""",
    "messages", **_CTES))
def b32_invalid_evidence(t: Tables) -> DataFrame:
    chats = exchanges(t)
    messages = chats.select(F.col("id").alias("conversacion_id"), F.posexplode("mensajes")).select(
        "conversacion_id", (F.col("pos") + 1).alias("posicion"), "col.emisor", "col.texto")
    wrong = X.evidence_violations(X.evidence_rows(chats), messages)
    return wrong.join(chats.select(F.col("id").alias("conversacion_id"), "k"), "conversacion_id"
                      ).select("conversacion_id", "k")


@query("h21_flat_signals", B.sql("""SELECT id AS conversacion_id, CASE cita WHEN 'si' THEN true
        WHEN 'no_explicito' THEN false END AS cliente_pidio_cita, monto AS cuota_inicial,
    CASE WHEN k % 2 = 0 AND paga THEN 'contado' END AS forma_pago,
    CASE WHEN oferta THEN true END AS asesor_ofrecio_credito FROM states
    WHERE NOT ((c IS NOT NULL AND k IN (1, 2)) OR (c IS NULL AND (k IN (0, 1, 2, 4)
        OR k % 2 = 0)) OR coalesce(conflicto, false))""", "messages", **_CTES))
def h21_flat_signals(t: Tables) -> DataFrame:
    return X.flat_signals(verified(t)).select(
        "conversacion_id", "cliente_pidio_cita", "cuota_inicial", "forma_pago",
        "asesor_ofrecio_credito")


@query("h1_contract", B.sql("""SELECT id, CASE WHEN k = 0 THEN 'claves:raiz' WHEN k = 1
    THEN 'valor:forma_pago' END AS violaciones FROM states WHERE k IN (0, 1)""", "messages", **_CTES))
def h1_contract(t: Tables) -> DataFrame:
    chats = exchanges(t)
    raw = F.to_json("extraccion", {"ignoreNullFields": "false"})
    broken = (
        F.when(F.col("k") == 0, F.regexp_replace(raw, r"^\{", '{"sorpresa":1,'))
        .when(F.col("k") == 1, F.replace(
            raw, F.lit('"forma_pago":{"valor":"desconocida"'),
            F.lit('"forma_pago":{"valor":"trueque"')))
        .otherwise(raw))
    out = X.contract_violations(chats.withColumn("crudo", broken), "crudo", "id")
    return out.select("id", F.array_join("violaciones", ",").alias("violaciones"))


@query("h25_amount_audit", B.sql("""SELECT id AS conversacion_id, monto AS obtenido FROM states
    WHERE c IS NOT NULL AND monto IS NOT NULL AND NOT muchos""", "messages", **_CTES))
def h25_amount_audit(t: Tables) -> DataFrame:
    audit = X.amount_audit(verified(t))
    return audit.where(F.col("cumple") & F.col("obtenido").isNotNull()).select(
        "conversacion_id", "obtenido")


@query("h28_incident_log", B.sql("""SELECT id AS conversacion_id, count(*) AS eventos FROM (
        SELECT id, unnest(string_split(concat_ws(',',
            CASE WHEN oferta THEN 'o' END,
            CASE WHEN k % 2 = 0 AND (c IS NULL OR NOT paga) THEN 'p' END,
            CASE WHEN cita = 'si' THEN 'f' END,
            CASE WHEN c IS NOT NULL AND k IN (1, 2) THEN 'e,s' WHEN c IS NOT NULL AND k = 4 THEN 'r'
                WHEN c IS NOT NULL AND k = 3 AND NOT niega THEN 'n' WHEN c IS NULL AND k <> 5
                THEN 's' END,
            CASE WHEN monto IS NOT NULL OR conflicto THEN 'm' END, 'empresa'), ',')) AS tipo FROM states)
    GROUP BY 1""", "messages", **_CTES))
def h28_incident_log(t: Tables) -> DataFrame:
    unlinked = verified(t).withColumns({
        "empresa_id": F.lit(None).cast("string"), "lead_id": F.lit(None).cast("string")})
    none = unlinked.select(F.col("id").alias("conversacion_id")).where(F.lit(False))
    return X.incident_log(unlinked, none).groupBy("conversacion_id").agg(
        F.count(F.lit(1)).alias("eventos"))
