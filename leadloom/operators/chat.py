"""Message-level operators over flat chats: nearest messages, source contradictions, discards.

Every running value goes through ``with_running``, so a very long chat is cut into chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.money import listed_price, money
from leadloom.functions.text import ascii_fold
from leadloom.operators.ranking import Running, with_running

CHUNK = 4096
CHAT = ["conversacion_id"]


def _chunk():
    return F.floor(F.col("posicion") / CHUNK)


def previous_advisor_text(messages: DataFrame) -> DataFrame:
    """Last advisor message before each message of the chat."""
    advisor = F.when(F.col("emisor") == "asesor", F.col("texto"))
    return with_running(
        messages, CHAT, ["posicion"], _chunk(), {"asesor_previo": Running("last", advisor)})


def neighbouring_prices(messages: DataFrame) -> DataFrame:
    """Nearest priced advisor message before and after each message."""
    priced = messages.withColumn("_price", F.when(
        F.col("emisor") == "asesor", listed_price("texto").cast("double")))
    at = F.when(F.col("_price").isNotNull(), F.struct("posicion", "_price"))
    out = with_running(
        priced, CHAT, ["posicion"], _chunk(),
        {"antes": Running("last", at), "despues": Running("next", at)})
    return out.select(
        *messages.columns,
        F.col("antes.posicion").alias("posicion_antes"), F.col("antes._price").alias("precio_antes"),
        F.col("despues.posicion").alias("posicion_despues"),
        F.col("despues._price").alias("precio_despues"))


def last_payment_declaration(messages: DataFrame) -> DataFrame:
    """Latest client payment declaration before each message: where, and whether it was cash."""
    s = ascii_fold("texto")
    declared = F.when(
        (F.col("emisor") == "cliente") & s.rlike(V.CHAT_PATTERNS["payment_declaration"]),
        F.struct("posicion", s.contains("de contado").alias("contado")))
    out = with_running(
        messages, CHAT, ["posicion"], _chunk(), {"pago": Running("last", declared)})
    return out.select(*messages.columns, F.col("pago.posicion").alias("posicion_pago"),
                      F.col("pago.contado").alias("contado"))


def declared_initial_before(messages: DataFrame) -> DataFrame:
    """Whether the client had named an initial amount before each message."""
    m = money("texto")
    named = (
        (F.col("emisor") == "cliente") & ascii_fold("texto").contains("inicial")
        & F.coalesce(m["valor"], m["minimo"], m["maximo"]).isNotNull()
    )
    return with_running(
        messages, CHAT, ["posicion"], _chunk(),
        {"inicial_previa": Running("max", F.coalesce(named, F.lit(False)).cast("int"))},
    ).withColumn("inicial_previa", F.coalesce("inicial_previa", F.lit(0)) > 0)


def source_contradictions(messages: DataFrame) -> DataFrame:
    """Contradictions visible in the source itself: (conversacion_id, tipo, posicion, ...).

    One pass over the messages carries the declared initial, the last payment declaration and the
    neighbouring prices; the three rules are filters on it.
    """
    client, advisor = F.col("emisor") == "cliente", F.col("emisor") == "asesor"
    s = F.col("_s")
    base = messages.select(*CHAT, "posicion", "emisor", "texto").withColumns({
        "_s": ascii_fold("texto")})
    base = base.withColumns({
        "_m": F.when(client & s.contains("inicial"), money("texto")),
        "_price": F.when(advisor, listed_price("texto").cast("double")),
    })
    priced = F.when(F.col("_price").isNotNull(), F.struct("posicion", "_price"))
    named = F.coalesce(F.col("_m.valor"), F.col("_m.minimo"), F.col("_m.maximo")).isNotNull()
    paid = F.when(
        client & s.rlike(V.CHAT_PATTERNS["payment_declaration"]),
        F.struct("posicion", s.contains("de contado").alias("contado")))
    ctx = with_running(
        base.drop("texto").withColumns({"_named": named.cast("int"), "_at": priced, "_paid": paid})
        .drop("_m", "_price"),
        CHAT, ["posicion"], _chunk(),
        {
            "inicial": Running("max", F.col("_named")),
            "pago": Running("last", F.col("_paid")),
            "antes": Running("last", F.col("_at")),
            "despues": Running("next", F.col("_at")),
        },
    )
    none = F.lit(None).cast("bigint")

    def finding(kind: str, when, first, last):
        return F.when(when, F.struct(
            F.lit(kind).alias("tipo"), first.cast("bigint").alias("desde"),
            last.cast("bigint").alias("hasta"), F.lit(V.SOURCE_FINDINGS[kind]).alias("descripcion")))

    at = F.col("posicion")
    found = F.array_compact(F.array(
        finding("referencia_a_inicial_no_declarada",
                advisor & s.contains("con esa inicial") & (F.coalesce("inicial", F.lit(0)) == 0),
                none, at),
        finding("estudio_credito_tras_contado",
                advisor & s.contains("estudio de credito") & F.col("pago.contado"),
                F.col("pago.posicion"), at),
        finding("alternativa_mas_economica_con_precio_superior",
                client & s.contains("mas economico")
                & (F.col("despues._price") > F.col("antes._price")),
                F.col("antes.posicion"), F.col("despues.posicion")),
    ))
    return ctx.select(*CHAT, "posicion", F.inline(found))


def amount_candidates(messages: DataFrame) -> DataFrame:
    """Client statements of an initial or a total amount that convert to a value."""
    s, m = F.col("_s"), F.col("_m")
    kind = F.when(s.startswith(V.CASH_READY_PREFIX), "presupuesto_total").when(
        s.contains("tengo") & s.contains("inicial"), "cuota_inicial")
    return (
        messages.where(F.col("emisor") == "cliente")
        .withColumn("_s", ascii_fold("texto"))
        .withColumn("campo", kind)
        .where(F.col("campo").isNotNull())
        .withColumn("_m", money("texto"))
        .where(m["error"].isNull())
        .select(*CHAT, "posicion", "campo", "texto", "_m.valor", "_m.minimo", "_m.maximo",
                s.rlike(V.CHAT_PATTERNS["correction"]).alias("corrige"))
    )


def settled_amounts(candidates: DataFrame) -> DataFrame:
    """One decision per chat and field: unique, corrected (the last stays) or contradictory."""
    value = F.struct("valor", "minimo", "maximo")
    grouped = candidates.groupBy(*CHAT, "campo").agg(
        F.count(F.lit(1)).alias("declaraciones"),
        F.countDistinct(F.coalesce("valor", F.lit(-1.0)), F.coalesce("minimo", F.lit(-1.0)),
                        F.coalesce("maximo", F.lit(-1.0))).alias("_n"),
        F.max_by(F.struct(value.alias("v"), "corrige"), F.col("posicion")).alias("_last"),
    )
    many, fixed = F.col("_n") > 1, F.col("_last.corrige")
    keep = ~many | fixed
    return grouped.select(
        *CHAT, "campo", "declaraciones",
        F.when(~many, "importe_unico").when(fixed, "cambio_importe_explicito")
        .otherwise("importes_contradictorios").alias("decision"),
        *[F.when(keep, F.col(f"_last.v.{c}")).alias(c) for c in ("valor", "minimo", "maximo")])


def discard_split(chats: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable chats and discarded chats, by the presence of any reason."""
    flagged = reasons.select(*CHAT).distinct()
    return (
        chats.join(flagged, CHAT, "left_anti"),
        chats.join(flagged, CHAT, "left_semi").withColumn("politica", F.lit(V.DISCARD_POLICY)),
    )


def chat_fingerprint(messages: DataFrame, config: str) -> DataFrame:
    """Order-sensitive content digest per chat plus the extraction configuration.

    Each message is digested with its position; the digests are added up exactly, so a long chat
    is aggregated partially and never collected.
    """
    row = F.sha2(F.to_json(F.struct("posicion", "emisor", "texto")), 256)
    part = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in (0, 1)]
    return messages.groupBy(*CHAT).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(part[0]).alias("_a"), F.sum(part[1]).alias("_b")
    ).select(*CHAT, F.sha2(F.concat_ws(
        "|", F.lit(config), F.col(CHAT[0]), *[F.col(c).cast("string") for c in ("_n", "_a", "_b")]
    ), 256).alias("huella"))


def reuse_cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats whose fingerprint has a stored result (links refreshed from ``wanted``) and misses."""
    hits = wanted.join(cache.select("huella", "resultado"), "huella")
    return hits, wanted.join(cache.select("huella"), "huella", "left_anti")


def adopt_if_better(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keep a repeated extraction only when it has strictly fewer technical errors."""
    n = new.select(*CHAT, F.struct(*[c for c in new.columns if c not in CHAT]).alias("_new"))
    better = F.col("_new.errores") < F.col("errores")
    better = F.coalesce(better, F.lit(False))
    joined = old.join(n, CHAT, "left")
    return joined.select(
        *CHAT,
        *[F.when(better, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
          for c in old.columns if c not in CHAT],
        better.alias("adoptada"))
