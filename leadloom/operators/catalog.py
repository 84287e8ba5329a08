"""Catalogue matching, availability and mention lookup."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import alnum_key, ascii_fold, col, model_key
from leadloom.operators.checks import left_join_sparse
from leadloom.session import cut_lineage

GRAM = 8
#: Size of the filter of grams; the hits that a task hands on at a time.
FILTER_BITS, HITS = 25, 100_000
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def reference_keys(catalogue: DataFrame) -> DataFrame:
    """Every key that names a catalogue row: its full name, its line, and their word prefixes.

    One row per (clave, sku) with ``exacta`` true for whole names, so a prefix search becomes an
    equality join.
    """
    # dealt by product first: a small file is one task, and its keys are several times its rows
    named = catalogue.select("sku", "marca", "linea", F.concat_ws(" ", "marca", "linea").alias("nombre"))
    base = named.repartition("sku", "nombre").groupBy(
        "sku", "nombre", model_key("marca").alias("marca_clave")).agg(
        F.collect_set(model_key("linea")).alias("lineas")).withColumn("completo", model_key("nombre"))

    def prefixes(key):
        words = F.split(key, " ")
        return F.when(
            F.size(words) > 1,
            F.transform(
                F.sequence(F.lit(1), F.size(words) - 1),
                lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")),
        ).otherwise(F.array().cast("array<string>"))

    every = F.array_compact(F.array_distinct(F.concat(F.array("completo"), "lineas")))
    entries = base.select("sku", "nombre", "marca_clave", every.alias("_whole")).withColumn(
        "_begun", F.array_except(F.flatten(F.transform("_whole", prefixes)), "_whole"))

    def marked(keys, whole: bool):
        return F.transform(keys, lambda k: F.struct(k.alias("clave"), F.lit(whole).alias("exacta")))

    return entries.select(
        "sku", "nombre", "marca_clave", F.inline(F.concat(marked("_whole", True), marked("_begun", False)))
    ).select("clave", "sku", "nombre", "marca_clave", "exacta")


def match_table(catalogue: DataFrame) -> DataFrame:
    """One row per key with the decision it leads to."""
    keys = reference_keys(catalogue)
    # whole names before beginnings, so the greatest is the only one where there is only one
    decided = keys.groupBy("clave").agg(
        F.count_if("exacta").alias("_exact"),
        F.count(F.lit(1)).alias("_all"),
        F.max(F.struct("exacta", "sku", "nombre", (F.col("clave") != F.col("marca_clave")).alias("_more"))).alias("_one"),
    )
    exact = F.col("_exact") > 0
    n = F.when(exact, F.col("_exact")).otherwise(F.col("_all"))
    one = F.col("_one")
    unique = (n == 1) & one["_more"]
    return decided.select(
        "clave",
        F.when(unique, one["sku"]).alias("modelo_sku"),
        F.when(unique, one["nombre"]).alias("modelo_normalizado"),
        F.when(unique, F.when(exact, "coincidencia_exacta").otherwise("abreviatura_unica"))
        .otherwise("ambiguo")
        .alias("modelo_estado"),
        n.cast("bigint").alias("candidatos"),
    )


def match_models(df: DataFrame, text: str, catalogue: DataFrame) -> DataFrame:
    """Add ``modelo_sku, modelo_normalizado, modelo_estado, candidatos`` for a free text."""
    keyed = df.withColumn("clave", model_key(text))
    joined = left_join_sparse(keyed, match_table(catalogue), ["clave"])
    return joined.withColumns({
        "modelo_estado": F.when(F.col("clave").isNull(), "faltante").otherwise(
            F.coalesce("modelo_estado", F.lit("sin_coincidencia"))),
        "candidatos": F.coalesce("candidatos", F.lit(0).cast("bigint")),
    }).drop("clave")


def candidates_by_key(df: DataFrame, text: str, catalogue: DataFrame) -> DataFrame:
    """(clave, sku, nombre): the candidates of every key that the texts ask for, listed once.

    A text that names only a brand asks for every model of it, so the lists are kept per distinct
    key; a row reaches its list by its key and carries the count (:func:`match_models`).
    """
    asked = df.select(model_key(text).alias("clave")).distinct()
    # the size of the catalogue says little about the number of its keys, so none are broadcast
    wanted = reference_keys(catalogue).hint("merge").join(asked, "clave")
    exact_keys = wanted.groupBy("clave").agg(F.bool_or("exacta").alias("_any"))
    return wanted.hint("merge").join(exact_keys, "clave").where(F.col("exacta") | ~F.col("_any")).select(
        "clave", "sku", "nombre")


def availability_state(
    inquiries: DataFrame, skus: DataFrame, owned_sites: DataFrame, availability: DataFrame
) -> DataFrame:
    """Whether the wanted model is listed at the assigned site, as one of five states."""
    known = skus.select(F.col("sku").alias("modelo_sku")).distinct().withColumn("_k", F.lit(True))
    pairs = owned_sites.select("empresa_id", "punto_venta_id").dropna().distinct().withColumn(
        "_p", F.lit(True))
    listed = availability.select(
        F.col("sku").alias("modelo_sku"), "punto_venta_id"
    ).dropna().distinct().withColumn("_a", F.lit(True))
    joined = left_join_sparse(inquiries, known, ["modelo_sku"])
    joined = left_join_sparse(joined, pairs, ["empresa_id", "punto_venta_id"])
    joined = left_join_sparse(joined, listed, ["modelo_sku", "punto_venta_id"])
    return joined.withColumn(
        "disponibilidad",
        F.when(F.col("modelo_sku").isNull(), "no_evaluable_modelo_pendiente")
        .when(F.col("_k").isNull(), "no_evaluable_sku_desconocido")
        .when(F.col("_p").isNull(), "no_evaluable_empresa_punto")
        .when(F.col("_a").isNotNull(), "listado_en_punto")
        .otherwise("no_listado_en_punto"),
    ).drop("_k", "_p", "_a")


def tenant_catalogue(catalogue: DataFrame, availability: DataFrame, sites: DataFrame) -> DataFrame:
    """Products each company can offer through its own sites."""
    owned = sites.select("punto_venta_id", "empresa_id")
    pairs = availability.join(owned, "punto_venta_id").select("empresa_id", "sku").distinct()
    return pairs.join(catalogue, "sku")


def unique_mentions(catalogue: DataFrame) -> DataFrame:
    """Mention key -> sku, null when several catalogue rows share the key."""
    key = alnum_key(F.concat_ws(" ", "marca", "linea"))
    return catalogue.groupBy(key.alias("clave")).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("sku")).alias("sku"),
        F.count(F.lit(1)).alias("referencias"),
    )


def resolve_mentions(mentions: DataFrame, text: str, catalogue: DataFrame) -> DataFrame:
    """Attach the unique sku of each mention, null when there is none or more than one."""
    keyed = mentions.withColumn("clave", alnum_key(F.coalesce(col(text), F.lit(""))))
    return keyed.join(
        unique_mentions(catalogue).select("clave", "sku"), "clave", "left").drop("clave")


def _places(text: bytes) -> np.ndarray:
    """The ``GRAM`` bytes from every place of an ASCII text as one number, zeros after its end."""
    padded = np.frombuffer(text + bytes(GRAM), dtype=np.uint8).astype(np.uint64)
    at = np.zeros(len(text), dtype=np.uint64)
    for k in range(GRAM):
        at = (at << np.uint64(8)) | padded[k : k + len(text)]
    return at


def _slots(places: np.ndarray, n: int) -> np.ndarray:
    """Places of the filter for the grams of ``n`` bytes."""
    return ((places >> np.uint64(8 * (GRAM - n))) * _MIX + np.uint64(n) * _MIX2) >> np.uint64(64 - FILTER_BITS)


def _gram_filter(grams: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of the grams, 4 MB whatever their number; built in pages."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [int(_slots(_places(g.encode("ascii"))[:1], len(g))[0]) for g in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], names=["slot"])

    one = F.col("slot") + 1  # pages and bits count from one
    pages = grams.select("_gram").mapInArrow(mark, "slot bigint").groupBy(
        F.bitmap_bucket_number(one).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for row in pages.toLocalIterator():
        page = np.frombuffer(row["bits"], dtype=np.uint8)
        bits[(row["page"] - 1) * len(page) : row["page"] * len(page)] = page
    return bits


def _seen_grams(folded: DataFrame, bits, lengths: list[int], before: int, after: int) -> DataFrame:
    """keys, _gram, _at, _near: places of the texts whose gram may be one of a name, with what is around them."""
    *keys, _ = folded.columns

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value

        def found(rows: list[int], out: list[tuple[str, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(rows, pa.int64())) for c in range(len(keys))],
                 pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                 pa.array([o[2] for o in out], pa.string())], names=[*keys, "_gram", "_at", "_near"])

        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                places = _places(text.encode("ascii"))
                for n in lengths:
                    slots = _slots(places[: max(0, len(text) - n + 1)], n)
                    hits = np.flatnonzero((held[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1)
                    for i in hits.tolist():
                        first = max(0, i - before)
                        rows.append(row)
                        out.append((text[i : i + n], i - first, text[first : i + after]))
                if len(out) >= HITS:
                    yield found(rows, out)
                    rows, out = [], []
            yield found(rows, out)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in folded.schema.fields[:-1])
    return folded.mapInArrow(seek, f"{shape}, _gram string, _at int, _near string")


def names_in_text(texts: DataFrame, row_id: str, text: str, catalogue: DataFrame, each_row: bool = True) -> DataFrame:
    """(row_id, sku) where the folded catalogue name occurs inside the folded text.

    Once for every text that has the name, or with ``each_row`` false once per id. Every name is
    known by its rarest gram. The texts stay where they are: a filter of a fixed size tells the
    places that may have such a gram, and only those travel, with as much around them as the
    longest name needs. The part of the text that a name would fill is then joined with the names
    themselves, so texts meet neither names that only share a gram nor the products of one name.
    """
    named = catalogue.select("sku", ascii_fold(F.concat_ws(" ", "marca", "linea")).alias("_name")).where(
        F.length("_name") > 0).repartition("_name").distinct()
    # the gram of a name that fewest names share: the brand in front is common to many
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_name") - (GRAM - 1), F.lit(1))),
        lambda i: F.substring(F.col("_name"), i, F.lit(GRAM)))
    every = named.select("_name").distinct().select("_name", F.explode(F.array_distinct(cuts)).alias("_gram"))
    shared = every.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    known = cut_lineage(every.hint("merge").join(shared, "_gram").groupBy("_name").agg(
        F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram")).select(
        "_name", "_gram", (F.instr("_name", F.col("_gram")) - 1).alias("_off"), F.length("_name").alias("_len")))
    # at most GRAM different lengths, whatever the size of the catalogue
    sizes = known.groupBy(F.length("_gram").alias("n")).agg(
        F.max("_off").alias("before"), F.max(F.col("_len") - F.col("_off")).alias("after")).collect()
    if not sizes:
        return texts.select(row_id, F.lit(None).cast("string").alias("sku")).where("false")

    # rows are told apart by id and text; equal ones are found once and counted
    keys = [row_id, "_text"] if each_row else [row_id]
    rows = texts.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).withColumn("_text", F.xxhash64(text))
    folded = rows.select(*keys, ascii_fold(text).alias("_t"))
    bits = texts.sparkSession.sparkContext.broadcast(_gram_filter(known.select("_gram").distinct()))
    places = _seen_grams(
        folded, bits, sorted(r["n"] for r in sizes), max(r["before"] for r in sizes), max(r["after"] for r in sizes))
    shapes = known.select("_gram", "_off", "_len").distinct()
    filled = F.substring(F.col("_near"), F.col("_at") - F.col("_off") + 1, F.col("_len"))
    said = places.join(shapes, "_gram").where(F.col("_at") >= F.col("_off")).select(*keys, filled.alias("_name"))
    found = said.join(known.select("_name"), "_name").select(*keys, "_name").distinct()
    if each_row:
        copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        times = F.coalesce("_n", F.lit(1)).cast("int")
        found = found.join(copies, keys, "left").withColumn(
            "_copy", F.explode(F.sequence(F.lit(1), times)))
    out = found.join(named, "_name").select(row_id, "sku")
    return out if each_row else out.distinct()


# worker functions travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
