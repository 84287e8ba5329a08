"""Benchmark decontamination by winnowed word fingerprints, on DataFrames only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import ascii_lower, written

#: What parts words here: every ASCII character but digits and letters (A-Z are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Consecutive words of an item that must occur in a document.
SPAN = 10
#: Words in a hashed gram. With a gram kept for every SPAN - GRAM + 1 grams, each shared span of
#: SPAN words shares a kept gram.
GRAM = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _mins(words: Column, gram: int, span: int) -> Column:
    """Least gram hash, from ``_grams``, of every window of ``span`` words, by window start."""
    grams, held = F.col("_grams"), span - gram + 1
    starts = F.when(grams.isNotNull(), F.sequence(F.lit(0), F.greatest(F.size(words) - span, F.lit(0))))
    if held == 1:
        return F.transform(starts, lambda j: F.get(grams, j))
    return F.transform(starts, lambda j: F.least(*[F.get(grams, j + k) for k in range(held)]))


def _fingerprints(df: DataFrame, keep: list[str], gram: int, span: int) -> DataFrame:
    """One row per kept gram of a row's ``_words``: ``start``, ``mark`` and the words ``near`` it.

    A gram is kept once for the consecutive windows in which it is the least, at most ``span -
    gram + 1`` of them; those windows lie inside ``near``.
    """
    words, held = F.col("_words"), span - gram + 1
    # Shorter rows have no grams, no windows and no marks; a filter would split their text twice.
    grams = F.when(
        F.size(words) >= span,
        F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, gram)])),
    )
    mins = df.select(*keep, "_words", grams.alias("_grams")).select(
        *keep, "_words", _mins(words, gram, span).alias("_mins")
    )
    m = F.col("_mins")
    fresh = lambda j: (
        (j == 0) | (F.get(m, j) != F.get(m, j - 1)) | F.get(m, j).eqNullSafe(F.get(m, j - held))
    )
    starts = F.filter(F.when(m.isNotNull(), F.sequence(F.lit(0), F.size(m) - 1)), fresh)
    marks = F.transform(
        starts,
        lambda j: F.struct(
            j.alias("start"), F.get(m, j).alias("mark"), F.slice(words, j + 1, span + held - 1).alias("near")
        ),
    )
    return mins.select(*keep, F.explode(marks).alias("_f")).select(*keep, "_f.*")


def _windows(near: Column, span: int) -> Column:
    """(offset, text) of the whole windows of ``span`` words inside ``near``."""
    return F.transform(
        F.sequence(F.lit(0), F.size(near) - span),
        lambda c: F.struct(c.alias("offset"), F.array_join(F.slice(near, c + 1, span), " ").alias("window")),
    )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Written table of span, mark, window, items: every window of every item with a word.

    ``mark`` is the least gram hash of the window. Items of fewer than ``SPAN`` words are one
    window, marked by the hash of all their words.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    whole = items.where(F.size("_words") >= SPAN)
    grams = F.transform(
        "_words", lambda w, i: F.xxhash64(w, *[F.get(F.col("_words"), i + k) for k in range(1, GRAM)])
    )
    marked = whole.select("item_id", "_words", grams.alias("_grams")).select(
        "item_id", "_words", _mins(F.col("_words"), GRAM, SPAN).alias("_mins")
    )
    long = marked.select(
        "item_id",
        F.lit(SPAN).alias("span"),
        F.explode(
            F.transform(
                "_mins",
                lambda m, j: F.struct(
                    m.alias("mark"), F.array_join(F.slice("_words", j + 1, SPAN), " ").alias("window")
                ),
            )
        ).alias("_w"),
    ).select("item_id", "span", "_w.*")
    short = reduce(
        DataFrame.unionByName,
        [
            items.where(F.size("_words") == n).select(
                "item_id",
                F.lit(n).alias("span"),
                F.xxhash64(*[F.get("_words", F.lit(k)) for k in range(n)]).alias("mark"),
                F.array_join("_words", " ").alias("window"),
            )
            for n in range(1, SPAN)
        ],
    )
    return written(
        long.unionByName(short)
        .groupBy("span", "mark", "window")
        .agg(F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items")),
        "windows",
    )


def hits(docs: DataFrame, benchmark: DataFrame, key: list[str]) -> DataFrame:
    """One row per document with a hit: ``key``, n_hit, items (sorted texts).

    ``docs`` has ``key`` and ``text``. The kept grams of documents and items meet in a join on
    their hash; each match is extended to the windows around it, which are then compared as text,
    so the result is exact. Both item tables are written first and broadcast only if Spark finds
    their size below its threshold; beyond it they are shuffled, and adaptive execution splits a
    gram or passage that very many documents share. Grams without a match never leave their task
    when the item side is broadcast. Rows alike in ``key`` must have the same text.
    """
    windows = item_windows(benchmark)
    # at most SPAN lengths
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())
    found = []
    for span in spans:
        gram = GRAM if span == SPAN else span
        own = windows.where(F.col("span") == span)
        marks = own.select("mark").distinct()
        worded = docs.select(*key, words_of(F.col("text")).alias("_words"))
        near = _fingerprints(worded, key, gram, span).join(marks, "mark", "left_semi")
        tried = near.select(*key, "start", F.explode(_windows(F.col("near"), span)).alias("_w"))
        tried = tried.select(
            *key, F.struct((F.col("start") + F.col("_w.offset")).alias("start"), F.lit(span).alias("span")).alias("at"),
            F.col("_w.window").alias("window"),
        )
        found.append(tried.join(own.select("window", "items"), "window").select(*key, "at", "items"))
    if not found:
        empty = docs.where(F.lit(False))
        return empty.select(*key, F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    everything = reduce(DataFrame.unionByName, found)
    by_doc = everything.groupBy(*key).agg(
        F.sort_array(F.collect_set("at")).alias("_at"), F.collect_set("items").alias("_items")
    )
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, w: F.struct(
            (acc["n"] + F.greatest(F.lit(0), w["start"] + w["span"] - F.greatest(w["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], w["start"] + w["span"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    return by_doc.select(
        *key, covered.cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """Id and text as one number: rows alike in both have the same hits."""
    return docs.withColumn("_rid", F.xxhash64("doc_id", "text"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted texts), contaminated.

    A document word inside any occurrence of an item window is hit. Null and empty texts have no
    words; items without words have no windows; a null item id counts as the empty text. Repeated
    rows give repeated results; an empty table on either side gives no hits. Columns other than
    doc_id, item_id and text are not read.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    found = hits(keyed, benchmark, ["_rid"])
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP_ANY_CASE), ""))
    left = keyed.select("doc_id", "_rid", n_words.cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return left.join(found, "_rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns."""
    found = hits(_keyed(docs.select("doc_id", "text")), benchmark, ["_rid"]).select("_rid")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_rid"), F.struct(*docs.columns).alias("_row"))
    return rows.join(found, "_rid", "left_anti").select("_row.*")


def _words_sql(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(regexp_split_to_array({lowered}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql("text")} AS words FROM documents),
b AS (SELECT item_id, {_words_sql("text")} AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), {SPAN}) AS span, list_slice(words, i, i + least(len(words), {SPAN}) - 1) AS win
       FROM b, unnest(range(1, greatest(len(words) - {SPAN - 1}, 1) + 1)) AS t(i) WHERE len(words) > 0),
spans AS (SELECT DISTINCT span FROM bw),
dw AS (SELECT rid, i AS pos, span, list_slice(words, i, i + span - 1) AS win
       FROM d, spans, unnest(range(1, len(words) - span + 2)) AS t(i)),
hit AS (SELECT rid, pos, span, item_id FROM dw JOIN bw USING (span, win)),
n AS (SELECT rid, count(DISTINCT pos + k) AS n_hit FROM (SELECT DISTINCT rid, pos, unnest(range(0, span)) AS k FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
