"""Near copies: five-word shingle sets whose Jaccard similarity is 0.8 or more."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import simhash
from leadloom.llm.common import written
from leadloom.llm.simhash import centres

SHINGLE = 5
SEED = 42
#: Least similarity, as a fraction of whole numbers.
ALIKE = (4, 5)
#: Sets meet if all minima of one band are equal. Two sets of similarity 0.8 miss each other in
#: every band with a chance of (1 - 0.8 ** 5) ** 25, about 5 in 100,000.
BANDS, ROWS = 25, 5
#: Shingles whose permuted hashes are held at a time.
HELD = 1 << 12

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    runs = range(max(1, len(words) - SHINGLE + 1)) if words else ()
    return np.unique(np.array([digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in runs], dtype=np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """One key per band, signed; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), HELD):
        least = np.minimum(least, (found[at : at + HELD] * _FACTORS + _ADDED).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _row_id() -> Column:
    return F.xxhash64("doc_id", "text")


def _marked(docs: DataFrame) -> DataFrame:
    """rid, doc_id, node, n, fp, keys: one row per row; rows of one shingle set have one ``node``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                prints.append(simhash.majority(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["rid", "doc_id", "node", "n", "fp", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(_row_id().alias("rid"), "doc_id", "text")
    return rows.mapInArrow(mark, f"rid bigint, doc_id {kind}, node bigint, n bigint, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles: the sets of the rows whose ids are ``wanted``, read again from their texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    rows = docs.select(_row_id().alias("rid"), "text").join(wanted, "rid").select("node", "text")
    return rows.mapInArrow(read, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _near_in_size(n: Column, other: Column) -> Column:
    """Sets further apart in size cannot be alike."""
    return ALIKE[1] * F.least(n, other) >= ALIKE[0] * F.greatest(n, other)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike, by an exact count of what they share."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    either = F.size("_a") + F.size("_b") - common
    return pairs.join(right, "b").join(left, "a").where(ALIKE[1] * common >= ALIKE[0] * either).select("a", "b")


def _hubs(met: DataFrame) -> DataFrame:
    """key, _hub: per bucket the set that agrees most with the majority.

    A set's agreement is how many sets it meets over all its bands. In a group of copies their source
    keeps most of the common minima, so it is in the large bucket of most bands.
    """
    agreed = met.groupBy("node").agg(F.sum("_m").alias("_met"))
    return met.join(agreed, "node").groupBy("key").agg(F.max(F.struct("_met", "node", "n")).alias("_hub"))


def _rare_first(loose: DataFrame, sets: DataFrame) -> DataFrame:
    """token, node, part, n, pos: the beginning of every set, its rarest shingles first.

    Of two alike sets of n shingles and m, at least 4 / 9 * (n + m) are shared, so the first of the
    shared ones in this order stands among the first n - 0.8 n + 1.
    """
    ones = loose.join(sets, "node").select("node", "part", "n", F.explode("shingles").alias("token"))
    often = ones.groupBy("token").agg(F.count(F.lit(1)).alias("_often"), F.min("part").alias("_l"), F.max("part").alias("_h"))
    sorted_ = F.array_sort(F.collect_list(F.struct("_often", "token", "_across")))
    known = ones.join(often.withColumn("_across", F.col("_l") < F.col("_h")), "token")
    whole = known.groupBy("node", "part", "n").agg(sorted_.alias("_all"))
    first = F.col("n") - F.ceil(F.col("n") * ALIKE[0] / ALIKE[1]) + 1
    cut = whole.select("node", "part", "n", F.posexplode(F.slice("_all", F.lit(1), first.cast("int"))).alias("pos", "_t"))
    return cut.where("_t._across").select("node", "part", "n", "pos", F.col("_t.token").alias("token"))


def _most_partner(n: Column, pos: Column) -> Column:
    """Size of the largest set that can be alike if the first shared shingle stands at ``pos``."""
    return F.floor(((ALIKE[0] + ALIKE[1]) * (n - pos) - ALIKE[0] * n) / ALIKE[0])


def _candidates(loose: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: sets of different parts that can be alike by their beginnings, the places and the sizes."""
    rows = written(_rare_first(loose, sets), "beginnings")
    for _ in range(2):  # what no set with the same shingle is small enough for, or of another part, goes
        seen = rows.groupBy("token").agg(F.min("part").alias("_l"), F.max("part").alias("_h"), F.min("n").alias("_least")).where("_l < _h")
        rows = rows.join(seen.select("token", "_least"), "token").where(_most_partner(F.col("n"), F.col("pos")) >= F.col("_least")).drop("_least")
    rows = written(rows.withColumn("size", F.floor(F.log("n") / F.log(F.lit(ALIKE[1] / ALIKE[0])))), "beginnings-left")
    small = rows.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1)))  # alike sizes are at most one class apart
    small = small.select("token", "size", *[F.col(c).alias(f"a{c}") for c in ("node", "part", "n", "pos")])
    large = rows.select("token", "size", *[F.col(c).alias(f"b{c}") for c in ("node", "part", "n", "pos")])
    rest = F.least(F.col("an") - F.col("apos"), F.col("bn") - F.col("bpos"))
    can = (ALIKE[0] + ALIKE[1]) * rest >= ALIKE[0] * (F.col("an") + F.col("bn"))
    once = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("anode") < F.col("bnode")))
    pairs = small.join(large, ["token", "size"]).where((F.col("apart") != F.col("bpart")) & once & can & _near_in_size(F.col("an"), F.col("bn")))
    return pairs.select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """node, n, key: sets whose fingerprints are within reach by SimHash links have one key.

    The links are those of the pigeonring filter, directly or over others. The empty set has none.
    """
    held = nodes.where("n > 0").select("node", "n", "fp")
    to = centres(simhash.links(written(held.select("fp").distinct(), "prints")))
    placed = held.join(to.select(F.col("node").alias("fp"), "centre"), "fp", "left")
    return placed.select("node", "n", F.xxhash64(F.lit("fingerprint"), F.coalesce("centre", "fp")).alias("key"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: alike pairs with the components of all alike pairs that meet by SimHash or in a band.

    Sets meet in the bucket of their group of linked SimHash fingerprints, and, as a fingerprint is
    seldom within its few bits at a similarity of 0.8, in those of their bands.

    First every set is held against the hub of each of its buckets, which joins most of a large group.
    What is then in buckets with sets of several components is joined on rare shingles: two sets of
    different components that are alike share one at the beginning of both, at places and with sizes
    that leave room for enough others. So none of the pairs that meet is left out, and no bucket is
    paired with itself.
    """
    keyed = nodes.select("node", "n", F.explode("keys").alias("key")).unionByName(_by_fingerprint(nodes))
    crowd = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    met = written(keyed.join(crowd, "key"), "buckets")
    star = met.join(_hubs(met), "key").where((F.col("node") != F.col("_hub.node")) & _near_in_size(F.col("n"), F.col("_hub.n")))
    star = written(star.select(F.col("_hub.node").alias("a"), F.col("node").alias("b")).distinct(), "star")
    wanted = nodes.select("node", F.col("_first.rid").alias("rid")).join(met.select("node").distinct(), "node", "left_semi")
    sets = written(_sets(docs, wanted), "sets")
    first = written(_alike(star, sets), "alike")

    placed = met.join(centres(first), "node", "left").select("key", "node", "n", F.coalesce("centre", "node").alias("part"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("_l"), F.max("part").alias("_h")).where("_l < _h").select("key")
    loose = placed.join(mixed, "key", "left_semi").select("node", "n", "part").distinct()
    return first.unionByName(_alike(written(_candidates(written(loose, "loose"), sets), "across"), sets))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every group of near copies, the one with the least id, with the columns of ``docs``.

    Rows are near copies if their shingle sets have a Jaccard similarity of 0.8 or more, and groups
    are what such pairs join. Null texts and texts without words are copies of each other. A null
    id is never least unless all of a group are null; an empty table gives an empty one.
    """
    marked = written(_marked(docs), "shingle-marks")
    first = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "rid")
    known = marked.groupBy("node").agg(F.min(first).alias("_first"))
    held = marked.select("rid", "node", "n", "fp", "keys").join(known.select(F.col("_first.rid").alias("rid"), "node", "_first"), ["rid", "node"])
    nodes = written(held.dropDuplicates(["node"]).select("node", "n", "fp", "keys", "_first"), "sets-known")
    to = centres(links(docs, nodes))
    placed = nodes.select("node", "_first").join(to, "node", "left").select(F.coalesce("centre", "node").alias("centre"), "_first")
    least = placed.groupBy("centre").agg(F.min("_first").alias("_least"))
    stays = least.select(F.col("_least.rid").alias("_rid"))
    rows = docs.select(_row_id().alias("_rid"), F.struct(*docs.columns).alias("_row"))
    return rows.join(stays, "_rid", "left_semi").dropDuplicates(["_rid"]).select("_row.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
