"""SimHash fingerprints and near duplicates by pigeonring filtering."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import written

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: First bit and width of the segments of a fingerprint, around the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints under one key that are compared in one task; larger buckets are cut into blocks.
BLOCK = 4096
#: Pairs compared at a time.
PAIRS = 1 << 20


def majority(hashes: Sequence[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes, unsigned; 0 without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), PAIRS):
        part = np.array(hashes[at : at + PAIRS], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """Majority bits of the shingle hashes of a text, unsigned; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    body = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(body, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(body[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])]
    return majority(hashes)


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """rid, doc_id, fp: one row per row; ``rid`` is a hash of id and text, ``fp`` signed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks.view(np.int64))], names=["rid", "doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    return rows.mapInArrow(mark, f"rid bigint, doc_id {kind}, fp bigint")


def _segment(fp: Column, at: int) -> Column:
    first, width = SEGMENTS[at % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column) -> Column:
    """(key, probe): the chains of two segments under which a fingerprint is stored and sought.

    Two fingerprints within ``MAX_BITS`` = 4 bits have, somewhere on the ring of five segments, a
    start from which every chain of l segments differs in at most 4 l / 5 bits: none in the first,
    one in the first two. So the second segments are equal or differ in one bit, and whoever has
    that bit set seeks with it cleared.
    """
    stored, sought = [], []
    for at in range(len(SEGMENTS)):
        first, second = _segment(fp, at), _segment(fp, at + 1)
        width = SEGMENTS[(at + 1) % len(SEGMENTS)][1]
        key = lambda value, at=at, first=first: F.lit(at << 26) + F.shiftleft(first, 13) + value
        stored.append(F.struct(key(second).alias("key"), F.lit(False).alias("probe")))
        sought.append(F.struct(key(second).alias("key"), F.lit(True).alias("probe")))
        for bit in range(width):
            has = second.bitwiseAND(F.lit(1 << bit)) != 0
            cleared = F.struct(key(second - (1 << bit)).alias("key"), F.lit(True).alias("probe"))
            sought.append(F.when(has, cleared))
    return F.filter(F.array(*stored, *sought), lambda k: k.isNotNull())


def _in_budget(differ: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether every chain from ``start`` keeps its proportional budget; the last is all bits."""
    parts = len(SEGMENTS)
    counts = np.stack(
        [np.bitwise_count((differ >> np.uint64(f)) & np.uint64((1 << w) - 1)) for f, w in SEGMENTS]
    ).astype(np.int64)
    good, total = np.ones(len(differ), dtype=bool), np.zeros(len(differ), dtype=np.int64)
    at = np.arange(len(differ))
    for length in range(1, parts + 1):
        total += counts[(start + length - 1) % parts, at]
        good &= total * parts <= length * MAX_BITS
    return good


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the edges: each node that is not a centre, its centre."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _bucket_links(keys: np.ndarray, probe: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between stored and seeking fingerprints of the same bucket; rows are sorted by bucket."""
    first = np.flatnonzero(np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)]))
    sizes = np.diff(np.concatenate([first, [len(fps)]]))
    lowest, highest = np.minimum.reduceat(fps, first), np.maximum.reduceat(fps, first)
    seeking = np.add.reduceat(probe.astype(np.int64), first)
    busy = (lowest != highest) & (seeking > 0) & (seeking < sizes)
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> None:
        good = (a != b) & _in_budget(a ^ b, start)
        if good.any():
            links.append(forest(a[good], b[good]))

    held_a, held_b, held_s, held = [], [], [], 0
    for begin, size in zip(first[busy], sizes[busy], strict=True):
        own, seeks = fps[begin : begin + size], probe[begin : begin + size]
        stored, sought, start = own[~seeks], own[seeks], keys[begin, 0] >> 26
        step = max(1, PAIRS // len(sought))
        for at in range(0, len(stored), step):
            part = stored[at : at + step]
            held_a.append(np.repeat(part, len(sought)))
            held_b.append(np.tile(sought, len(part)))
            held_s.append(np.full(len(part) * len(sought), start))
            held += len(part) * len(sought)
            if held >= PAIRS:
                compare(*map(np.concatenate, (held_a, held_b, held_s)))
                held_a, held_b, held_s, held = [], [], [], 0
    if held:
        compare(*map(np.concatenate, (held_a, held_b, held_s)))
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(*map(np.concatenate, zip(*links, strict=True)))


def _links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, probe, fp) sorted by bucket; a bucket may go on in the next batch."""

    def made(rows: tuple) -> pa.RecordBatch:
        node, centre = _bucket_links(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(node.view(np.int64)), pa.array(centre.view(np.int64))], names=["a", "b"]
        )

    rest: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        now = (keys, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64))
        if rest is not None:
            now = tuple(np.concatenate(pair) for pair in zip(rest, now, strict=True))
        last = int(np.flatnonzero(np.any(now[0] != now[0][-1], axis=1))[-1]) + 1 if (now[0] != now[0][-1]).any() else 0
        if last:
            yield made(tuple(x[:last] for x in now))
        rest = tuple(x[last:].copy() for x in now)
    if rest is not None:
        yield made(rest)


def links(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints with the components of all links in reach.

    Fingerprints meet under chains of two segments. A bucket with more than ``block`` stored
    fingerprints is cut into blocks of about that many on either side, and every pair of blocks is
    compared in a task of its own, so no task holds more than two blocks, and no pair is left out.
    A task compares pairs in memory and hands on only a spanning forest of what it links.
    """
    keyed = marks.select("fp", F.explode(_keys(F.col("fp"))).alias("_k")).select("fp", "_k.key", "_k.probe")
    stored = keyed.where(~F.col("probe")).groupBy("key").count()
    sought = keyed.where("probe").groupBy("key").count().withColumnRenamed("count", "_sought")
    large = stored.where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("_own"))
    large = large.join(sought, "key", "left").select(
        "key", "_own", F.ceil(F.coalesce("_sought", F.lit(1)) / block).alias("_other")
    )
    large = written(large, "large")
    if large.isEmpty():
        cut = keyed.withColumn("block", F.lit(0).cast("bigint"))
    else:
        own, other = F.coalesce("_own", F.lit(1)), F.coalesce("_other", F.lit(1))
        part = lambda n: F.pmod(F.xxhash64("fp"), n)
        blocks = F.when(
            F.col("probe"),
            F.transform(F.sequence(F.lit(0).cast("bigint"), own - 1), lambda i: i * other + part(other)),
        ).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), other - 1), lambda j: part(own) * other + j))
        cut = keyed.join(large, "key", "left").withColumn("block", F.explode(blocks)).drop("_own", "_other")
    dealt = cut.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.select("key", "block", "probe", "fp").mapInArrow(_links_of, "a bigint, b bigint")


def centres(edges: DataFrame) -> DataFrame:
    """node, centre: the least node of the component of every node that is not itself the least.

    Alternating star contractions. Each round is written to the shared folder and starts from that
    copy; a node with many neighbours is first reduced to their least by partial minima.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))

    def state(pairs: DataFrame):
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = written(edges.where("a != b").distinct(), "edges")
    seen = state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = least(down)
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        small = small.unionByName(low.select("a", F.col("_m").alias("b"))).where("a != b").distinct()
        pairs = written(small, "edges")
        now = state(pairs)
        if now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("centre"))
        seen = now


def components(docs: DataFrame) -> DataFrame:
    """Per row: rid, doc_id, fp, component_id, least_rid.

    Documents link when their fingerprints differ in at most four bits; ``component_id`` is the
    least id that links lead to, the own id included, and ``least_rid`` names the row that has it.
    Copies share a fingerprint and are carried as one node. Null and empty texts have fingerprint
    zero and link like any other. A null id is never least unless all of a component are null.
    Repeated rows get the same result; an empty table gives an empty one. Columns other than
    doc_id and text are not read.
    """
    marked = written(with_fingerprint(docs), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "rid")
    nodes = written(marked.groupBy("fp").agg(F.min(first).alias("_first")), "nodes")
    to = centres(links(nodes.select("fp")))
    placed = nodes.join(to, nodes["fp"] == to["node"], "left").select(
        "fp", F.coalesce("centre", "fp").alias("centre"), "_first"
    )
    least = placed.groupBy("centre").agg(F.min("_first").alias("_least"))
    named = placed.select("fp", "centre").join(least, "centre").select(
        "fp", F.col("_least.doc_id").alias("component_id"), F.col("_least.rid").alias("least_rid")
    )
    return marked.join(named, "fp").select("rid", "doc_id", "fp", "component_id", "least_rid")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component, the one with the least id, with the columns of ``docs``."""
    stays = components(docs).select(F.col("least_rid").alias("_rid")).distinct()
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_rid"), F.struct(*docs.columns).alias("_row"))
    return rows.join(stays, "_rid", "left_semi").dropDuplicates(["_rid"]).select("_row.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
