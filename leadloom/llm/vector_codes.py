"""Compression of vectors to short codes, by codebooks fitted exactly on Hilbert-sorted blocks.

Every vector is cut into equal parts, and every part position has a codebook of its own. The parts
of one position are sorted along a Hilbert curve and cut into flat blocks. A block keeps the box of
its points (least and greatest component), their sum, and the points. In each round the least and
greatest distances between a block's box and the entries leave a shortlist of entries that can be
nearest to some point of it. If one entry is left, the block's sum goes to it as a whole; if not, an
exact integer kernel compares the points with the shortlist alone.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Points of one block.
BLOCK = 512
#: Bits of a Hilbert key, shared by the components of a part.
KEY_BITS = 56
#: Sums travel in limbs of so many bits, so that no sum over any number of rows overflows.
LIMB = 30
#: Component types by their size, and plain decimal text for what fits in none.
KINDS = ("<i2", "<i4", "<i8", "text")

Books = list[list[list[int]]]


def integers(vector: Sequence[float], width: int, scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    """floor(scale * x) of every component, by parts; places beyond the vector's end are zero.

    Whole numbers beyond 2 ** 53 are exact too: such a float has no fraction.
    """
    x = np.asarray(vector, dtype=np.float64)
    if len(x) and (largest := np.abs(x).max()) * scale >= 2.0**62:
        found = np.array([math.floor(v * scale) if abs(v) < 2.0**40 else int(v) * scale for v in x.tolist()], dtype=object)
    else:
        found = np.floor(x * scale).astype(np.int64)
    whole = np.zeros(parts * width, dtype=found.dtype)
    whole[: len(found)] = found
    return whole.reshape(parts, width)


def packed(points: np.ndarray) -> tuple[int, bytes]:
    """The smallest kind that holds all components, and the components in it."""
    if points.dtype != object:
        least, most = (int(points.min()), int(points.max())) if points.size else (0, 0)
        for kind, name in enumerate(KINDS[:-1]):
            limits = np.iinfo(name)
            if limits.min <= least and most <= limits.max:
                return kind, points.astype(name).tobytes()
    return len(KINDS) - 1, ",".join(map(str, points.ravel().tolist())).encode()


def unpacked(kind: int, data: bytes, width: int) -> np.ndarray:
    if KINDS[kind] != "text":
        n = len(data) // max(1, width * np.dtype(KINDS[kind]).itemsize)
        return np.frombuffer(data, KINDS[kind]).astype(np.int64).reshape(n if width else 0, width)
    return np.array([int(x) for x in data.decode().split(",")], dtype=object).reshape(-1, width)


def hilbert_keys(points: np.ndarray, low: float, high: float) -> np.ndarray:
    """Places along a Hilbert curve over a grid between ``low`` and ``high``; what lies outside is clipped.

    The bits of all components are turned from the greatest down: a component whose bit is set
    reflects the lower bits of the first, one whose bit is not set changes places with it. The Gray
    code of the turned bits is the place on the curve.
    """
    n, width = points.shape
    if not width or high <= low:
        return np.zeros(n, dtype=np.int64)
    used = min(width, KEY_BITS)
    bits = max(1, min(12, KEY_BITS // used))
    scaled = (np.clip(points[:, :used].astype(np.float64), low, high) - low) / (high - low)
    axes = np.minimum((scaled * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    for bit in range(bits - 1, 0, -1):
        lower = (1 << bit) - 1
        for i in range(used):
            is_set = (axes[i] >> bit) & 1 == 1
            swapped = np.where(is_set, 0, (axes[0] ^ axes[i]) & lower)
            axes[0] ^= np.where(is_set, lower, swapped)
            axes[i] ^= swapped
    for i in range(1, used):
        axes[i] ^= axes[i - 1]
    flip = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    axes ^= flip
    keys = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(used):
            keys = (keys << 1) | ((axes[i] >> bit) & 1)
    return keys


def _fits(width: int, *bounds: int) -> bool:
    """Whether squared distances between components of these sizes stay within 64 bits."""
    most = max((abs(b) for b in bounds), default=0)
    return 4 * most * most * max(1, width) < 1 << 63


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries whose least distance to the box is no more than the least of all greatest distances."""
    zero = book * 0
    near = np.maximum(np.maximum(low - book, book - high), zero)
    far = np.maximum(np.abs(book - low), np.abs(high - book))
    return np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())


def nearest(points: np.ndarray, book: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry among the listed ones and its squared distance, both exact; ties go to the lower index."""
    best = np.full(len(points), among[0])
    apart = points - book[among[0]]
    least = (apart * apart).sum(axis=1)
    for entry in among[1:]:
        apart = points - book[entry]
        distance = (apart * apart).sum(axis=1)
        closer = distance < least
        best[closer] = entry
        least = np.where(closer, distance, least)
    return best, least


@dataclass(frozen=True)
class Block:
    """Points of one part position that lie near each other, with their box and sum."""

    part: int
    low: np.ndarray
    high: np.ndarray
    total: list[int]
    points: np.ndarray

    def assigned(self, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shortlist, and each point's entry and squared distance."""
        points, entries, among = self._ready(book)
        return among, *nearest(points, entries, among)

    def sums(self, book: list[list[int]]) -> Iterable[tuple[int, int, list[int]]]:
        """entry, number of points, sum of the points, for each entry that has any."""
        points, entries, among = self._ready(book)
        if len(among) == 1:
            yield int(among[0]), len(points), self.total
            return
        best, _ = nearest(points, entries, among)
        for entry in among:
            if (mine := best == entry).any():
                yield int(entry), int(mine.sum()), [int(x) for x in points[mine].sum(axis=0)]

    def _ready(self, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = self.points.shape[1]
        if width == 0:
            entries = np.zeros((len(book), 0), dtype=np.int64)
            return self.points, entries, np.arange(1)
        limits = [int(x) for x in (self.low.min(), self.high.max())] + [x for entry in book for x in entry]
        kind = np.int64 if _fits(width, *limits) and self.points.dtype != object else object
        entries = np.array(book, dtype=kind).reshape(len(book), width)
        points = self.points.astype(kind, copy=False)
        return points, entries, shortlist(self.low.astype(kind, copy=False), self.high.astype(kind, copy=False), entries)


def _block_row(part: int, rids: list[int], kinds: list[int], data: list[bytes], width: int) -> tuple:
    kind = max(kinds, default=0)
    if min(kinds, default=0) == kind and kind < len(KINDS) - 1:
        points = np.frombuffer(b"".join(data), KINDS[kind]).astype(np.int64).reshape(len(rids), width)
    else:
        points = np.concatenate([unpacked(k, d, width).astype(object).reshape(1, width) for k, d in zip(kinds, data, strict=True)])
    box = [[str(x) for x in f(axis=0).tolist()] if width else [] for f in (points.min, points.max)]
    total = [str(sum(points[:, i].tolist())) for i in range(width)] if width else []
    name, content = packed(points)
    return part, rids, *box, total, name, content


BLOCKS = "part int, rids array<bigint>, low array<string>, high array<string>, total array<string>, kind int, points binary"
_BLOCK_TYPES = [
    pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.string())] * 3, pa.int32(), pa.binary(),
]
_BLOCK_NAMES = ["part", "rids", "low", "high", "total", "kind", "points"]


def _read_blocks(batch: pa.RecordBatch, width: int) -> Iterator[Block]:
    parts, lows, highs, totals, kinds, points, sizes = (
        batch.column(name).to_pylist() for name in ("part", "low", "high", "total", "kind", "points", "size")
    )
    for part, low, high, total, kind, data, size in zip(parts, lows, highs, totals, kinds, points, sizes, strict=True):
        found = unpacked(kind, data, width) if width else np.zeros((size, 0), dtype=np.int64)
        low, high = (np.array([int(x) for x in box], dtype=found.dtype) for box in (low, high))
        yield Block(part, low, high, [int(x) for x in total], found)


def numbered(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """rid, vec_id, label, vector of the rows whose vector has neither nulls nor non-finite components.

    The numbers are written with the rows, so every later step sees the same ones.
    """
    x = F.col("vector")
    rows = vectors.select("vec_id", "label", F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(x.isNotNull() & ~bad)
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "vector"), "vectors")


def blocks_of(rows: DataFrame, width: int, block: int = BLOCK, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """The parts of all vectors in Hilbert order, as written blocks; equal parts are told apart by rid."""
    spread = rows.where(F.size("vector") > 0).agg(
        F.percentile_approx(F.array_min("vector"), 0.01).alias("low"), F.percentile_approx(F.array_max("vector"), 0.99).alias("high")
    ).first()
    low, high = (float(x or 0.0) * scale for x in spread)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [integers(v, width, scale, parts) for v in batch.column(1).to_pylist()]
            if not whole:
                continue
            rids, n = batch.column(0).to_numpy(), len(whole)
            keys = [hilbert_keys(np.concatenate([w[p : p + 1] for w in whole]), low, high) for p in range(parts)]
            cells = [packed(w[p]) for p in range(parts) for w in whole]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(parts, dtype=np.int32), n)), pa.array(np.concatenate(keys)),
                    pa.array(np.tile(rids, parts)), pa.array([k for k, _ in cells], pa.int32()),
                    pa.array([d for _, d in cells], pa.binary()),
                ],
                names=["part", "key", "rid", "kind", "data"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made(found: list[tuple]) -> pa.RecordBatch:
            part, rids, kinds, data = found[0][0], *(list(x) for x in zip(*(f[1:] for f in found), strict=True))
            values = _block_row(part, rids, kinds, data, width)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK_TYPES, strict=True)], names=_BLOCK_NAMES)

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for row in zip(*columns, strict=True):
                if held and (held[0][0] != row[0] or len(held) == block):
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    dealt = rows.select("rid", "vector").mapInArrow(cut, "part int, key bigint, rid bigint, kind int, data binary")
    dealt = dealt.repartitionByRange("part", "key", "rid").sortWithinPartitions("part", "key", "rid")
    return written(dealt.select("part", "rid", "kind", "data").mapInArrow(gather, BLOCKS), "vector-blocks")


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    at = 0
    while value not in (0, -1):
        yield at, value & ((1 << LIMB) - 1)
        value >>= LIMB
        at += 1
    if value:
        yield at, -1


def refined(blocks: DataFrame, books: Books, width: int) -> Books:
    """One round: every part to its nearest entry, then every entry to the floor of its parts' mean.

    Tasks add up their points by entry; the driver receives one row per part, entry, place and limb.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for found in _read_blocks(batch, width):
                for entry, n, total in found.sums(books[found.part]):
                    held = sums.setdefault((found.part, entry), [0] * (width + 1))
                    sums[found.part, entry] = [a + b for a, b in zip(held, [n, *total], strict=True)]
        rows = [(p, e, i, limb, v) for (p, e), values in sums.items() for i, x in enumerate(values) for limb, v in _limbs(x)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], names=["part", "entry", "place", "limb", "value"]
        )

    columns = blocks.select("part", "low", "high", "total", "kind", "points", F.size("rids").alias("size"))
    found = columns.mapInArrow(partial, "part int, entry int, place int, limb int, value bigint")
    sums: dict[tuple[int, int], list[int]] = {}
    for r in found.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():
        sums.setdefault((r["part"], r["entry"]), [0] * (width + 1))[r["place"]] += r["value"] << (LIMB * r["limb"])
    return [
        [[x // sums[p, e][0] for x in sums[p, e][1:]] if (p, e) in sums else entry for e, entry in enumerate(book)]
        for p, book in enumerate(books)
    ]


def first_entries(rows: DataFrame, width: int, entries: int = ENTRIES, scale: int = SCALE, parts: int = PARTS) -> Books:
    """The parts of the vectors with the smallest ids (nulls last); rows of one id are taken by their components."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    whole = [integers(r["vector"], width, scale, parts) for r in first]
    return [[[int(x) for x in w[p]] for w in whole] for p in range(parts)]


def encoded(blocks: DataFrame, books: Books, width: int) -> DataFrame:
    """rid, packed, error: the entries of all parts as bytes of one number, the first part in the highest,
    and the sum of the squared distances, null if it does not fit in a long."""
    parts = len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_rids = batch.column(batch.num_columns - 1).to_pylist()
            for found, rids in zip(_read_blocks(batch, width), all_rids, strict=True):
                _, best, least = found.assigned(books[found.part])
                errors = [str(x) if x < 10**37 else None for x in least.tolist()]
                code = best.astype(np.int64) << (8 * (parts - 1 - found.part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids, pa.int64()), pa.array(code), pa.array(errors, pa.string())], names=["rid", "code", "error"]
                )

    columns = blocks.select("part", "low", "high", "total", "kind", "points", F.size("rids").alias("size"), "rids")
    found = columns.mapInArrow(assign, "rid bigint, code bigint, error string")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    lost = F.max(F.col("error").isNull())
    return found.groupBy("rid").agg(F.sum("code").alias("packed"), F.when(~lost, _long(whole)).alias("error"))


def _long(x):
    return F.when(x.between(-(1 << 63), (1 << 63) - 1), x).cast("bigint")


def digest(books: Books) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, vector: str = "embedding") -> tuple[DataFrame, DataFrame, Books, int]:
    """Numbered rows, blocks, codebooks after ``rounds`` rounds, and the width of a part."""
    rows = numbered(vectors, vector)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS)
    blocks = blocks_of(rows, width)
    books = first_entries(rows, width, entries)
    for _ in range(rounds if books[0] else 0):
        books = refined(blocks, books, width)
    return rows, blocks, books, width


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label, label_error, codebooks_sha256 of every row that is kept.

    Rows whose vector is null or holds a null, a NaN or an infinity are dropped. Vectors of other
    lengths than the longest, or of a length that is no multiple of eight, are filled up with zeros;
    empty vectors are all zeros. Repeated rows get the same result; null ids are ordered last and
    null labels count as one label. With fewer rows than entries the codebooks are that short. An
    ``error`` or ``label_error`` beyond a long is null. An empty table gives an empty result. Further
    columns are not read.
    """
    rows, blocks, books, width = fit(vectors, rounds, entries, vector)
    codes = encoded(blocks, books, width)
    code = F.lower(F.lpad(F.hex("packed"), 2 * PARTS, "0"))
    found = written(rows.select("rid", "vec_id", "label").join(codes, "rid").select("vec_id", "label", code.alias("code"), "error"), "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = found.groupBy("label").agg(_long(total).alias("label_error")).withColumnRenamed("label", "_label")
    return found.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
