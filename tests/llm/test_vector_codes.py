import hashlib
import math
import random

import numpy as np
import pytest

from leadloom.llm import vector_codes
from leadloom.llm.common import table
from leadloom.llm.queries import QUERIES


def _plain(rows, rounds=6, entries=16):
    """Codes, errors and the digest, in plain integers."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 1e15 else 4096 * int(x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    cut = [[(v + [0] * (8 * width - len(v)))[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[list(cut[k][p]) for k in order[:entries]] for p in range(8)]

    def nearest(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else entry for e, entry in enumerate(book)]
    found = [[nearest(c[p], books[p]) for p in range(8)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{e:02x}" for _, e in f), error, by_label[label], sha)
         for (i, _, label), f, error in zip(kept, found, errors, strict=True)), key=repr)


def _got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


def test_query_against_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table(spark, folder, "embeddings").collect()]
    assert _got(QUERIES["op11_hilbert_codes"](spark, folder)) == _plain(rows)


def test_edge_cases(spark):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    rows = [(None, [0.5] * 16, None), (3, [0.25] * 16, 1), (3, [0.25] * 16, 1), (3, [0.125] * 15, None), (1, None, 2),
            (2, [nan] * 16, 2), (2, [inf] * 16, 2), (2, [None, *[1.0] * 15], 2), (4, [], 2), (5, [-1e-9] * 3, 2), (6, [3e30, -3e30, 1e12], 2)]
    rows += [(100 + i, [rng.choice([0.0, 0.5, rng.gauss(0, 1)]) for _ in range(16)], i % 3) for i in range(120)]
    rows += [(400 + i, rows[40][1], 7) for i in range(60)]
    full = [(*r, 1, "x", "y") for r in rows]
    df = spark.createDataFrame(full, "vec_id bigint, embedding array<double>, label int, rid int, code string, error string").repartition(5)
    expected = [(i, c, e if e < 1 << 63 else None, s if s < 1 << 63 else None, h) for i, c, e, s, h in _plain(rows)]
    assert sorted(map(repr, _got(vector_codes.compress(df)))) == sorted(map(repr, expected))
    assert vector_codes.compress(df.where("false")).count() == 0
    few = [(i, [float(i)] * 8, None) for i in range(5)]
    assert _got(vector_codes.compress(spark.createDataFrame(few, "vec_id bigint, embedding array<float>, label int"))) == _plain(few)
    none = spark.createDataFrame([(1, [], 1), (2, [], 1)], "vec_id bigint, embedding array<float>, label int")
    assert [r["code"] for r in vector_codes.compress(none).collect()] == ["0" * 16] * 2


def test_shortlists_lose_no_nearest_entry():
    rng = np.random.default_rng(1)
    for _ in range(200):
        points = rng.integers(-40, 40, (30, 3)) // rng.integers(1, 20)
        book = [[int(x) for x in p] for p in rng.integers(-40, 40, (9, 3))]
        block = vector_codes.Block(0, points.min(axis=0), points.max(axis=0), [int(x) for x in points.sum(axis=0)], points)
        _, best, least = block.assigned(book)
        plain = [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(book)) for p in points.tolist()]
        assert [(int(d), int(e)) for d, e in zip(least, best, strict=True)] == plain
        total = {e: (n, s) for e, n, s in block.sums(book)}
        assert sum(n for n, _ in total.values()) == 30
        assert [sum(s[i] for _, s in total.values()) for i in range(3)] == points.sum(axis=0).tolist()


@pytest.mark.parametrize("width,bits", [(2, 3), (3, 2)])
def test_hilbert_keys_walk_the_grid(width, bits, monkeypatch):
    monkeypatch.setattr(vector_codes, "KEY_BITS", width * bits)
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * width, indexing="ij"), axis=-1).reshape(-1, width)
    keys = vector_codes.hilbert_keys(grid, 0, side)
    assert sorted(keys.tolist()) == list(range(side**width))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_limbs_add_up():
    for value in (0, -1, 1, 5, -7, 1 << 30, -(1 << 30), (1 << 200) + 3, -(1 << 90) - 1):
        assert sum(v << (vector_codes.LIMB * at) for at, v in vector_codes._limbs(value)) == value
