import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leadloom.llm import decontamination, mixing, quality

EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "a b c a b c\n\nx\nx\n x", None, None),
    (4, "one two " * 60, "en", "b"),
    (4, "one two " * 60, "en", "b"),
    (None, " ".join(f"w{i}" for i in range(80)) + " # # | <b>", "en", "b"),
    (6, "É é x\x0by\x0cz\r\nq " * 20, "fr", "b"),
    (7, "ab " * 30_000, "en", "a"),
]


def test_quality_edges(make, twin):
    assert twin("op4_host_quality", documents=make(EDGE)) is None


def test_quality_empty(make, spark):
    assert quality.quality_report(make([])).count() == 0
    assert quality.keep_documents(make([])).count() == 0


def test_a_host_that_fails_as_a_whole_is_rejected(make):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "en", "bad") for i in range(60)] + [(100, good, "en", "bad")]
    rows += [(200 + i, good + f" t{i}", "en", f"h{i % 6}") for i in range(60)] + [(300, good, "en", None)]
    kept = {r["doc_id"] for r in quality.quality_report(make(rows)).where("kept").collect()}
    assert kept == {*range(200, 260), 300}
    docs = make(rows)
    same = quality.keep_documents(docs)
    assert same.columns == docs.columns and {r["doc_id"] for r in same.collect()} == kept


def test_winnowing_edges(make, twin, spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    long = [rng.choice(words) for _ in range(30)]
    items = [(1, " ".join(long)), (2, "Tiny item"), (3, None), (4, "!!"), (5, "rep " * 14), (None, "lone word here"), (6, " ".join(long[5:25]))]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + n, " ".join(rng.choices(words, k=9) + long[:n] + ["zz"] + long[30 - n :])) for n in range(31)]
    docs += [(200, "a TINY, item! b"), (201, None), (202, ""), (203, "rep " * 500), (203, "rep " * 500), (204, "LONE word\nhere"), (None, " ".join(long))]
    docs += [(205, "tinyÉ item tiny itemé tiny item")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("mark", F.lit(1))
    assert twin("op7_winnowing", documents=make(docs), benchmark=bench) is None
    clean = decontamination.clean_documents(make(docs), bench)
    report = decontamination.contamination(make(docs), bench)
    assert clean.columns == make(docs).columns
    assert clean.count() == report.where("not contaminated").count()


def test_every_shared_span_is_found(make, spark):
    rng = random.Random(5)
    item = [f"i{k}" for k in range(200)]
    docs = []
    for i in range(150):
        start, size = rng.randrange(190), rng.randint(5, 14)
        docs.append((i, " ".join([f"x{rng.random()}".replace(".", "") for _ in range(6)] + item[start : start + size] + ["y", "z"])))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontamination.contamination(make(docs), bench).collect()}
    for i, text in docs:
        shared = sum(w.startswith("i") for w in text.split())
        assert got[i] == (shared if shared >= 10 else 0)


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_winnowing_empty(make, spark, empty):
    bench = spark.createDataFrame([] if empty == "benchmark" else [(1, "a b")], "item_id bigint, text string")
    found = decontamination.contamination(make([] if empty == "documents" else [(1, "a b")]), bench)
    assert found.where("contaminated").count() == 0 and found.count() == (empty != "documents")


def _targets(sizes: dict, weights, share, most):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, capped = share * sum(sizes.values()), set()
    while True:
        left = goal - sum(most * sizes[s] for s in capped)
        total = sum(w[s] for s in order if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * w[s] / total for s in order}
        over = {s for s in order if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mix(make):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 200), "en", rng.choice(["a", "b", "c", "é", "z", None]) if i % 3 else "hot") for i in range(1500)]
    rows += [(5000, "w w w", "en", "a")] * 40 + [(None, "w w", "en", "b")] * 3 + [(6000, None, "en", "c"), (6001, "", "en", "only empty")]
    docs = make(rows)
    got = mixing.mix(docs, fan_in=8).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = _targets(sizes, (5, 2, 1), 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 200
    again = mixing.mix(docs.repartition(7), fan_in=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = mixing.mixture(docs, fan_in=8)
    assert set(docs.columns) <= set(whole.columns)
    assert whole.agg(F.sum("taken")).first()[0] == sum(taken.values())
    assert whole.where("size_ok is null").count() == 0 if "size_ok" in whole.columns else True


def test_mix_keeps_expected_copies(make):
    rows = [(i, "w " * 10, "en", f"s{i % 2}") for i in range(4000)]
    got = mixing.mix(make(rows)).groupBy("source").agg(F.avg("copies").alias("c"), F.first("target").alias("t")).collect()
    assert all(abs(r["c"] - r["t"] / 20_000) < 1e-3 for r in got)


def test_mix_empty(make):
    assert mixing.mix(make([])).count() == 0
    assert mixing.mixture(make([])).count() == 0
    assert [r["taken"] for r in mixing.mix(make([(1, None, "en", "a")])).collect()] == [0]
