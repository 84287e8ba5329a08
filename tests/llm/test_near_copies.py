import itertools
import random

import corpus_pipeline

from leadloom.llm import near_copies
from leadloom.llm.common import table


def _plain_kept(rows):
    """Least id of every group, by the exact similarity of all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(least.values())


def test_stage_finds_near_copies_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == _plain_kept(rows)
    assert 1 in ids and 177 not in ids  # similarity 0.83, nine bits of the fingerprint apart


def test_groups_equal_all_pairs(make):
    rng = random.Random(3)
    rows = [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B"), (904, "a  B")]
    for group in range(6):
        text = [f"w{rng.randrange(5_000)}" for _ in range(300)]
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(len(copy))] = "x"
            rows.append((len(rows), " ".join(copy)))
    got = sorted(r["doc_id"] for r in near_copies.one_of_each(make(rows)).collect())
    assert got == _plain_kept(rows)
    assert near_copies.one_of_each(make([])).count() == 0


def test_many_edited_copies_and_their_edge(make):
    """A group around one source, where many members are alike only to some others."""
    rng = random.Random(9)
    base = [f"b{rng.randrange(9_000)}" for _ in range(130)]
    rows = []
    for _ in range(260):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(copy) - 4)
            copy[at] = rng.choice(["x", f"e{rng.randrange(400)}"])
        if rng.random() < 0.3:
            copy = copy[: rng.randint(90, 130)]
        if rng.random() < 0.2:
            copy += [f"t{i}" for i in range(rng.randint(1, 30))]
        rows.append((len(rows), " ".join(copy)))
    kept = near_copies.one_of_each(make(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == _plain_kept(rows)


def test_beginnings_hold_every_alike_pair(spark):
    """All alike pairs of different parts are candidates, by brute force."""
    rng = random.Random(4)
    base = rng.sample(range(10_000), 120)
    sets = []
    for i in range(120):
        own = set(base if i % 2 else base[20:])
        own -= set(rng.sample(sorted(own), rng.randint(0, 14)))
        sets.append(sorted(own | {rng.randrange(10_000, 10_400) for _ in range(rng.randint(0, 12))}))
    sets += [[1], [1, 2], [2]]
    rows = [(i, s, len(s), i) for i, s in enumerate(sets)]
    table_ = spark.createDataFrame(rows, "node bigint, shingles array<bigint>, n bigint, part bigint")
    found = near_copies._candidates(table_.select("node", "n", "part"), table_.select("node", "shingles"))
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
    alike = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert alike and alike <= pairs


def test_fingerprints_alone_join_close_copies(make, monkeypatch):
    """Copies within the bits of a SimHash link meet by it, without any band."""
    monkeypatch.setattr(near_copies, "bands", lambda found: [])
    rng = random.Random(12)
    rows = [(900, None), (901, "")]
    for group in range(4):
        text = [f"g{group}w{rng.randrange(5_000)}" for _ in range(900)]
        for _ in range(6):
            copy = list(text)
            copy[rng.randrange(len(copy))] = "x"
            rows.append((len(rows), " ".join(copy)))
    got = sorted(r["doc_id"] for r in near_copies.one_of_each(make(rows)).collect())
    assert got == _plain_kept(rows) and len(got) == 5
