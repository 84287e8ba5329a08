import random
import re

import corpus_pipeline
from test_near_copies import _plain_kept

from leadloom.llm import quality, toxicity
from leadloom.llm.common import table, written
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def _plain_quality(rows):
    """Base rules and host rates in plain Python."""
    measures = []
    for source, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w in windows if windows.count(w) > 1} if len(windows) < 4000 else set()
        covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        symbols = sum(c in "#*$%&|<>" for c in text)
        measures.append(
            (source, len(words) < 50, 100 * len(covered) > 50 * len(words), symbols > len(words), 100 * (len(lines) - len(set(lines))) > 50 * len(lines))
        )
    bad = set()
    for rule in range(1, 5):
        sums = {}
        for m in measures:
            n, f = sums.get(m[0], (0, 0))
            sums[m[0]] = (n + 1, f + m[rule])
        total = sum(n for n, _ in sums.values())
        mean = sum(f for _, f in sums.values()) / total
        spread = max(sum(n * (f / n) ** 2 for n, f in sums.values()) / total - mean * mean, 1e-9)
        strength = max(mean * (1 - mean) / spread - 1, 1.0)
        bad |= {s for s, (n, f) in sums.items() if (f + mean * strength) / (n + strength) > quality.MAX_HOST_RATE}
    return [not (m[1] or m[2]) and m[0] not in bad for m in measures]


def _plain_clean(texts, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t)) if w]
    windows = set()
    for item in items:
        words = split(item)
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}
    return [
        not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))
        for words in map(split, texts)
    ]


def test_stages_against_plain_versions(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    tagger = toxicity.learn(docs, table(spark, FOLDER, "labels"), toxicity.in_training(F.col("doc_id")))
    known = toxicity.Emissions(tagger)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
        ids, texts = list(before), [r["text"] for r in before.values()]
        if name == "toxicity":
            keep = [tagger.scores(*tagger.tag([t], known))[0] < toxicity.THRESHOLD for t in texts]
        elif name == "quality":
            keep = _plain_quality([(r["source"], r["text"]) for r in before.values()])
        elif name == "near_duplicates":
            stays = set(_plain_kept(list(zip(ids, texts, strict=True))))
            keep = [i in stays for i in ids]
        else:
            keep = _plain_clean(texts, [r["text"] for r in table(spark, FOLDER, "benchmark").collect()])
        assert kept[name] == {i for i, k in zip(ids, keep, strict=True) if k}, name
        assert len(docs.collect()) == len(kept[name]) > 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    rows = mixed.collect()
    assert set(columns) <= set(mixed.columns) and {r["doc_id"] for r in rows} <= kept["decontamination"]
    assert all(r["copies"] in (1, 2) for r in rows)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in whole) == sorted((r["doc_id"], r["copies"]) for r in rows)


def test_stages_take_an_empty_table(spark):
    empty = table(spark, FOLDER, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_stages_take_nulls_and_further_columns(make, spark):
    docs = make([(None, None), (1, ""), (2, None, None, None), (3, " ".join(f"t{i}" for i in range(70)), None, None)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() >= 1 or name in ("quality", "mixing")
        assert set(docs.columns) <= set(out.columns)


def test_clean_documents_pass(spark):
    """Documents of words that no toxic document has, all different, go through all stages but the mixture."""
    docs = table(spark, FOLDER, "documents")
    labelled = docs.join(table(spark, FOLDER, "labels"), "doc_id").collect()
    toxic = {w.lower() for r in labelled if r["toxic"] for w in r["text"].split()}
    words = sorted({w for r in labelled if not r["toxic"] for w in r["text"].split() if w.isalpha() and w.lower() not in toxic})
    rng = random.Random(6)
    rows = [(10_000 + i, " ".join(rng.choice(words) for _ in range(120)) + ".", "en", "clean", 900) for i in range(40)]
    now = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, FOLDER), name)
    assert now.where("source = 'clean'").count() == 40
