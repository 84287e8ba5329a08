import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from leadloom.llm import language, lattice_lm, tokens, toxicity
from leadloom.llm.common import table
from leadloom.llm.queries import QUERIES
from leadloom.llm.vocabulary import MARK, PIECE_FILE, Vocabulary

SMALL = "/root/testdata/sf0.01"


# language


def _plain_ppm(train: dict[str, list[bytes]], text: bytes) -> dict[str, float]:
    """Code lengths by walking each language's context tree symbol by symbol."""
    out = {}
    for lang, texts in train.items():
        seen = [defaultdict(Counter) for _ in range(language.ORDER + 1)]
        for t in texts:
            data = b"\n" * language.ORDER + t
            for i in range(language.ORDER, len(data)):
                for k in range(language.ORDER + 1):
                    seen[k][data[i - k : i]][data[i]] += 1
        bits, data = 0.0, b"\n" * language.ORDER + text
        for i in range(language.ORDER, len(data)):
            for k in range(language.ORDER, -2, -1):
                if k < 0:
                    bits += 8.0
                    break
                counts = seen[k].get(data[i - k : i])
                if not counts:
                    continue
                total, kinds = sum(counts.values()), len(counts)
                if data[i] in counts:
                    bits -= math.log2(counts[data[i]] / (total + kinds))
                    break
                bits -= math.log2(kinds / (total + kinds))
        out[lang] = bits
    return out


def test_code_lengths_equal_a_walk_through_the_trees():
    train = {"a": [b"banana band", b"", b"an apple"], "b": ["élan vital".encode(), b"nation and band"]}
    counts = {}
    for lang, texts in train.items():
        runs = [language._grams(np.frombuffer(b"\n\n\n" + t, dtype=np.uint8), 4) for t in texts]
        keys, n = np.unique(np.concatenate(runs), return_counts=True)
        counts[lang] = (keys, n.astype(float))
    scorer = language.Scorer(language.Model.fit(counts))
    texts = [b"banana", b"", b"a band of nations", "éé \x00 xyz".encode(), b"q"]
    got = scorer.code_lengths(texts)
    for row, text in zip(got, texts, strict=True):
        want = _plain_ppm(train, text)
        assert np.allclose(row, [want["a"], want["b"]], rtol=1e-5, atol=1e-4)


def test_language_held_out(spark):
    docs = table(spark, SMALL, "documents")
    got = QUERIES["op2_ppm_language"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = got.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(make):
    rows = [(i, "the cat and the dog " * 3, "en", "s") for i in range(20)] + [(30 + i, "le chat et la souris " * 3, "fr", "s") for i in range(20)]
    odd = [(100, None), (101, ""), (102, "123 !?"), (103, "le chat " * 20_000), (103, "le chat " * 20_000), (104, "the dog", None)]
    got = {r["doc_id"]: r for r in language.identify(make([*rows, *odd])).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "fr", "en"]
    assert got[100]["score"] == 0.0
    assert language.identify(make([])).count() == 0
    assert [r["lang_pred"] for r in language.identify(make([(1, "text", None)])).collect()] == ["und"]


# toxicity


def test_marginals_equal_the_sum_over_all_taggings():
    rng = np.random.default_rng(0)
    first, move = np.exp(rng.normal(size=2)), np.exp(rng.normal(size=(2, 2)))
    lengths = np.array([5, 0, 3, toxicity.CHAIN + 2])
    values = np.exp(rng.normal(size=lengths.sum()))
    at, filled = toxicity.chains(values, lengths)
    odds = np.ones(filled.size)
    odds[at] = values
    chance, moves = toxicity.marginals(odds.reshape(filled.shape), filled, first, move, True)
    chance = chance.ravel()[at]
    begin, expected = 0, np.zeros((2, 2))
    for size in (5, 3):
        own = values[begin : begin + size]
        total, tagged = 0.0, np.zeros(size)
        pairs = np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=size):
            w = first[tags[0]] * np.prod([move[a, b] for a, b in zip(tags, tags[1:])]) * np.prod(own[np.array(tags) == 1])
            total += w
            tagged += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += w
        assert np.allclose(chance[begin : begin + size], tagged / total)
        expected += pairs / total
        begin += size
    assert moves.sum() == pytest.approx(4 + 2 + toxicity.CHAIN - 1 + 1)
    assert (moves >= expected - 1e-9).all()


def test_toxicity_learns_words_and_offsets(make, spark):
    filler = [f"word{i}" for i in range(60)]
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        own = list(rng.choice(filler, 30))
        if i % 3 == 0:
            own[int(rng.integers(30))] = rng.choice(["Nasty!", "vilest", "vilely"])
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(900, None), (901, ""), (902, "x " * 50_000 + "nasty"), (903, "a nasty nasty thing"), (903, "a nasty nasty thing"), (None, "vilesome")]
    labels += [(7, 0, None), (8000, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(make(rows), marks).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == (i % 3 == 0) for i in range(300))
    assert by[900]["predicted"] == by[901]["predicted"] == 0 and 0 <= by[900]["score"] < 0.3
    assert by[902]["predicted"] == 1 and [tuple(s) for s in by[903]["spans"]] == [(2, 13)]
    kept = toxicity.harmless(make(rows), marks)
    assert kept.columns == make(rows).columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity(make([(1, "a b"), (2, None)]), none).collect()] == [0, 0]
    assert toxicity.toxicity(make([]), none).count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op8_crf_toxicity"](spark, folder).where("held_out").join(table(spark, folder, "labels"), "doc_id").collect()
    toxic = [r["predicted"] for r in got if r["toxic"]]
    clean = [r["predicted"] for r in got if not r["toxic"]]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


# token counts


def _unigram_library(tmp_path):
    """The library's own unigram model over the same pieces and scores."""
    import struct

    import sentencepiece

    data = bytearray(open(PIECE_FILE, "rb").read())
    at = data.rindex(b"\x18\x02\x20\x80\xfa\x01")  # model type 2, then 32 000 pieces
    data[at + 1] = 1
    worst = struct.pack("<f", min(Vocabulary.read().scores))
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes(data).replace(struct.pack("<f", -1e9), worst))
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_counts_equal_the_library(spark, tmp_path):
    library, counter = _unigram_library(tmp_path), tokens.Counter(Vocabulary.read())
    words = {w for r in table(spark, "/root/testdata/sf0.001", "documents").collect() for w in r["text"].split()[:400]}
    words |= {"a  b", " lead", "tail ", "x\ny", "  ", "日本語", "naïve café", "aaaaaaaa", "🙂", "ééé"}
    for word in words:
        assert counter(word)[1] == len(library.encode(word)), word


def test_best_path_equals_all_segmentations():
    pieces = ("▁", "▁a", "a", "aa", "ab", "b", "▁aab", "ba")
    scores = (-2.0, -3.0, -2.0, -4.0, -3.0, -1.0, -6.0, -3.0)
    counter = tokens.Counter(Vocabulary(pieces, scores))
    value = dict(zip(pieces, scores, strict=True))
    for n in range(1, 6):
        for letters in itertools.product("abc", repeat=n):
            text = MARK + "".join(letters)
            best = -math.inf
            for cuts in itertools.product((0, 1), repeat=len(text) - 1):
                ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
                parts = [text[a:b] for a, b in zip([0, *ends], ends)]
                total = sum(value.get(p, counter.vocabulary.unknown if len(p) == 1 else -math.inf) for p in parts)
                best = max(best, total)
            assert counter("".join(letters))[3] == best


def test_counts_edges(make):
    got = tokens.count_tokens(make([(1, None), (2, ""), (3, "the end"), (3, "the end"), (4, "the " * 40_000)]).select("doc_id", "text"))
    rows = sorted((r["doc_id"], r["n_chars"], r["n_tokens"]) for r in got.collect())
    assert rows[:2] == [(1, 0, 0), (2, 0, 0)] and rows[2] == rows[3] and rows[4][1] == 160_000
    full = tokens.count_tokens(make([(3, "the end")]))
    assert full.first()["score"] < 0 and full.first()["size"] == "s"
    assert tokens.count_tokens(make([])).count() == 0


# lattice


def test_lattice_sums_all_segmentations():
    rng = np.random.default_rng(2)
    pieces = (MARK, f"{MARK}a", "a", "aa", "ab", "b", f"{MARK}ab")
    weights = np.log(rng.dirichlet(np.ones(len(pieces) + 256), size=2)).T
    lattice = lattice_lm.Lattice(pieces, weights)
    words = ["a", "ab", "aab", "aaabab", "aéb", "ééé", "b" * 40]
    got = lattice.score(words)
    value = {p: weights[i] for i, p in enumerate(pieces)}

    def spell(c):
        return weights[[len(pieces) + b for b in c.encode()]].sum(axis=0)

    uses = np.zeros(len(weights))
    for word, row in zip(words[:-1], got, strict=False):
        text = MARK + word
        total = np.zeros(2)
        own = np.zeros(len(weights))
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[a:b] for a, b in zip([0, *ends], ends)]
            if all(p in value or len(p) == 1 for p in parts):
                w = np.exp(sum(value[p] if p in value else spell(p) for p in parts))
                total += w
                for p in parts:
                    for i in [pieces.index(p)] if p in value else [len(pieces) + b for b in p.encode()]:
                        own[i] += w[1]
        uses += own / total[1]
        assert np.allclose(np.exp(row), total)
    assert np.allclose(lattice.expected(words[:-1], 1), uses)


def test_likelihood_against_plain_sums(make):
    rows = [(i, " ".join(["The", "cat", f"n{i % 7}", "sat"][: 1 + i % 4]), "en" if i % 2 else None) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "unseen Wörter"), (502, "unseen Wörter"), (503, "cat " * 30_000)]
    got = lattice_lm.score_documents(make(rows), frequent=3).collect()
    assert len(got) == len(rows)
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows}
    split = lambda t: (t or "").lower().split()
    counts = Counter(w for i, t, *_ in rows if not held[i] for w in split(t))
    ends = sum(not held[i] for i, *_ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    plain = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    text = {i: t for i, t, *_ in rows}
    for r in got:
        own = split(text[r["doc_id"]])
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(own) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(w in counts for w in own) + 1
        assert r["base_score"] == pytest.approx(sum(plain(counts[w]) for w in own) + plain(ends))
        assert r["score"] < 0
    every = lattice_lm.score_documents(make(rows), frequent=10_000).collect()
    key = lambda r: (r["doc_id"], round(r["score"], 6))
    assert sorted(map(key, got)) == sorted(map(key, every))


def test_likelihood_is_a_probability(make):
    """The chance of all one-word texts over a closed set of words stays below one."""
    rows = [(i, w, "en") for i, w in enumerate(["aa", "ab", "ba", "bb", "a", "b", "abc", "aa", "ab"] * 5)]
    got = lattice_lm.score_documents(make(rows)).collect()
    chance = {r["doc_id"] % 9: 10 ** r["score"] for r in got}
    assert 0 < sum(chance[i] for i in range(7)) < 1


def test_likelihood_beats_plain_words_on_held_out(spark):
    got = QUERIES["op9_lattice_likelihood"](spark, SMALL).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_likelihood_empty(make):
    assert lattice_lm.score_documents(make([])).count() == 0
    only = lattice_lm.score_documents(make([(29, "all held out")])).collect()  # crc32 of 29 mod 10 is 0 or not
    assert len(only) == 1 and only[0]["score"] < 0
