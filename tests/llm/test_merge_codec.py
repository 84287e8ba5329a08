import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from leadloom.llm import merge_codec
from leadloom.llm.common import table
from leadloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def codec():
    return merge_codec.Codec.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(merge_codec.WORD_FILE)


def _agrees(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert got.tolist() == ids, text[:200]
    assert codec.decode(got) == library.decode(ids, skip_special_tokens=False)


def _plain_merges(pairs, symbols):
    """Repeatedly the lowest rank, leftmost first."""
    rank = {p: i for i, p in enumerate(pairs)}
    now = list(symbols)
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(now, now[1:])) if p in rank), default=None)
        if found is None:
            return now
        now[found[1] : found[1] + 2] = [now[found[1]] + now[found[1] + 1]]


def test_texts_as_the_library(codec, library):
    for text in (
        "", " ", "Hello, World's 123 we'll", "x\x1cy\x1f z\x85w\xa0v", "ΣΑΣ İstanbul ȩ́ ́a Å", "<|endoftext|>a<|startoftext|><|endof", "e<|endoftext|>́",
        "日本語テキスト 한국어 가", "😀👍🏽", "''s 'S ''''s", "a​b﻿c", " 　 ", "naïve café ÀÉÎ", "٣٤५ ½ Ⅷ", "a_b-c--d...e", "\x00\x01",
    ):
        _agrees(codec, library, text)


def test_long_words_as_the_library(codec, library):
    rng = random.Random(1)
    for alphabet in ("ab", "abc", "in", "thean", "aeiounrst", "abcdefghijklmnopqrstuvwxyz", "a", "éàü", "=-", "日本語", "hahe"):
        for size in (3, 40, 700, 5_000):
            _agrees(codec, library, "".join(rng.choice(alphabet) for _ in range(size)))
    words = [t.removesuffix("</w>") for t in rng.sample(sorted(library.get_vocab()), 4_000) if t.removesuffix("</w>").isascii()]
    _agrees(codec, library, "".join(w for w in words if w.isalpha()))
    _agrees(codec, library, " ".join(words))
    _agrees(codec, library, "q" * 200_000 + " the end")


def test_the_transducer_keeps_little(codec, library):
    rng = random.Random(2)
    machine = merge_codec.Transducer(codec.merges)
    text = "".join(rng.choice("thean") for _ in range(30_000))
    symbols, out, at = codec.symbols(text), [], 0
    while at < len(symbols):
        size = rng.randint(1, 900)
        out += machine.feed(symbols[at : at + size])
        at += size
        assert len(machine.text) < codec.merges.lookahead + machine.step
    assert len(out) > 0
    out += machine.finish()
    assert [codec.ids[t] for t in out] == library.encode(text, add_special_tokens=False).ids


def test_forgotten_words_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(merge_codec, "REMEMBERED", 50)
    other = merge_codec.Codec.read()
    rng = random.Random(3)
    for _ in range(40):
        _agrees(other, library, " ".join("".join(rng.choice("thean's1é") for _ in range(rng.randint(1, 30))) for _ in range(30)))


def test_small_lists_against_plain_merging():
    """Merge lists made to let one symbol change borders far to the left."""
    rng = random.Random(4)
    for _ in range(150):
        symbols = list("abc")
        known, pairs = list(symbols), []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(known), rng.choice(known)
            if a + b not in known and len(a + b) < 7:
                known.append(a + b)
                pairs.append((a, b))
        merges = merge_codec.Merges(pairs, symbols)
        for _ in range(12):
            text = "".join(rng.choice(symbols) for _ in range(rng.randint(1, 300)))
            machine, out, at = merge_codec.Transducer(merges), [], 0
            while at < len(text):
                size = rng.randint(1, 100)
                out += machine.feed(text[at : at + size])
                at += size
                assert len(machine.text) < merges.lookahead + machine.step
            assert out + machine.finish() == _plain_merges(pairs, text)


def test_a_list_that_is_not_proper_is_refused():
    with pytest.raises(ValueError, match="proper"):
        merge_codec.Merges([("ab", "c")], ["a", "b", "c"])
    with pytest.raises(ValueError, match="proper"):
        merge_codec.Merges([("a", "b"), ("a", "b")], ["a", "b"])


def test_decoding_in_pieces(codec):
    text = "naïve 日本語 the 😀 <|endoftext|> end"
    ids = codec.encode(text)
    for spaced in (True, False):
        machine = codec.decoder(spaced)
        parts = "".join(machine.feed(ids[i : i + 1]) for i in range(len(ids))) + machine.finish()
        assert parts == codec.decode(ids, spaced)
    assert codec.decode(ids, spaced=False) == "naïve 日本語 the 😀 <|endoftext|>end "
    half = codec.encode("𒀀")[:1]
    assert codec.decode(half, spaced=False).endswith("�") and codec.decode(np.zeros(0, dtype="<i4")) == ""


def test_query_as_the_library(spark, library, make):
    folder = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for r in table(spark, folder, "documents").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        expected[r["doc_id"]] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_stream_bpe"](spark, folder).collect()}
    assert got == expected
    docs = make([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")])
    rows = merge_codec.digests(merge_codec.transcode(docs)).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(1, 0), (2, 0), (None, 2), (3, 2), (3, 2)]
    assert rows[0]["ids_sha256"] == rows[0]["decoded_sha256"] == sha("")
    assert merge_codec.transcode(docs.where("false")).count() == 0
