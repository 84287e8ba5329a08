"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Tokens are an encoding if and only if each stands alone and all neighbours agree: no merge across
their border would have come before the merges that made them. So a window of a word is encoded by
looking for the one way through it in which they do. How far back a further symbol can still move a
border is bounded by the list of merges alone (``lookahead``); tokens that end before that reach are
emitted and forgotten.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from collections.abc import Callable, Iterator
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_FILE = "/opt/tokenizers/word_bpe_49k.json"
#: The last symbol of a word is another symbol than the same byte inside it.
LAST = 0x10000
#: The words of a text, as the file names them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that are remembered per task; beyond it the memory starts anew.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 48
#: Texts are cut at a space after about so many characters, and so many documents leave a task at once.
PIECE, AT_ONCE = 1 << 16, 512


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Merges in order of rank, over strings whose last symbol may be marked as the end of a word.

    The list must be proper: every token is made by one merge, out of parts that were made before.
    """

    def __init__(self, pairs: list[tuple[str, str]], symbols: list[str]):
        self.rank = dict.fromkeys(symbols, -1)
        self.parts: dict[str, tuple[str, str]] = {}
        for rank, (a, b) in enumerate(pairs):
            if a not in self.rank or b not in self.rank or a + b in self.rank:
                raise ValueError(f"merge {rank} is not proper")
            self.rank[a + b] = rank
            self.parts[a + b] = (a, b)
        self.longest = max(map(len, self.rank), default=1)
        #: Every beginning of a token, and whether it is a token itself.
        self.heads = {token[:i]: False for token in self.rank for i in range(1, len(token))}
        self.heads.update(dict.fromkeys(self.rank, True))
        self.lookahead = self._lookahead(pairs, symbols) + self.longest
        self.known: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    @staticmethod
    def _lookahead(pairs: list[tuple[str, str]], symbols: list[str]) -> int:
        """Symbols before the end of the text whose borders a further symbol may still change.

        Compare the encodings of a text and of the same text with more behind it. At every rank they
        differ from some border on. The token behind that border moves the difference to the left
        only when a merge takes it as its right part; then the token in question is that merge's
        left part (where the merge did not happen) or its result (where it did). As a left part of a
        merge it grows and the border stays. Ranks rise along such a chain, so the greatest distance
        is found in one pass over the merges from the last to the first.
        """
        reach: dict[str, int] = {}
        for a, b in reversed(pairs):
            grown, kept = reach.get(a + b, 0), reach.get(a, 0)
            moved = len(a) + max(grown, kept)
            reach[a] = max(kept, grown)
            reach[b] = max(reach.get(b, 0), moved)
        return max((reach.get(s, 0) for s in symbols), default=0)

    def holds(self, a: str, b: str, limit: int) -> bool:
        """Whether no merge below ``limit`` crosses the border between the tokens a and b.

        The merges that made them are taken back, the latest first. A crossing merge of the rank of
        the merge taken back on the right would have come first, as it stands further left.
        """
        rank, parts = self.rank, self.parts
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit and parts[a + b] == (a, b):
                return False
            left, right = rank[a], rank[b]
            if left < 0 and right < 0:
                return True
            if left > right:
                limit, a = left, parts[a][1]
            else:
                limit, b = right + 1, parts[b][0]

    def agree(self, a: str, b: str) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[a, b] = self.holds(a, b, len(self.rank))
        return found

    def stands(self, token: str) -> bool:
        """Whether the token's own string is encoded as this one token."""
        found = self.whole.get(token)
        if found is None:
            if token in self.parts:
                a, b = self.parts[token]
                found = self.stands(a) and self.stands(b) and self.holds(a, b, self.rank[token])
            else:
                found = True
            self.whole[token] = found
        return found


class Transducer:
    """Encodes a word from pieces of any size; holds about twice the lookahead at most.

    Tokens that end a lookahead or more before the end of what was read are stable: they are emitted
    and forgotten, but for the last, with which the next one must agree.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.step = max(merges.lookahead, 64)
        self.text, self.before = "", ""

    def feed(self, symbols: str) -> list[str]:
        """Take more symbols; the tokens that nothing behind them can change any more."""
        out: list[str] = []
        for at in range(0, len(symbols), self.step):
            self.text += symbols[at : at + self.step]
            if len(self.text) >= self.merges.lookahead + self.step:
                out += self._stable()
        return out

    def finish(self) -> list[str]:
        """The rest; the transducer is then ready for another word."""
        out = self._tokens()
        self.text, self.before = "", ""
        return out

    def _stable(self) -> list[str]:
        stable, end = [], 0
        for token in self._tokens():
            if end + len(token) > len(self.text) - self.merges.lookahead:
                break
            end += len(token)
            stable.append(token)
        if stable:
            self.text, self.before = self.text[end:], stable[-1]
        return stable

    def _tokens(self) -> list[str]:
        """The tokens of ``text``: the only way through it in which all neighbours agree.

        The longest token is tried first. A place that was reached and led nowhere is not tried
        again, since only one way leads to it.
        """
        text, merges, size = self.text, self.merges, len(self.text)
        heads, known, whole = merges.heads.get, merges.known.get, merges.whole.get
        way: list[str] = []
        choices: list[list[str]] = []
        dead: set[int] = set()
        at, previous, found = 0, self.before, None
        while at < size:
            if found is None:  # a place met for the first time
                found = []
                for end in range(at + 1, size + 1):
                    if (is_token := heads(token := text[at:end])) is None:
                        break
                    if is_token:
                        found.append(token)
            while found:
                token = found.pop()
                if at + len(token) in dead:
                    continue
                if previous:
                    agreed = known((previous, token))
                    if not (merges.agree(previous, token) if agreed is None else agreed):
                        continue
                if whole(token) or merges.stands(token):
                    choices.append(found)
                    way.append(token)
                    at, previous, found = at + len(token), token, None
                    break
            else:
                dead.add(at)
                at -= len(way.pop())
                previous, found = way[-1] if way else self.before, choices.pop()
        return way


class Memory(dict):
    """Results by word, at most ``REMEMBERED`` of them; long words are worked out each time."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work = work

    def __missing__(self, word: str) -> bytes:
        found = self.work(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class Codec:
    """The encoder and decoder that a tokenizer file of this kind describes.

    Texts are cut at the special tokens, composed (NFC), lower-cased character by character and
    split into words; the bytes of each word are merged. White space is dropped.
    """

    def __init__(self, description: str):
        found = json.loads(description)
        model = found["model"]
        steps = [s["type"] for s in found["normalizer"]["normalizers"]]
        split, level = found["pre_tokenizer"]["pretokenizers"]
        plain = not (model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"))
        if not plain or steps != ["NFC", "Replace", "Lowercase"] or level["use_regex"] or level["add_prefix_space"] or found["decoder"]:
            raise ValueError("a tokenizer file of another kind")
        suffix = model["end_of_word_suffix"]
        self.bytes = byte_symbols()

        def marked(token: str) -> str:
            if not token.endswith(suffix):
                return token
            body = token[: -len(suffix)]
            return body[:-1] + chr(ord(body[-1]) + LAST)

        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        symbols = [*self.bytes, *(chr(ord(c) + LAST) for c in self.bytes)]
        self.merges = Merges([(marked(a), marked(b)) for a, b in pairs], symbols)
        self.ids = {marked(token): i for token, i in model["vocab"].items()}
        self.strings = {i: token for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.strings.update({i: t for t, i in self.special.items()})
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in found["added_tokens"]):
            raise ValueError("a special token of another kind")
        inside = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.at_special = re.compile(f"({inside})").split if inside else (lambda text: [text])
        firsts = {t[0] for t in self.special}
        self.mark = firsts.pop() if len(firsts) == 1 else ""  # runs without it hold no special token
        if split["pattern"]["Regex"] != PATTERN:
            raise ValueError("a tokenizer file with other words")
        self.words_of = regex.compile(split["pattern"]["Regex"]).findall
        #: The same for text in lower-case ASCII.
        self.plain_words_of = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall
        self.transducer = Transducer(self.merges)
        self.words = Memory(self._word)

    @classmethod
    def read(cls, path: str = WORD_FILE) -> Codec:
        return cls(Path(path).read_text(encoding="utf-8"))

    def symbols(self, word: str) -> str:
        """The bytes of a word as symbols, the last one marked."""
        found = word if word.isalnum() and word.isascii() else "".join(map(self.bytes.__getitem__, word.encode("utf-8", "replace")))
        return found[:-1] + chr(ord(found[-1]) + LAST)

    def _word(self, word: str) -> bytes:
        if word in self.special:  # the words of a text hold no whole special token
            return pack("<i", self.special[word])
        tokens = self.transducer.feed(self.symbols(word))
        tokens += self.transducer.finish()
        return pack(f"<{len(tokens)}i", *map(self.ids.__getitem__, tokens))

    def _words(self, text: str) -> list[str]:
        """Words of a text without special tokens; a capital sigma is lowered without regard to its place."""
        if text.isascii():
            return self.plain_words_of(text.lower())
        return self.words_of(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """Token numbers, piece by piece of the text; pieces end before a space, which composes with nothing."""
        at = 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end] not in " \n\t":
                end += 1
            piece, at = text[at:end], end
            parts = self.at_special(piece) if self.mark in piece else [piece]
            for i, part in enumerate(parts):
                words = [part] if i % 2 else self._words(part)
                yield np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<i4")

    def encode(self, text: str | None) -> np.ndarray:
        found = list(self.pieces(text or ""))
        return np.concatenate(found) if found else np.zeros(0, dtype="<i4")

    def decoder(self, spaced: bool = True) -> Decoder:
        return Decoder(self, spaced)

    def decode(self, ids: np.ndarray, spaced: bool = True) -> str:
        machine = self.decoder(spaced)
        return "".join(machine.feed(ids[at : at + PIECE]) for at in range(0, len(ids), PIECE)) + machine.finish()


class Decoder:
    """From token numbers to text, as they come.

    The state is whether something was said and the bytes of a character that is not complete yet.
    With ``spaced`` the tokens' strings are joined by spaces, as the file's empty decoder does; without,
    symbols are turned back into the bytes they stand for, and a word's end becomes a space.
    """

    def __init__(self, codec: Codec, spaced: bool):
        self.spaced, self.said = spaced, False
        if spaced:
            self.content = {i: token.encode() for i, token in codec.strings.items()}
        else:
            byte = {c: bytes([b]) for b, c in enumerate(codec.bytes)}
            self.content = {i: t.encode() for t, i in codec.special.items()}
            for token, i in codec.ids.items():
                body = b"".join(byte[c if ord(c) < LAST else chr(ord(c) - LAST)] for c in token)
                self.content[i] = body + b" " if ord(token[-1]) >= LAST else body
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        between = b" " if self.spaced else b""
        content = between.join(map(self.content.__getitem__, ids.tolist()))
        content, self.said = (between if self.said else b"") + content, True
        return self.state.decode(content)

    def finish(self) -> str:
        self.said = False
        return self.state.decode(b"", final=True)


ENCODED = "n_tokens bigint, ids array<int>, decoded string"


def transcode(docs: DataFrame, path: str = WORD_FILE) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, decoded (the text that the ids stand for).

    Null and empty texts have no tokens and decode to the empty text; repeated rows get the same
    result, an empty table gives an empty one, and columns other than doc_id and text are not read.
    The file is read once, on the driver; its size bounds what travels with the tasks.
    """
    description = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, ids_back = None, None
        for whole in batches:
            codec = codec or Codec(description.value)
            ids_back = ids_back or codec.decoder()
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                found = [codec.encode(text) for text in batch.column(1).to_pylist()]
                texts = []
                for ids in found:
                    parts = [ids_back.feed(ids[i : i + PIECE]) for i in range(0, len(ids), PIECE)]
                    texts.append("".join(parts) + ids_back.finish())
                sizes = np.array([len(f) for f in found], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes), lists, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {ENCODED}")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, one space between) and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
