"""Token counts under a unigram vocabulary, without building the tokens."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.vocabulary import MARK, PIECE_FILE, Vocabulary

#: Words remembered per Python worker; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Longer words are counted each time they occur.
LONGEST_REMEMBERED = 64
COUNTED = "n_chars bigint, n_tokens bigint, n_unknown bigint, score double"


class Counter:
    """Number of pieces and score of the best segmentation.

    The lattice falls apart wherever no piece can span: before a space mark that follows another
    character, and around a line feed. Each part is solved once and remembered.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, int, float]] = {}
        inner = any(MARK in p.lstrip(MARK) for p in vocabulary.pieces)
        feed = any("\n" in p for p in vocabulary.pieces)
        self.parts = re.compile("(?s:.+)" if inner or feed else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall

    def best(self, part: str) -> tuple[int, int, float]:
        """Pieces, unknown characters and score of the best path through ``part``.

        Matches are met by their end. Of paths with equal scores the one whose last piece begins
        first stays, as in the tokenizer: a later start must be strictly better. A character that
        is no piece by itself may be taken as unknown; it costs the worst piece's score and a
        penalty, and counts as its UTF-8 bytes. Scores are added exactly in double precision.
        """
        scores, unknown = self.vocabulary.scores, self.vocabulary.unknown
        pieces = self.vocabulary.pieces
        ends: list[list[tuple[int, float]]] = [[] for _ in part]
        for end, i in self.vocabulary.automaton.iter(part):
            ends[end].append((len(pieces[i]), scores[i]))
        total = [0.0] * (len(part) + 1)
        count = [0] * (len(part) + 1)
        missed = [0] * (len(part) + 1)
        for at, found in enumerate(ends, 1):
            best, single = float("-inf"), False
            if len(found) > 1:
                found.sort(reverse=True)  # the longest begins first
            for size, score in found:
                single = single or size == 1
                if (value := total[at - size] + score) > best:
                    best, count[at], missed[at] = value, count[at - size] + 1, missed[at - size]
            if not single and (value := total[at - 1] + unknown) > best:
                best = value
                count[at] = count[at - 1] + len(part[at - 1].encode("utf-8", "surrogatepass"))
                missed[at] = missed[at - 1] + 1
            total[at] = best
        return count[-1], missed[-1], total[-1]

    def __call__(self, text: str | None) -> tuple[int, int, int, float]:
        if not text:
            return 0, 0, 0, 0.0
        known = self.known
        n = missed = 0
        score = 0.0
        for part in self.parts(MARK + text.replace(" ", MARK)):
            if (found := known.get(part)) is None:
                found = self.best(part)
                if len(part) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = found
            n += found[0]
            missed += found[1]
            score += found[2]
        return len(text), n, missed, score


def count_tokens(docs: DataFrame, path: str = PIECE_FILE, text: str = "text") -> DataFrame:
    """Per row: the columns of ``docs`` but the text, n_chars, n_tokens, n_unknown and score.

    ``score`` is the sum of the best segmentation's piece scores, ``n_tokens`` its number of
    pieces with unknown characters counted as bytes. The text gets a leading space mark, and
    spaces become marks; nothing else is changed. Null and empty texts have zero tokens and score
    zero. Rows stay where they are: no shuffle, one pass, repeated rows alike, an empty table
    gives an empty result. Columns of ``docs`` named like a result column are dropped.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(path)
    shared = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.scores))  # bounded by the file
    made = [part.split()[0] for part in COUNTED.split(", ")]
    others = [c for c in docs.columns if c != text and c not in made]
    narrow = docs.select(*others, F.col(text).alias("_text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(Vocabulary(*shared.value))
        for batch in batches:
            rows = [counter(t) for t in batch.pop("_text")]
            yield batch.assign(**dict(zip(made, zip(*rows, strict=True), strict=True))) if rows else batch.assign(
                **{c: [] for c in made}
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_text")
    return narrow.mapInPandas(counted, f"{kinds}, {COUNTED}" if kinds else COUNTED)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
