"""Document likelihood under a subword lattice whose weights are learned from the corpus."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import remainder, written
from leadloom.llm.vocabulary import MARK, PIECE_FILE, Vocabulary

#: At most so many of the most frequent words are looked up in the tasks; all others meet in a join.
FREQUENT = 50_000
#: Distinct words gathered in a task before they are handed on.
GATHERED = 300_000
ROUNDS = 2
#: Weight of the vocabulary's own scores against the words, in words.
PRIOR_WORDS = 1000.0
#: Models, by the label of the training texts, besides one for all further labels.
MODELS = 8
#: Part of the discounted mass that goes to the words of all models.
SHARED = 0.2
#: Additive constant of the plain word score.
ADDED = 0.1
LN10 = float(np.log(10.0))


class Lattice:
    """All segmentations of words into pieces; log-space sums over many words and models at once.

    An arc is a piece, or an unknown character spelled by its bytes. The words of a batch are laid
    side by side in one string, so that one automaton run finds the arcs of all of them, and each
    step of the recursion moves all words ahead by one character. ``weights`` has a row per piece
    and then per byte, and a column per model; all are natural logs.
    """

    def __init__(self, pieces: tuple[str, ...], weights: np.ndarray):
        self.pieces, self.weights = pieces, weights

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if "\n" not in piece:
                found.add_word(piece, i)
        found.make_automaton()
        return found

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(p) for p in self.pieces])

    def _arcs(self, words: list[str], models: slice = slice(None)):
        """Begin and stop of each word; start, end, weights and word of each arc; its uses."""
        lengths = np.array([len(w) + 2 for w in words])
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        text = "".join(f"{MARK}{w}\n" for w in words)
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        end, piece = flat[:, 0] + 1, flat[:, 1]
        start = end - self.sizes[piece]
        covered = np.zeros(len(text), dtype=bool)
        covered[start[end - start == 1]] = True
        covered[begin + lengths - 1] = True
        unknown = np.flatnonzero(~covered)
        base, weights = len(self.pieces), self.weights[:, models]
        bytes_ = [[base + b for b in text[i].encode("utf-8", "surrogatepass")] for i in unknown]
        spell = np.array([weights[b].sum(axis=0) for b in bytes_]).reshape(-1, weights.shape[1])
        start, end = np.concatenate([start, unknown]), np.concatenate([end, unknown + 1])
        weight = np.concatenate([weights[piece], spell])
        word = np.repeat(np.arange(len(words)), lengths)[start]
        return begin, begin + lengths - 1, start, end, weight, word, (piece, bytes_)

    @staticmethod
    def _sweep(values: np.ndarray, origin: np.ndarray, target: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        """values[target] = log sum of exp(values[origin] + weight), in the order of ``step``."""
        order = np.lexsort((target, step))
        for part in np.split(order, np.flatnonzero(np.diff(step[order])) + 1):
            to = target[part]
            first = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            values[to[first]] = np.logaddexp.reduceat(values[origin[part]] + weight[part], first, axis=0)

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of the total weight of all segmentations, per word and model."""
        models = self.weights.shape[1]
        if not words:
            return np.zeros((0, models))
        begin, stop, start, end, weight, word, _ = self._arcs(words)
        ahead = np.full((stop[-1] + 1, models), -np.inf)
        ahead[begin] = 0.0
        self._sweep(ahead, start, end, weight, end - begin[word])
        return ahead[stop]

    def expected(self, words: list[str], model: int) -> np.ndarray:
        """Expected uses of every piece and byte in one segmentation of each word by a model."""
        uses = np.zeros(len(self.weights))
        if not words:
            return uses
        begin, stop, start, end, weight, word, (piece, bytes_) = self._arcs(words, slice(model, model + 1))
        ahead, back = (np.full((stop[-1] + 1, 1), -np.inf) for _ in range(2))
        ahead[begin], back[stop] = 0.0, 0.0
        self._sweep(ahead, start, end, weight, end - begin[word])
        self._sweep(back, end, start, weight, begin[word] - start)
        share = np.exp(ahead[start] + weight + back[end] - ahead[stop][word])[:, 0]
        uses[: len(self.pieces)] = np.bincount(piece, share[: len(piece)], minlength=len(self.pieces))
        for part, at in zip(share[len(piece):], bytes_, strict=True):
            for b in at:
                uses[b] += part
        return uses


def start_weights(vocabulary: Vocabulary) -> np.ndarray:
    """Probabilities from the vocabulary's scores: log probabilities as they are, ranks by Zipf.

    One hundredth goes to the 256 bytes.
    """
    scores = np.array(vocabulary.scores)
    mass = np.exp(scores) if scores.sum() > -100.0 * len(scores) else 1.0 / (10.0 - scores)
    return np.concatenate([0.99 * mass / mass.sum(), np.full(256, 0.01 / 256)])


def _text_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(docs: DataFrame, model: Column, models: int) -> DataFrame:
    """word, c0, c1, ...: every distinct lower-cased word with its uses in the texts of a model.

    ``model`` is the model a text trains, or null. Counted in the tasks first, in parts of bounded
    size; the parts meet by word.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {k: Counter() for k in range(-1, models)}

        def handed() -> Iterator[pa.RecordBatch]:
            for k, counter in seen.items():
                if counter:
                    spelled_ = pa.array([w.decode("utf-8", "replace") for w in counter])
                    counts = pa.array([n if k >= 0 else 0 for n in counter.values()], pa.int64())
                    which = pa.array([k] * len(counter), pa.int32())
                    yield pa.RecordBatch.from_arrays([spelled_, which, counts], names=["word", "k", "c"])
                    counter.clear()

        for batch in batches:
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[-1 if k is None else k].update(_text_words(text))
                if sum(map(len, seen.values())) > GATHERED:
                    yield from handed()
        yield from handed()

    parts = docs.select("text", model.cast("int").alias("k")).mapInArrow(gather, "word string, k int, c bigint")
    uses = [F.sum(F.when(F.col("k") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(models)]
    return parts.groupBy("word").agg(*uses)


def learn(words: DataFrame, models: int, path: str = PIECE_FILE, rounds: int = ROUNDS) -> Lattice:
    """The vocabulary's pieces with probabilities re-estimated on each model's distinct words.

    Expectation maximisation from the vocabulary's own scores, which stay as a prior. A round is
    one pass over the words; each task hands on one sum per piece and model, so at most the
    vocabulary reaches the driver. A word counts once: the lattice speaks for the words that their
    own counts do not cover.
    """
    spark = words.sparkSession
    vocabulary = Vocabulary.read(path)
    prior = start_weights(vocabulary)[:, None]
    mass = np.repeat(prior, models, axis=1)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary.pieces, np.log(mass)))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            total = np.zeros(lattice.weights.shape)
            for batch in batches:
                spelled_ = np.array(batch.column(0).to_pylist(), dtype=object)
                for k in range(models):
                    total[:, k] += lattice.expected(list(spelled_[batch.column(k + 1).to_numpy() > 0]), k)
            used, model = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(model), pa.array(total[used, model])], names=["i", "k", "uses"]
            )

        seen = words.where(F.greatest(*[F.col(f"c{k}") for k in range(models)], F.lit(0)) > 0)
        uses = seen.mapInArrow(expect, "i bigint, k bigint, uses double")
        sums = uses.groupBy("i", "k").agg(F.sum("uses").alias("uses")).collect()
        mass = np.repeat(PRIOR_WORDS * prior, models, axis=1)
        for row in sums:
            mass[row["i"], row["k"]] += row["uses"]
        mass = mass / mass.sum(axis=0)
    return Lattice(vocabulary.pieces, np.log(mass))


def spelled(words: DataFrame, lattice: Lattice) -> DataFrame:
    """Add ``s0``, ``s1``, ...: the log probability that the lattice of a model gives to the word."""
    models = lattice.weights.shape[1]
    shared = words.sparkSession.sparkContext.broadcast((lattice.pieces, lattice.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*shared.value)
        for batch in batches:
            values = own.score(batch.column(0).to_pylist())
            columns = [pa.array(values[:, k].copy()) for k in range(models)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *[f"s{k}" for k in range(models)]]
            )

    kinds = ["word string", *[f"c{k} bigint" for k in range(models)], *[f"s{k} double" for k in range(models)]]
    return words.mapInArrow(score, ", ".join(kinds))


def score_documents(
    docs: DataFrame,
    trains: Column | None = None,
    kind: str | None = "lang",
    path: str = PIECE_FILE,
    frequent: int = FREQUENT,
    most_models: int = MODELS,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased words of the text and one end. There is a model for each value of
    ``kind`` among the training rows, up to ``most_models`` with most rows, and one for the rest.
    A model gives a word the share ``(c - d) / N`` of its own counts, less a discount, as an arc
    over the whole word, and spends the discounted mass on the piece lattice, whose forward
    recursion in log space sums all segmentations, and to a small part on the words of all models.
    ``score`` is the log10 probability of the whole text: the text is drawn from one model, which
    is unknown, so ``kind`` is not read when scoring. ``base_score`` is the plain additive word
    score.

    The word table grows with the corpus and stays distributed. The ``frequent`` words with most
    uses are looked up inside the tasks, so that the other words, none of which is frequent, meet
    their documents in a join without hot keys. Each row is summed under its own number, so
    repeated rows are scored one by one. Null and empty texts have the end alone. Without any
    training row the lattice alone speaks. Columns other than doc_id, text and ``kind`` are not
    read.
    """
    spark = docs.sparkSession
    trains = remainder(F.col("doc_id"), 10) != 0 if trains is None else trains
    label = F.coalesce(F.col(kind), F.lit("")) if kind else F.lit("")
    rows = docs.select("doc_id", "text", trains.alias("trains"), label.alias("kind"))
    taught = rows.where("trains").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    ends = taught.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top_kinds = taught.orderBy(F.col("n").desc(), "kind").limit(most_models).collect()
    names, shares = [r["kind"] for r in top_kinds], [r["n"] / ends for r in top_kinds]
    if not names or sum(shares) < 1 - 1e-12:
        shares.append(max(1.0 - sum(shares), 1e-12))
    models = len(shares)
    place = reduce(lambda rest, k: F.when(F.col("kind") == names[k], k).otherwise(rest), range(len(names)), F.lit(models - 1))
    words = written(word_counts(rows, F.when(F.col("trains"), place), models), "words")
    words = written(spelled(words, learn(words, models, path)), "spelled")

    total = reduce(lambda a, b: a + b, [F.col(f"c{k}") for k in range(models)])
    facts = [F.coalesce(F.sum(total), F.lit(0)).alias("n"), F.count_if(total > 0).alias("v")]
    for k in range(models):
        c = F.col(f"c{k}")
        facts += [F.coalesce(F.sum(c), F.lit(0)).alias(f"n{k}")]
        facts += [F.count_if(c > 0).alias(f"v{k}"), F.count_if(c == 1).alias(f"o{k}"), F.count_if(c == 2).alias(f"t{k}")]
    fact = words.agg(*facts).first()
    tokens, distinct = fact["n"] + ends, fact["v"] + (1 if ends else 0)
    end = (ends + 0.5) / (tokens + 1.0)
    below = ADDED * (distinct + 1) + tokens
    shared_part = SHARED if fact["n"] else 0.0
    scores = []
    for k in range(models):
        once, running = fact[f"o{k}"], fact[f"n{k}"]
        discount = min(max(once / (once + 2 * fact[f"t{k}"]), 0.05), 0.95) if once else 0.5
        rest = discount * fact[f"v{k}"] / running if running else 1.0
        own = F.greatest(F.col(f"c{k}") - discount, F.lit(0.0)) / max(running, 1)
        own = own + rest * shared_part * F.col("c") / max(fact["n"], 1)
        lattice = F.col(f"s{k}") + float(np.log(rest * (1.0 - shared_part)))
        scores.append(
            F.when(own > 0, F.log10((own + F.exp(lattice)) * (1.0 - end)))
            .otherwise((lattice + float(np.log(1.0 - end))) / LN10)
            .alias(f"lp{k}")
        )
    sums = ["known", "base", *[f"lp{k}" for k in range(models)]]
    scored = words.withColumn("c", total).select(
        "word", "c", (F.col("c") > 0).cast("double").alias("known"),
        F.log10((F.col("c") + ADDED) / below).alias("base"), *scores,
    )
    # an eighth of a doubling per step, so a few hundred rows; whole steps are taken from the top
    step = F.floor(F.log2(F.col("c") + 1) * 8)
    least, held = None, 0
    for r in sorted(scored.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > frequent:
            break
        least = r["s"]
    top = scored.where(step >= least).collect() if least is not None else []  # at most ``frequent`` rows
    table = np.array([[r[c] for c in sums] for r in top], dtype=float).reshape(len(top), len(sums))
    shared = spark.sparkContext.broadcast(({r["word"].encode(): i for i, r in enumerate(top)}, table))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums per text, under a word no text has, and a row for each other word."""
        known, values = shared.value

        def handed(rows_: list, others: tuple[list, list, list], at: list, n: list, size: list) -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(rows_)), size)
            added = np.zeros((len(rows_), len(sums)))
            np.add.at(added, owner, values[np.array(at, dtype=np.int64)] * np.array(n, dtype=float)[:, None])
            gap = [None] * len(others[0])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r for r, _ in rows_] + others[0], pa.int64()),
                    pa.array([f" {r}" for r, _ in rows_] + others[1], pa.string()),
                    pa.array([0] * len(rows_) + others[2], pa.int64()),
                    pa.array([m for _, m in rows_] + gap, pa.int64()),
                    *[pa.array(added[:, i].tolist() + gap, pa.float64()) for i in range(len(sums))],
                ],
                names=["row", "word", "n", "n_tokens", *sums],
            )

        state: tuple = ([], ([], [], []), [], [], [])
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows_, (rest_row, rest_word, rest_n), at, n, size = state
                counted = Counter(_text_words(text))
                before, beyond = len(at), len(rest_n)
                for word, times in counted.items():
                    if (i := known.get(word)) is None:
                        rest_word.append(word.decode("utf-8", "replace"))
                        rest_n.append(times)
                    else:
                        at.append(i)
                        n.append(times)
                rest_row.extend([row] * (len(rest_n) - beyond))
                size.append(len(at) - before)
                rows_.append((row, counted.total() + 1))
                if len(at) + len(rest_n) + len(rows_) >= 200_000:
                    yield handed(*state)
                    state = ([], ([], [], []), [], [], [])
        if state[0]:
            yield handed(*state)

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    looked = numbered.select("row", "text").mapInArrow(
        look_up, ", ".join(["row bigint, word string, n bigint, n_tokens bigint", *[f"{c} double" for c in sums]])
    )
    right = scored.select("word", *[F.col(c).alias(f"_{c}") for c in sums])
    joined = looked.join(right, "word", "left")
    by_row = joined.groupBy("row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        *[F.sum(F.coalesce(F.col(c), F.col("n") * F.col(f"_{c}"))).alias(c) for c in sums],
    )
    parts = [F.col(f"lp{k}") + float(np.log10(share)) for k, share in enumerate(shares)]
    best = F.greatest(*parts, F.lit(float("-inf"))) if models == 1 else F.greatest(*parts)
    mixed = best + F.log10(reduce(lambda a, b: a + b, [F.pow(F.lit(10.0), p - best) for p in parts]))
    return numbered.select("row", "doc_id", (~F.col("trains")).alias("held_out")).join(by_row, "row").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known").cast("bigint") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + float(np.log10((ends + ADDED) / below))).alias("base_score"),
        (mixed + float(np.log10(end))).alias("score"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
