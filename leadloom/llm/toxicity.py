"""Toxic spans by a linear-chain conditional random field, learned from labelled documents."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import remainder

#: Documents of either label that are read for learning, in expectation.
TRAINING_DOCS = 2_000
#: Consecutive tokens of one chain.
CHAIN = 32
#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
#: How much more often a feature must occur in toxic documents to mark a token.
ODDS = 10.0
SURE = 15.0
EPOCHS, BATCHES, RATE, DECAY = 6, 16, 0.5, 1e-5
#: Words remembered per Python worker.
REMEMBERED = 300_000
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W_]+")
EDGE = 30.0


def features(token: str) -> list[str]:
    word = token.lower()
    return [f"={word}", f"-{word[-3:]}", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def chains(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut the tokens of each text into chains; (places of the tokens, which places are tokens)."""
    rows = -(-lengths // CHAIN)
    starts = np.concatenate([[0], np.cumsum(rows)]) * CHAIN
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    at = np.arange(len(values)) + np.repeat(starts[:-1] - first, lengths)
    filled = np.zeros(starts[-1], dtype=bool)
    filled[at] = True
    return at, filled.reshape(-1, CHAIN)


def marginals(odds: np.ndarray, filled: np.ndarray, first: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Forward-backward over many chains: chance of a toxic tag per place, and expected moves.

    ``odds``: exp of the emission score of the toxic tag; ``first`` and ``move``: exp of the start
    and transition scores. Both passes are scaled at each step.
    """
    n, width = odds.shape
    ahead, back = np.empty((width, 2, n)), np.empty((width, 2, n))
    a0, a1 = np.full(n, first[0]), first[1] * odds[:, 0]
    for t in range(width):
        if t:
            a0, a1 = (
                ahead[t - 1, 0] * move[0, 0] + ahead[t - 1, 1] * move[1, 0],
                (ahead[t - 1, 0] * move[0, 1] + ahead[t - 1, 1] * move[1, 1]) * odds[:, t],
            )
        total = a0 + a1
        ahead[t, 0], ahead[t, 1] = a0 / total, a1 / total
    b0 = b1 = np.ones(n)
    back[width - 1] = 1.0
    for t in range(width - 2, -1, -1):
        up = odds[:, t + 1] * b1
        n0, n1 = move[0, 0] * b0 + move[0, 1] * up, move[1, 0] * b0 + move[1, 1] * up
        total = n0 + n1
        goes_on = filled[:, t + 1]
        b0, b1 = np.where(goes_on, n0 / total, 1.0), np.where(goes_on, n1 / total, 1.0)
        back[t, 0], back[t, 1] = b0, b1
    joint = ahead * back
    chance = (joint[:, 1] / (joint[:, 0] + joint[:, 1])).T
    if not pairs:
        return chance
    moves = np.zeros((2, 2))
    for t in range(width - 1):
        both = [
            [ahead[t, i] * move[i, j] * (odds[:, t + 1] if j else 1.0) * back[t + 1, j] for j in (0, 1)]
            for i in (0, 1)
        ]
        total = both[0][0] + both[0][1] + both[1][0] + both[1][1]
        for i in (0, 1):
            for j in (0, 1):
                moves[i, j] += (both[i][j] / total)[filled[:, t + 1]].sum()
    return chance, moves


@dataclass
class Tagger:
    """Weights of features for the toxic tag, of the start and of the moves, and of the document."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -EDGE
    first: np.ndarray = field(default_factory=lambda: np.ones(2))
    move: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def emission(self, token: str) -> float:
        get = self.weights.get
        score = self.bias + sum(get(f, 0.0) for f in features(token))
        return float(np.exp(min(max(score, -EDGE), EDGE)))

    def remembered(self) -> Emissions:
        return Emissions(self)

    def tag(self, texts: list[str], known: Emissions) -> tuple[np.ndarray, np.ndarray]:
        """Chance of the toxic tag for every token of every text, and the tokens per text."""
        found = [TOKEN.findall(t) for t in texts]
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        values = np.array([known[w] for f in found for w in f], dtype=float)
        if len(known) > REMEMBERED:
            known.clear()
        if not len(values):
            return values, lengths
        at, filled = chains(values, lengths)
        odds = np.ones(filled.size)
        odds[at] = values
        return marginals(odds.reshape(filled.shape), filled, self.first, self.move).ravel()[at], lengths

    def evidence(self, chance: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per text: one, log odds of its most toxic token, log of the expected toxic tokens."""
        top, sums = np.zeros(len(lengths)), np.zeros(len(lengths))
        filled = np.flatnonzero(lengths)
        if len(filled):
            start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[filled]
            top[filled] = np.maximum.reduceat(chance, start)
            sums[filled] = np.add.reduceat(chance, start)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.column_stack([np.ones(len(lengths)), np.log(top / (1 - top)), np.log1p(sums)])

    def scores(self, chance: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.evidence(chance, lengths) @ self.document, -EDGE, EDGE)))


class Emissions(dict):
    """Emission of every token met so far."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger = tagger

    def __missing__(self, token: str) -> float:
        value = self[token] = self.tagger.emission(token)
        return value


def copy_groups(docs: list[np.ndarray]) -> np.ndarray:
    """A group for every document; near copies, which share a least hash of their shingles, are one."""
    group = list(range(len(docs)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    first: dict[tuple[int, int], int] = {}
    for i, ids in enumerate(docs):
        own = ids.astype(np.uint64) + np.uint64(1)
        while len(own) < 3:
            own = np.append(own, np.uint64(0))
        mixed = (own[:-2] * odd[0]) ^ ((own[1:-1] * odd[1]) << np.uint64(1)) ^ (own[2:] * odd[2])
        for seed in range(3):
            least = int(((mixed ^ (mixed >> np.uint64(29 + seed))) * odd[seed]).min())
            group[root(i)] = root(first.setdefault((seed, least), i))
    return np.array([root(i) for i in range(len(docs))])


def marking_features(docs: list[np.ndarray], toxic: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Which features tell toxic documents apart, counted once for a group of near copies.

    A feature must occur ``ODDS`` times as often in toxic groups as in others, in three at least,
    with a log-likelihood ratio of at least ``SURE``, so that chance and copies mark nothing.
    """
    groups = copy_groups(docs)
    held, totals = np.zeros((2, size + 1)), [0, 0]
    for label in (0, 1):
        for i in {groups[i]: i for i in np.flatnonzero(toxic == label)}.values():
            held[label, np.unique(table[np.unique(docs[i])])] += 1
            totals[label] += 1
    (k0, k1), (n0, n1) = held, totals
    both = (k0 + k1) / (n0 + n1)
    ratio = np.zeros(size + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, n, p in ((k1, n1, both), (k0, n0, both), (n1 - k1, n1, 1 - both), (n0 - k0, n0, 1 - both)):
            ratio += np.where(k > 0, 2 * k * np.log(k / (n * p)), 0.0)
    return (k1 >= 3) & (k1 / n1 >= ODDS * (k0 + 0.5) / (n0 + 1)) & (ratio >= SURE) & (np.arange(size + 1) < size)


def fit(texts: list[str], labels: list[int]) -> Tagger:
    """Tag tokens by the marking features of their labelled documents, then fit the field.

    The field is fitted by gradient steps on the log likelihood of the tags, whose expectations
    come from forward-backward; the document weights by Newton steps on the labels.
    """
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        tagger = Tagger()
        tagger.document[0] = EDGE if len(y) and y[0] else -EDGE
        return tagger
    place: dict[str, int] = {}
    docs = [
        np.array([place.setdefault(w.lower(), len(place)) for w in TOKEN.findall(t)], dtype=np.int64) for t in texts
    ]
    names: dict[str, int] = {}
    rows = [[names.setdefault(f, len(names)) for f in features(w)] for w in place]
    words, size, most = len(place), len(names), 2 + len(BEGINNINGS)
    table = np.array([r + [size] * (most - len(r)) for r in rows], dtype=np.int64).reshape(words, most)
    del place, rows
    marks = marking_features(docs, y, table, size)
    marked = marks[table].any(axis=1)

    order = np.random.default_rng(7).permutation(len(docs))
    weights, bias = np.zeros(size + 1), -3.0
    first, move = np.zeros(2), np.zeros((2, 2))
    speed = {"w": np.full(size + 1, 1e-6), "b": 1e-6, "f": np.full(2, 1e-6), "m": np.full((2, 2), 1e-6)}
    for _ in range(EPOCHS):
        for part in np.array_split(order, BATCHES):
            lengths = np.array([len(docs[i]) for i in part])
            if not lengths.sum():
                continue
            ids = np.concatenate([docs[i] for i in part])
            tags = marked[ids] & np.repeat(y[part] == 1, lengths)
            at, filled = chains(ids, lengths)
            emission = np.zeros(filled.size)
            emission[at] = weights[table].sum(axis=1)[ids] + bias
            chance, moves = marginals(
                np.exp(np.clip(emission, -EDGE, EDGE)).reshape(filled.shape), filled, np.exp(first), np.exp(move), True
            )
            tagged = np.zeros(filled.size)
            tagged[at] = tags
            tagged = tagged.reshape(filled.shape)
            gap = ((tagged - chance) * filled).ravel()[at]
            by_word = np.bincount(ids, gap, minlength=words)
            slope = np.bincount(table.ravel(), np.repeat(by_word, most), minlength=size + 1)
            slope = slope / len(part) - DECAY * weights
            slope[size] = 0.0
            here, after = tagged[:, :-1].astype(int), tagged[:, 1:].astype(int)
            going = filled[:, 1:]
            real = np.array([[((here == i) & (after == j) & going).sum() for j in (0, 1)] for i in (0, 1)])
            start = np.array([(tagged[:, 0] == 0).sum() - (1 - chance[:, 0]).sum(), (tagged[:, 0] - chance[:, 0]).sum()])
            for name, value, step in (
                ("w", weights, slope), ("f", first, start / len(part)), ("m", move, (real - moves) / len(part)),
            ):
                speed[name] += step * step
                value += RATE * step / np.sqrt(speed[name])
            step = gap.sum() / len(part)
            speed["b"] += step * step
            bias += RATE * step / np.sqrt(speed["b"])
    tagger = Tagger(
        {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-4}, float(bias), np.exp(first), np.exp(move)
    )
    tagger.document = _document_weights(tagger, texts, y)
    return tagger


def _document_weights(tagger: Tagger, texts: list[str], y: np.ndarray) -> np.ndarray:
    known = tagger.remembered()
    x = np.concatenate([tagger.evidence(*tagger.tag(texts[i : i + 256], known)) for i in range(0, len(texts), 256)])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -EDGE, EDGE)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - 1e-2 * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, trains: Column, most: int = TRAINING_DOCS) -> Tagger:
    """Fit a tagger on a hash sample of the labelled training rows, about ``most`` of each label.

    The sample is drawn among the labels, so only its ids, a bounded number, are broadcast to the
    scan of the documents. A document with several labels counts as toxic if one says so; null
    labels and labels without a document are not used.
    """
    marked = labels.where(F.col("toxic").isNotNull() & trains).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().limit(2).collect()}
    if not sizes:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, most / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    sample = marked.where(draw < share[F.col("toxic")]).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "text").agg(F.max("toxic").alias("toxic"))
    read = sorted((str(r["doc_id"]), r["text"] or "", int(r["toxic"] > 0)) for r in rows.collect())
    return fit([t for _, t, _ in read], [label for *_, label in read])


def tag_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Add score, predicted and spans to ``docs``, from the text alone.

    ``spans`` are the maximal runs of tokens whose chance of the toxic tag is at least one half,
    as begin and end in characters of the text. Null and empty texts have no token and get the
    score of a text without evidence. One pass, no shuffle; columns of these names are replaced.
    """
    made = ("score", "predicted", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(
        (tagger.weights, tagger.bias, tagger.first, tagger.move, tagger.document)
    )
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_body"))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(*shared.value)
        known = own.remembered()
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores, spans = np.zeros(len(texts)), [[] for _ in texts]
            for at in _pieces(texts):
                chance, lengths = own.tag([texts[i] for i in at], known)
                scores[at] = own.scores(chance, lengths)
                first = np.concatenate([[0], np.cumsum(lengths)])
                toxic = np.flatnonzero(chance >= 0.5)
                for k in np.unique(np.searchsorted(first, toxic, side="right") - 1):
                    spans[at[k]] = _spans(texts[at[k]], chance[first[k] : first[k + 1]] >= 0.5)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(spans, span)],
                names=[*batch.schema.names[:-1], *made],
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_body"]
    kinds += ["score double", "predicted int", "spans array<struct<begin:int,end:int>>"]
    return rows.mapInArrow(tag, ", ".join(kinds))


def _spans(text: str, toxic: np.ndarray) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    running = False
    for found, bad in zip(TOKEN.finditer(text), toxic, strict=True):
        if bad and running:
            out[-1]["end"] = found.end()
        elif bad:
            out.append({"begin": found.start(), "end": found.end()})
        running = bool(bad)
    return out


def _pieces(texts: list[str], size: int = 1 << 20) -> Iterator[list[int]]:
    """Indexes of the texts in runs of about ``size`` characters."""
    now, held = [], 0
    for i, text in enumerate(texts):
        now.append(i)
        held += len(text)
        if held >= size:
            yield now
            now, held = [], 0
    if now:
        yield now


def in_training(doc_id: Column) -> Column:
    return remainder(doc_id, 4) != 2


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, spans.

    Learned from the labelled rows whose crc32 of the id mod 4 is not 2; labels, language, source
    and id play no part in a score. Repeated rows get the same score; without labels every score
    is about 0; an empty table gives an empty result.
    """
    tagger = learn(docs, labels, in_training(F.col("doc_id")))
    rows = docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "text")
    return tag_documents(rows, tagger).select("doc_id", "held_out", "score", "predicted", "spans")


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    tagger = learn(docs, labels, in_training(F.col("doc_id")))
    rows = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return tag_documents(rows, tagger).where("predicted = 0").select("_row.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
