"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import remainder

#: Longest context in bytes.
ORDER = 3
#: Bytes of training text read per language, about.
TRAINING_BYTES = 8_000_000
#: Bytes of training text read for all languages together; with more than eight each gets an equal part.
TOTAL_BYTES = 64_000_000
#: Steps in which a language's sample is filled.
STEPS = 256
UNDETERMINED = "und"


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Every run of ``size`` bytes as one number, the first byte highest."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(size):
        out = (out << 8) | data[k : k + max(n, 0)]
    return out


@dataclass
class Model:
    """Frozen code lengths, in bits, of all languages.

    ``grams[k]`` are the sorted runs of k + 1 bytes seen in any language, ``cost[k]`` their code
    length in every language. ``contexts[k]`` are the runs of k bytes seen as a context, ``escape[k]``
    what it costs to leave them, zero where a language has not seen them.
    """

    languages: list[str]
    grams: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """From each language's distinct runs of ORDER + 1 bytes with counts.

        The context tree of a language holds the counts of every context of 0 to ORDER bytes. A
        context with n symbols seen, d of them distinct, gives a symbol seen c times the share
        c / (n + d) and the escape d / (n + d); after an escape the next shorter context speaks,
        and below the empty one all 256 bytes are alike. Counts of shorter contexts are sums of
        those of the longest.
        """
        languages = sorted(counts)
        grams, cost, contexts, escape = [], [], [], []
        for k in range(ORDER + 1):
            each, size = [], len(languages)
            for lang in languages:
                runs, n = counts[lang]
                keys, at = np.unique(runs & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
                each.append((keys, np.bincount(at, n, minlength=len(keys))))
            seen = np.unique(np.concatenate([keys for keys, _ in each])) if each else np.zeros(0, np.int64)
            before = np.unique(seen >> 8)
            bits, leave = np.zeros((len(seen), size)), np.zeros((len(before), size))
            shorter = cost[k - 1][np.searchsorted(grams[k - 1], seen & ((1 << (8 * k)) - 1))] if k else np.full((len(seen), size), 8.0)
            for j, (keys, n) in enumerate(each):
                own, at = np.unique(keys >> 8, return_inverse=True)
                total, kinds = np.bincount(at, n, minlength=len(own)), np.bincount(at, minlength=len(own))
                leave[np.searchsorted(before, own), j] = np.log2((total + kinds) / kinds)
                bits[:, j] = leave[np.searchsorted(before, seen >> 8), j] + shorter[:, j]
                bits[np.searchsorted(seen, keys), j] = np.log2((total + kinds)[at] / n)
            grams.append(seen)
            cost.append(bits)
            contexts.append(before)
            escape.append(leave)
        return cls(languages, grams, cost, contexts, escape)


class Scorer:
    """Looks up code lengths: the runs seen are found in two steps through dense tables."""

    def __init__(self, model: Model):
        self.model = model
        top = model.grams[ORDER]
        heads = np.unique(top >> 8)
        self.place = np.zeros(1 << (8 * ORDER), dtype=np.int32)
        self.place[heads] = np.arange(1, len(heads) + 1)
        self.heads = heads
        self.row = np.zeros((len(heads) + 1) * 256, dtype=np.int32)
        self.row[self.place[top >> 8].astype(np.int64) * 256 + (top & 255)] = np.arange(1, len(top) + 1)
        self.cost = np.concatenate([np.zeros((1, len(model.languages))), model.cost[ORDER]]).astype(np.float32)

    def _unseen(self, runs: np.ndarray, k: int) -> np.ndarray:
        """Code length of runs of k + 1 bytes, found at this order or below."""
        size = len(self.model.languages)
        if k < 0:
            return np.full((len(runs), size), 8.0)
        keys, contexts = self.model.grams[k], self.model.contexts[k]
        at = np.minimum(np.searchsorted(keys, runs), max(len(keys) - 1, 0))
        known = keys[at] == runs if len(keys) else np.zeros(len(runs), dtype=bool)
        out = np.zeros((len(runs), size))
        out[known] = self.model.cost[k][at[known]]
        rest = runs[~known]
        if len(rest):
            bits = self._unseen(rest & ((1 << (8 * k)) - 1), k - 1)
            if len(contexts):
                before = np.minimum(np.searchsorted(contexts, rest >> 8), len(contexts) - 1)
                bits = bits + np.where((contexts[before] == rest >> 8)[:, None], self.model.escape[k][before], 0.0)
            out[~known] = bits
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits per text and language; each text stands after ORDER line feeds."""
        lead = b"\n" * ORDER
        data = np.frombuffer(b"".join(lead + t for t in texts), dtype=np.uint8).astype(np.int32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.model.languages)))
        if not sizes.sum():
            return total
        head = (data[:-3] << 16) | (data[1:-2] << 8) | data[2:-1]
        row = self.row[self.place[head] * 256 + data[ORDER:]]
        first = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
        filled = np.flatnonzero(sizes)
        # runs that reach over the end of a text are left out of its sums
        bounds = np.column_stack([first[filled], first[filled] + sizes[filled]]).ravel()
        bounds = bounds[bounds < len(row)]
        for j in range(total.shape[1]):
            total[filled, j] = np.add.reduceat(self.cost[:, j][row], bounds, dtype=np.float64)[::2]
        missed = np.flatnonzero(row == 0)
        if len(missed):
            owner = np.searchsorted(first, missed, side="right") - 1
            inside = missed - first[owner] < sizes[owner]
            missed, owner = missed[inside], owner[inside]
            runs = (head[missed].astype(np.int64) << 8) | data[missed + ORDER]
            distinct, at = np.unique(runs, return_inverse=True)
            bits = self._unseen(distinct, ORDER)
            for j in range(total.shape[1]):
                total[:, j] += np.bincount(owner, bits[at, j], minlength=len(texts))
        return total


def _text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def learn(docs: DataFrame, trains: Column, label: str = "lang", training_bytes: int = TRAINING_BYTES) -> Model:
    """Context trees from the training rows.

    Every language is learned. One with more text than its part of the bytes is read in hash order
    of its documents until the part is full, at least one document and none beyond the part, so
    that the sample has a fixed size however large the table is. Runs are counted in the tasks and
    summed by language and run; the sums of the sample reach the driver.
    """
    rows = docs.where(trains & F.col(label).isNotNull() & (F.octet_length("text") > 0))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.select(F.col(label).alias("lang"), "text", draw.alias("_draw"), F.octet_length("text").cast("bigint").alias("_n"))
    known = rows.groupBy("lang").agg(F.sum("_n").alias("n"), F.min("_draw").alias("first")).collect()
    if not known:
        return Model.fit({})
    part = max(1, min(training_bytes, TOTAL_BYTES // len(known)))
    # twice the expected share, so that the part is filled
    reach = [(r["lang"], max(r["first"], min(1.0, 2 * part / r["n"])), r["n"] <= part) for r in known]
    spark, kind = docs.sparkSession, docs.schema[label].dataType.simpleString()
    reach = spark.createDataFrame(reach, f"lang {kind}, _reach double, _all boolean")
    step = F.when(F.col("_all") | (F.col("_reach") <= 0), 0).otherwise(F.floor(F.col("_draw") / F.col("_reach") * STEPS))
    near = rows.join(F.broadcast(reach), "lang").where("_draw <= _reach").withColumn("_step", step.cast("bigint"))
    last: dict = {}
    full: dict = {}
    for r in near.groupBy("lang", "_step").agg(F.sum(F.least("_n", F.lit(part))).alias("n")).orderBy("lang", "_step").collect():
        if full.get(r["lang"], 0) < part:
            last[r["lang"]] = r["_step"]
            full[r["lang"]] = full.get(r["lang"], 0) + r["n"]
    ends = spark.createDataFrame(list(last.items()), f"lang {kind}, _last bigint")
    sample = near.join(F.broadcast(ends), "lang").where("_step <= _last").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = b"\n" * ORDER
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(lead + _text_bytes(text)[:part], dtype=np.uint8)
                texts.setdefault(lang, []).append(_grams(data, ORDER + 1))
            for lang, runs in texts.items():
                keys, n = np.unique(np.concatenate(runs), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], names=["lang", "run", "n"]
                )

    counted = sample.mapInArrow(count, "lang string, run bigint, n bigint")
    table = counted.groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    codes = table["lang"].combine_chunks().dictionary_encode()
    lang, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
    order = np.argsort(lang, kind="stable")
    run, n = table["run"].to_numpy()[order], table["n"].to_numpy()[order].astype(float)
    ends = np.searchsorted(lang[order], np.arange(len(names) + 1))
    return Model.fit({name: (run[a:b], n[a:b]) for name, a, b in zip(names, ends, ends[1:], strict=False)})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score to ``docs``, from the text alone.

    ``lang_pred`` is the language with the shortest code for the whole text, by name on ties;
    ``score`` its share when every language has the chance 2 to the minus code length. Texts that
    are null or have no letter, and all texts when nothing was learned, are undetermined with
    score 0. One pass, no shuffle; columns named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.grams, model.cost, model.contexts, model.escape)
    )
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*kept, F.when(has_letter, F.col("text")).alias("_body"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        scorer = Scorer(own) if own.languages else None
        for batch in batches:
            texts = [_text_bytes(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            names: list[str] = [UNDETERMINED] * len(texts)
            scores = np.zeros(len(texts))
            for at in _pieces(texts) if scorer else []:
                bits = scorer.code_lengths([texts[i] for i in at])
                best = bits.argmin(axis=1)
                chance = 1.0 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
                for i, b, c in zip(at, best, chance, strict=True):
                    if texts[i]:
                        names[i], scores[i] = own.languages[b], c
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_body"]
    return rows.mapInArrow(judge, ", ".join([*kinds, "lang_pred string", "score double"]))


def _pieces(texts: list[bytes], size: int = 1 << 22) -> Iterator[list[int]]:
    """Indexes of the texts in runs of about ``size`` bytes."""
    now, held = [], 0
    for i, text in enumerate(texts):
        now.append(i)
        held += len(text)
        if held >= size:
            yield now
            now, held = [], 0
    if now:
        yield now


def identify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from the rows that are not held out.

    Held out is every row whose crc32 of the id mod 4 is 2. Language, source and id play no part
    in a prediction. An empty table gives an empty result.
    """
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = learn(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
