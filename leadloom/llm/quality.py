"""Host-level quality rules with shrunk failure rates, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SPACE, written

MIN_WORDS = 50
#: Words inside windows that occur again, in percent of all words.
MAX_REPEAT_PERCENT = 50
#: Symbols in percent of words, and repeated lines in percent of lines, that count against a host.
MAX_SYMBOL_PERCENT = 100
MAX_DUP_LINE_PERCENT = 50
#: A host is rejected when the shrunk failure rate of one rule is above this.
MAX_HOST_RATE = 0.8
RULES = ("short", "repetitive", "symbols", "dup_lines")
SPAN = 3


def _repeated_words(pairs: Column) -> Column:
    """Words covered by windows whose hash occurs again; ``pairs``: sorted (hash, position)."""
    again = F.filter(
        pairs,
        lambda e, k: F.get(pairs, k - 1)["x"].eqNullSafe(e["x"]) | F.get(pairs, k + 1)["x"].eqNullSafe(e["x"]),
    )
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        starts,
        start,
        lambda acc, p: F.struct(
            (acc["n"] + p + SPAN - F.greatest(p, acc["end"])).alias("n"), (p + SPAN).alias("end")
        ),
        lambda acc: acc["n"],
    )


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed.

    Row by row, over whole texts; a null text counts as an empty one. Windows are compared by
    their 64-bit hash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        "*",
        F.array_remove(F.split(body, f"[{SPACE}]+"), "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )
    words = F.col("_words")
    step = step.select(
        "*",
        F.slice(
            F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
            F.lit(1),
            F.greatest(F.size(words) - (SPAN - 1), F.lit(0)),
        ).alias("_hashes"),
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    ).drop("_words", "_lines")
    step = step.withColumn(
        "_pairs",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    ).drop("_hashes")
    step = step.withColumn(
        "n_repeat_words", F.coalesce(_repeated_words(F.col("_pairs")), F.lit(0)).cast("bigint")
    ).drop("_pairs")
    rules = _failures()
    return step.withColumn("base_failed", rules["short"] | rules["repetitive"])


def _failures() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per non-null host: documents, shrunk failure rate of each rule, host_ok.

    The prior of a rule is a beta law fitted by moments to the hosts: mean the pooled rate, spread
    the variance of the host rates weighted by documents. The rate of a host is the mean of its
    posterior, so small hosts lean on the others. Partial sums are taken before the shuffle, so a
    host with most documents costs no more than another; only hosts reach the second step, and
    one row of sums is attached to them.
    """
    hosts = measured.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.count_if(fails).alias(f"f_{rule}") for rule, fails in _failures().items()],
    )
    hosts = written(hosts, "hosts")
    moments = []
    for rule in RULES:
        rate = F.col(f"f_{rule}") / F.col("n_docs")
        moments += [
            (F.sum(f"f_{rule}") / F.sum("n_docs")).alias(f"m_{rule}"),
            (F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs")).alias(f"q_{rule}"),
        ]
    # one row of scalars
    prior = hosts.agg(*moments).first()
    shrunk = []
    for rule in RULES:
        mean, square = prior[f"m_{rule}"] or 0.0, prior[f"q_{rule}"] or 0.0
        spread = max(square - mean * mean, 1e-9)
        strength = max(mean * (1 - mean) / spread - 1, 1.0)
        shrunk.append(
            ((F.col(f"f_{rule}") + mean * strength) / (F.col("n_docs") + strength)).alias(f"rate_{rule}")
        )
    rated = hosts.select(F.col(host), "n_docs", *shrunk)
    return rated.withColumn("host_ok", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) <= max_rate)


def judge(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Add ``host_ok`` and ``kept`` to measured rows; rows without a host go by the base alone."""
    right = verdicts.select(F.col(host).alias("_host"), "host_ok")
    joined = measured.join(right, F.col(host) == F.col("_host"), "left").drop("_host")
    ok = F.coalesce(F.col("host_ok"), F.lit(True))
    return joined.withColumn("host_ok", ok).withColumn("kept", ~F.col("base_failed") & ok)


def quality_report(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document: doc_id, source, measures, base_failed, host_ok, kept.

    Null or empty text: no words, so base_failed. Null source: judged by the base rules alone.
    Repeated rows are judged and counted one by one. An empty table gives an empty result. Columns
    other than doc_id, text and source are not read.
    """
    narrow = docs.select("doc_id", "source", "text")
    measured = written(with_measures(narrow).drop("text"), "measures")
    return judge(measured, host_verdicts(measured))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Texts do not move: the measures are taken once for the hosts and again for the filter.
    """
    columns = docs.columns
    verdicts = host_verdicts(with_measures(docs.select("source", "text")).drop("text"))
    whole = docs.select(
        F.col("source").alias("_source"), F.col("text").alias("_text"), F.struct(*columns).alias("_row")
    )
    # A one-element array keeps the filter above the measures; else Spark would move the filter into
    # the scan with all their expressions written out in it.
    failed = F.explode(F.array("base_failed")).alias("base_failed")
    measured = with_measures(whole, "_text").select("_source", "_row", failed)
    judged = judge(measured, verdicts.withColumnRenamed("source", "_source"), "_source")
    return judged.where("kept").select("_row.*")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
win AS (SELECT rid, i AS pos, list_slice(words, i, i + 2) AS win
        FROM w, unnest(range(1, len(words) - 1)) AS t(i)),
again AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT pos + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < {MIN_WORDS})::INT AS short, (100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)::INT AS repetitive,
        (100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words)::INT AS symbols, (100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines)::INT AS dup_lines FROM m),
long AS (SELECT source, rule, count(*) AS n, sum(bad)::DOUBLE AS f FROM (
        SELECT source, unnest(['short', 'repetitive', 'symbols', 'dup_lines']) AS rule, unnest([short, repetitive, symbols, dup_lines]) AS bad FROM f
        WHERE source IS NOT NULL) GROUP BY ALL),
prior AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) / sum(n) AS square FROM long GROUP BY rule),
strength AS (SELECT rule, mean, greatest(mean * (1 - mean) / greatest(square - mean * mean, 1e-9) - 1, 1.0) AS s FROM prior),
host AS (SELECT source, max((f + mean * s) / (n + s)) <= {MAX_HOST_RATE} AS ok FROM long JOIN strength USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short + repetitive > 0) AS base_failed,
       (short + repetitive = 0) AND coalesce(ok, true) AS kept
FROM f LEFT JOIN host USING (source)
"""
