"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import chat_repair, decontamination, language, lattice_lm, merge_codec, mixing, quality, simhash, tokens, toxicity, vector_codes, warc, wrapper
from leadloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op6_pivotal_mix")
def pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


@query("op4_host_quality", quality.ORACLE)
def host_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op7_winnowing", decontamination.ORACLE)
def winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op10_viterbi_counts")
def viterbi_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents").select("doc_id", "text"))


@query("op9_lattice_likelihood")
def lattice_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, folder, "documents"))


@query("op3_pigeonring")
def pigeonring(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_ppm_language")
def ppm_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op8_crf_toxicity")
def crf_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op1_wrapper_text")
def wrapper_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.extract(table(spark, folder, "pages"))


@query("op5_warc_derivatives")
def warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses_of(table(spark, folder, "pages"))).drop("block")


@query("op11_hilbert_codes")
def hilbert_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


@query("op13_stream_bpe")
def stream_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return merge_codec.digests(merge_codec.transcode(table(spark, folder, "documents")))


@query("op12_converging_repair")
def converging_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat_repair.report(table(spark, folder, "conversations"))
