"""Shared column expressions and the written intermediate tables of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import checkpoint_dir

#: The white space that parts words, as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder of the session and go on from the written copy.

    The copy cuts the lineage, survives lost executors, and its size is known to the optimiser.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/leadloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """A-Z only; every other letter keeps its case."""
    return F.translate(text, UPPER, LOWER)


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that reruns agree."""
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))

