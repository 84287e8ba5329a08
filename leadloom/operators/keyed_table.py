"""Stored tables that a batch changes only where its keys lie.

Rows lie in buckets of their key, ``filas/version=<batch>/cubo=<bucket>``. A batch reads the buckets
of its own keys, writes their new content under its own name, and last of all a record that names
that version as the current one of those buckets. Files are never changed in place: until the record
is there readers see the former rows, a batch that failed is run again over what it left, and a
batch that has its record changes nothing. One batch at a time may write a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import cut_lineage

FIRST = "inicio"
#: The bucket of the row that stands for the batch itself, so that one without rows is known too.
WHOLE = -1

Change = Callable[[DataFrame, DataFrame], DataFrame]


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/registro")


def _write(df: DataFrame, path: str, batch: str) -> None:
    # buckets beyond the advisory size are split into several files
    df.hint("rebalance", "cubo").write.mode("overwrite").partitionBy("cubo").parquet(f"{path}/filas/version={batch}")


def _write_record(spark: SparkSession, path: str, batch: str, order: int, touched: Sequence[int], buckets: int) -> None:
    # the name is a column too: a folder name like 007 would be read as a number
    rows = [(batch, int(c), order, buckets) for c in [WHOLE, *touched]]
    frame = spark.createDataFrame(rows, "version string, cubo int, orden int, cubos int")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/registro/lote={batch}")


def _touched(rows: DataFrame) -> list[int]:
    """The buckets that have rows, at most the fixed number of buckets."""
    return sorted(r["cubo"] for r in rows.select("cubo").distinct().collect())


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Store ``df`` in ``buckets`` buckets of its keys. An empty table is allowed."""
    spark = df.sparkSession
    rows = cut_lineage(df.withColumn("cubo", _bucket(keys, buckets)))
    df.limit(0).write.mode("overwrite").parquet(f"{path}/forma")
    _write(rows, path, FIRST)
    _write_record(spark, path, FIRST, 0, _touched(rows), buckets)


def read(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """The current rows, all or those of some buckets; other versions and buckets are not listed for reading."""
    current = _record(spark, path).where(F.col("cubo") != WHOLE).groupBy("cubo").agg(
        F.max_by("version", "orden").alias("version"))
    versions: dict[str, list[int]] = {}
    for r in current.collect():  # one row per bucket
        if only is None or r["cubo"] in only:
            versions.setdefault(r["version"], []).append(r["cubo"])
    shape = spark.read.parquet(f"{path}/forma").schema
    if not versions:
        return spark.createDataFrame([], shape)
    folders = [f"{path}/filas/version={batch}/cubo={c}" for batch, cubes in versions.items() for c in sorted(cubes)]
    return spark.read.schema(shape).parquet(*folders)


def merge(path: str, incoming: DataFrame, batch: str, keys: Sequence[str], change: Change) -> bool:
    """Apply a batch; False if it was applied before.

    ``change(stored, incoming)`` gives the rows of the touched buckets afterwards and may neither
    move a row to another key nor look at other keys. Rows of untouched buckets are neither read
    nor written. ``batch`` is a plain name other than ``inicio``.
    """
    if not batch.replace("-", "").replace("_", "").isalnum() or batch == FIRST:
        raise ValueError(f"not a batch name: {batch}")
    spark = incoming.sparkSession
    record = _record(spark, path)
    facts = record.agg(
        F.max("orden").alias("orden"), F.max("cubos").alias("cubos"),
        F.coalesce(F.bool_or(F.col("version") == batch), F.lit(False)).alias("done")).first()
    if facts["done"]:
        return False
    rows = cut_lineage(incoming.withColumn("cubo", _bucket(keys, facts["cubos"])))
    touched = _touched(rows)
    if touched:
        after = change(read(spark, path, touched), rows.drop("cubo"))
        # columns in the stored order; written from a copy, so that a retry never reads what it writes
        _write(cut_lineage(after.withColumn("cubo", _bucket(keys, facts["cubos"]))), path, batch)
    _write_record(spark, path, batch, facts["orden"] + 1, touched, facts["cubos"])
    return True
