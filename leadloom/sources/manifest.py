"""Manifests: rows and content digests of outputs, and verification of stored files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.checks import fingerprint


def manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per output table: name, rows and order-insensitive digest."""
    parts = [
        fingerprint(df).select(
            F.lit(name).alias("tabla"), "filas",
            F.sha2(F.concat_ws("|", "huella_a", "huella_b"), 256).alias("huella"))
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _relative(folder: str):
    """Path below the folder, whatever the file system's prefix."""
    root = folder.rstrip("/").split("://", 1)[-1].split(":", 1)[-1]
    return F.expr(f"substring_index(path, {_quoted(root + '/')}, -1)")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of every file under a folder, named by its path below it.

    A file is read whole by one task, so this is for deliveries of files up to 2 GB; large tables
    are compared with :func:`manifest`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        _relative(folder).alias("nombre"), "path",
        F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Expected (nombre, sha256) rows that are missing or differ on disk."""
    found = file_hashes(spark, folder).select("nombre", F.col("sha256").alias("_found"))
    joined = expected.join(found, "nombre", "left")
    return joined.select(
        "nombre",
        F.when(F.col("_found").isNull(), "falta").when(
            F.col("_found") != F.col("sha256"), "huella_inconsistente").alias("estado"),
    ).where(F.col("estado").isNotNull())


def missing_inputs(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """Required files, by their path below the folder, that it does not hold."""
    names = spark.createDataFrame([(n,) for n in required], "nombre string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    present = listed.select(_relative(folder).alias("nombre"))
    return names.join(present, "nombre", "left_anti")


def verify_round_trip(written: dict[str, DataFrame], read_back: dict[str, DataFrame]) -> DataFrame:
    """Tables whose re-read content differs from what was written."""
    a, b = manifest(written), manifest(read_back)
    right = b.select("tabla", F.col("filas").alias("filas_leidas"), F.col("huella").alias("_h"))
    return a.join(right, "tabla", "left").where(
        ~F.col("huella").eqNullSafe(F.col("_h"))).drop("_h")
