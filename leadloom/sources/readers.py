"""Readers with explicit schemas; typing is an operator, never a side effect of reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import schemas as S

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """CSV with every column as text, so ids and phones keep their zeros and signs.

    ``multiline`` allows line breaks inside quoted fields; such a file is read by one task.
    """
    return (
        spark.read.schema(schema)
        .option("header", True).option("encoding", "UTF-8").option("multiLine", multiline)
        .option("escape", '"').option("nullValue", "").option("enforceSchema", False)
        .csv(path)
    )


def read_processed_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV with the header's columns as text; a byte-order mark on the first name is dropped.

    An empty field stays an empty string: turning it into unknown is a decision of the caller.
    ``multiline`` as in :func:`read_csv`.
    """
    df = (
        spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8")
        .option("multiLine", multiline).option("escape", '"').csv(path)
    )
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns]).na.fill("")


def read_chats(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Chats with nested messages: a JSON array, or one chat per line, which can be split."""
    return read_json(spark, path, S.CHATS, multiline=not lines)


def read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True
              ) -> DataFrame:
    """Strict JSON: no NaN or infinity, and anything off the schema fails the read."""
    return (
        spark.read.schema(schema).option("multiLine", multiline)
        .option("allowNonNumericNumbers", False).option("mode", "FAILFAST").json(path)
    )


def shape_violations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records that are no JSON object of the expected shape (one record per line)."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
               "allowNonNumericNumbers": "false"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", wide, options).alias("r"))
    return parsed.select(f"r.{CORRUPT}").where(F.col(CORRUPT).isNotNull())


def with_source_rows(df: DataFrame, order: list[str | Column], out: str = "source_row") -> DataFrame:
    """Number the rows once, in a stable order, to serve as provenance from then on."""
    from leadloom.operators.ranking import Key, numbered

    return numbered(df, [Key(c) for c in order], out=out)


def read_table(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """Selected columns of a catalogue table."""
    return spark.table(name).select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], key: str,
              lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """Selected columns of a database table, read in parallel ranges of a numeric key."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        .option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper)
        .option("numPartitions", partitions).load().select(*columns)
    )
