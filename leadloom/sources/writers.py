"""Writers that keep originals, precision and portable nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.dates import date_text

_COMPLEX = (T.ArrayType, T.MapType, T.StructType)
_TIMES = (T.TimestampType, T.TimestampNTZType)
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss",
                "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def portable(df: DataFrame) -> DataFrame:
    """Not-a-number and infinity become null, instants become ISO text with a blank."""
    out = []
    for f in df.schema.fields:
        c: Column = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            odd = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(~odd, c)
        elif isinstance(f.dataType, _TIMES):
            c = date_text(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def export_table(df: DataFrame, source_columns: Sequence[str]) -> DataFrame:
    """Normalised values under the source names, originals beside them as ``<c>_original``."""
    have = set(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    out: list[Column] = []
    for c in source_columns:
        norm = f"{c}_normalizado"
        if norm not in have:
            out.append(F.col(c))
            continue
        out.append(F.col(c).alias(f"{c}_original"))
        if isinstance(types[norm], _TIMES):
            precision = f"{c}_precision"
            out.append(date_text(F.col(norm), precision if precision in have else None).alias(c))
        else:
            out.append(F.col(norm).alias(c))
    extra = [c for c in df.columns if c not in source_columns and not c.endswith("_normalizado")]
    return df.select(*out, *extra)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, instants as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, _COMPLEX):
            c = F.to_json(c, JSON_OPTIONS)
        elif isinstance(f.dataType, _TIMES):
            c = date_text(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    (
        csv_ready(df).write.mode("overwrite").option("header", True).option("nullValue", "")
        .option("emptyValue", "").option("escape", '"').option("lineSep", "\n").csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    portable(df).write.mode("overwrite").options(**JSON_OPTIONS).json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet by company, so a tenant scope prunes whole folders."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    """Batched inserts, 500 rows per round trip by default."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).option(
        "batchsize", batch).mode("append").save()
