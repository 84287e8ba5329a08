"""Contracts as frames of violations: an empty frame is a passed check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.text import col
from leadloom.operators.ranking import null_safe_key


class ContractBroken(ValueError):
    """A contract check found offending rows."""


def expect(df: DataFrame, rule: str, bad: Column, key: Column | str, detail: Column | None = None
           ) -> DataFrame:
    """Rows for which ``bad`` holds, as ``(regla, clave, detalle)``."""
    return df.where(bad).select(
        F.lit(rule).alias("regla"),
        col(key).cast("string").alias("clave"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detalle"),
    )


def fail_if_any(violations: DataFrame) -> None:
    """Stop the run on the first violation."""
    first = violations.take(1)
    if first:
        raise ContractBroken(f"{first[0]['regla']}: {first[0]['clave']} {first[0]['detalle'] or ''}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (or are missing), with their row count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("filas"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return counts.where((F.col("filas") > 1) | missing)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
           indicator: str | None = None, checked: bool = True) -> DataFrame:
    """Many-to-one join. ``checked`` collapses repeated right keys into a raised error row.

    Uniqueness is verified inside the plan: the right side is grouped by key and a key with more
    than one row raises, so no separate job is needed.
    """
    marker = indicator or "_found"
    if checked:
        rest = [c for c in right.columns if c not in keys]
        one = right.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.first(F.struct(F.lit(True).alias(marker), *rest)).alias("_r"),
        )
        safe = F.when(F.col("_n") == 1, F.col("_r")).otherwise(
            F.raise_error(F.lit("many-to-one join: repeated key on the right")).cast(
                one.schema["_r"].dataType)
        )
        right = one.select(*keys, safe.alias("_r")).select(*keys, "_r.*")
    else:
        right = right.withColumn(marker, F.lit(True))
    joined = left.join(right, list(keys), how)
    if indicator is None:
        return joined.drop(marker)
    return joined.withColumn(indicator, F.coalesce(F.col(indicator), F.lit(False)))


def left_join_sparse(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     spread: Sequence[str] | None = None) -> DataFrame:
    """Left join on keys that are often null.

    Rows without a key match nothing, yet would all meet in one task; a salt derived from the row,
    or from its columns ``spread``, spreads them. Rows with a key keep salt 0 and meet their match
    as usual. With ``spread``, columns that nobody asks for need not be worked out for the salt.
    """
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    plain = spread or [f.name for f in left.schema.fields if not isinstance(f.dataType, T.MapType)]
    salt = F.when(missing, F.pmod(F.xxhash64(*plain), F.lit(4096)) + 1).otherwise(0)
    salted = right.withColumn("_salt", F.lit(0).cast("bigint"))
    return left.withColumn("_salt", salt.cast("bigint")).join(
        salted, [*keys, "_salt"], "left").drop("_salt")


def missing_parents(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose non-null composite reference has no parent."""
    complete = F.lit(True)
    for c in on:
        complete = complete & F.col(c).isNotNull()
    refs = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    return child.where(complete).join(refs, list(on), "left_anti")


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only; empty means both sides carry the same key set."""
    tagged = a.select(*keys).distinct().withColumn("lado", F.lit("a")).unionByName(
        b.select(*keys).distinct().withColumn("lado", F.lit("b"))
    )
    sides = tagged.groupBy(*keys).agg(
        F.bool_or(F.col("lado") == "a").alias("en_a"), F.bool_or(F.col("lado") == "b").alias("en_b")
    )
    return sides.where(~(F.col("en_a") & F.col("en_b")))


def partition_violations(whole: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that are in no part or in several; empty means disjoint and covering."""
    tagged = whole.select(key).distinct().withColumns({"_w": F.lit(1), "_p": F.lit(0)})
    for part in parts:
        tagged = tagged.unionByName(
            part.select(key).distinct().withColumns({"_w": F.lit(0), "_p": F.lit(1)})
        )
    counted = tagged.groupBy(key).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("partes"))
    return counted.where((F.col("_w") != 1) | (F.col("partes") != 1)).select(
        key, F.col("partes").cast("bigint").alias("partes")
    )


def disappeared(stored: DataFrame, snapshot: DataFrame, keys: Sequence[str],
                origin: str | None = None) -> DataFrame:
    """Stored batch-origin keys that a new snapshot silently leaves out."""
    if origin is not None:
        stored = stored.where(F.col(origin) == "lote")
    return stored.select(*keys).join(snapshot.select(*keys), list(keys), "left_anti")


def changed_rows(stored: DataFrame, incoming: DataFrame, keys: Sequence[str],
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Keys whose incoming row differs from the stored one, with the differing columns."""
    columns = [c for c in (columns or incoming.columns) if c not in keys]
    a = stored.select(*keys, F.struct(*columns).alias("_a"))
    b = incoming.select(*keys, F.struct(*columns).alias("_b"))
    differs = F.array_compact(F.array(*[
        F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns
    ]))
    return (
        b.join(a, list(keys))
        .withColumn("columnas", differs)
        .where(F.size("columnas") > 0)
        .select(*keys, "columnas")
    )


def reconcile(expected: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every expected row against the stored one; reports absent rows and differing columns."""
    columns = [c for c in expected.columns if c not in keys]
    e = expected.select(*keys, F.struct(*columns).alias("_e"))
    s = stored.select(*keys, F.struct(*columns).alias("_s"), F.lit(True).alias("_in"))
    differs = F.array_compact(F.array(*[
        F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_s.{c}")), F.lit(c)) for c in columns
    ]))
    joined = e.join(s, list(keys), "left")
    absent = F.col("_in").isNull()
    return joined.select(
        *keys,
        F.when(absent, "ausente").when(F.size(differs) > 0, "distinta").alias("estado"),
        F.when(~absent, F.array_join(differs, ",")).alias("columnas"),
    ).where(F.col("estado").isNotNull())


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-insensitive digest of the table content."""
    columns = sorted(columns or df.columns)
    text = F.sha2(null_safe_key(columns), 256)
    # two independent 60-bit slices of the row digest, summed exactly
    part = [F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in (0, 1)]
    return df.agg(
        F.count(F.lit(1)).alias("filas"),
        F.coalesce(F.sum(part[0]), F.lit(0)).cast("string").alias("huella_a"),
        F.coalesce(F.sum(part[1]), F.lit(0)).cast("string").alias("huella_b"),
    )


def owner_mismatch(child: DataFrame, parent: DataFrame, on: Sequence[str], owners: Sequence[str]
                   ) -> DataFrame:
    """Child rows whose linked parent is missing or belongs to someone else."""
    p = parent.select(*on, F.struct(*owners).alias("_o"), F.lit(True).alias("_in"))
    same = F.lit(True)
    for o in owners:
        same = same & F.col(o).eqNullSafe(F.col(f"_o.{o}"))
    return child.join(p, list(on), "left").where(F.col("_in").isNull() | ~same).drop("_o", "_in")
