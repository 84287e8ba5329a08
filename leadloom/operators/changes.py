"""Batches as keyed change logs: what every row was when the batch was planned, and what it becomes.

A log has ``unidad, tabla, clave, antes, despues, veces``; rows are JSON texts of all their columns, null
for an absent row. Rows of one unit (a lead, a review) are applied together or not at all. Applying
compares each row with what is stored now: unless it is still ``antes``, someone else was first, and
the unit is refused as ``obsoleta``; a unit whose rows all are ``despues`` already is ``repetida``.
A unit with a row that the batch writes more than once (``veces``) is refused as ``ambigua``,
rows without a unit as ``sin_unidad``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.operators.merge import upsert
from leadloom.session import checkpoint_dir

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class ChangeSet:
    """The log of a batch with the shape and the key of each of its tables."""

    log: DataFrame
    shapes: dict[str, StructType]
    keys: dict[str, list[str]]


@dataclass(frozen=True)
class Together:
    """Rows of several tables made from the same rows: a struct column for each table, null where it has none.

    Such rows stand side by side in the log, so what they share is stored about once and a task meets
    a unit's rows together.
    """

    frame: DataFrame
    tables: dict[str, Column]
    unit: Column


def _json(columns: Sequence[str]) -> Column:
    return _text(F.struct(*columns))


def _text(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})


#: The log as it is written: a key's text stands before that of its row, which repeats it and so takes little room beside it.
LOG = "unidad string, tabla string, largo int, textos binary, antes string, veces bigint"
#: Files of the shuffles of a job go when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _write(df: DataFrame, label: str) -> str:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/leadloom-{label}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` compressed to the shared folder and go on from the copy, whose size is known to the optimiser."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, label))


def _entries(rows: DataFrame, names: Sequence[str], keys: Mapping[str, Sequence[str]], whole: bool) -> DataFrame:
    """(tabla, clave) of the rows in the struct columns ``names``, with ``unidad`` and ``despues`` if ``whole``."""
    found = F.array(*[
        F.when(F.col(n).isNotNull(), F.struct(
            F.lit(n).alias("tabla"), _text(F.struct(*[F.col(n)[k].alias(k) for k in keys[n]])).alias("clave"),
            *([_text(F.col(n)).alias("despues")] if whole else [])))
        for n in names])
    return rows.select(*(["unidad"] if whole else []), F.inline(found)).where("tabla IS NOT NULL")


def _repeated(keyed: DataFrame) -> DataFrame:
    """(tabla, clave, veces) of the keys that come more than once: counted by a number first, and only those
    that share theirs by their text."""
    marked = keyed.withColumn("_h", F.xxhash64("tabla", "clave"))
    shared = written(marked.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"), "shared-numbers")
    return written(
        marked.join(shared, "_h", "left_semi").groupBy("tabla", "clave").agg(F.count(F.lit(1)).alias("veces"))
        .where("veces > 1"), "repeated-keys")


def plan_changes(plan: Tables, stored: Tables, keys: Mapping[str, Sequence[str]], unit: Mapping[str, Column],
                 helpers: Sequence[str] = (), together: Sequence[Together] = ()) -> ChangeSet:
    """The change log of the rows of ``plan`` and ``together`` against the tables as they are now.

    ``keys`` and ``unit`` give the key columns and the unit of each table of the plan; ``helpers`` are
    columns that only serve to tell the unit. Key columns and columns are compared as JSON, so null keys are keys like others. The log is written, and so
    stays what it was when the tables move on. Rows that change nothing are part of it. Repeated keys are
    counted on the keys alone, and only rows of tables that are there meet what is stored, table by table.
    """
    parts = []
    for t in together:
        rows = t.frame.select(t.unit.cast("string").alias("unidad"), *[c.alias(n) for n, c in t.tables.items()])
        here = [n for n in t.tables if n in stored]
        parts += [(rows, [n for n in t.tables if n not in stored]), *[(rows, [n]) for n in here]]
    parts += [
        (df.select(unit[n].cast("string").alias("unidad"), F.struct(*[c for c in df.columns if c not in helpers]).alias(n)), [n])
        for n, df in plan.items()]
    parts = [(rows, names) for rows, names in parts if names]
    shapes = {n: rows.schema[n].dataType for rows, names in parts for n in names}
    named = {n: list(keys[n]) for n in shapes}
    repeated = _repeated(reduce(DataFrame.unionByName, [_entries(rows, names, named, False) for rows, names in parts]))
    paths = []
    for rows, names in parts:
        entries = _entries(rows, names, named, True)
        if names[0] in stored:
            [n] = names
            before = stored[n].select(_json(named[n]).alias("clave"), _json(shapes[n].names).alias("antes"))
            entries = entries.join(before, "clave", "left")
        else:
            entries = entries.withColumn("antes", F.lit(None).cast("string"))
        paths.append(_write(entries.join(repeated, ["tabla", "clave"], "left").select(
            "unidad", "tabla", F.octet_length("clave").alias("largo"),
            F.concat("clave", "despues").cast("binary").alias("textos"), "antes",
            F.coalesce("veces", F.lit(1)).cast("bigint").alias("veces")), "change-log"))
    log = repeated.sparkSession.read.schema(LOG).parquet(*paths).select(
        "unidad", "tabla", F.substring("textos", F.lit(1), F.col("largo")).cast("string").alias("clave"), "antes",
        F.substring("textos", F.col("largo") + 1, F.length("textos")).cast("string").alias("despues"), "veces")
    return ChangeSet(log, shapes, named)


def _digest(text: Column | str) -> Column:
    """What stands for a text that is only compared: 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _unmet(changes: ChangeSet, stored: Tables, name: str) -> DataFrame:
    """(_u, libre): a row for each of the table's that is not what it becomes, by its unit, and whether it is still what it was."""
    log = changes.log.where(F.col("tabla") == name).select(
        _digest("clave").alias("_k"), _digest("antes").alias("_a"), _digest("despues").alias("_d"), _digest("unidad").alias("_u"))
    now = stored[name].select(
        _digest(_json(changes.keys[name])).alias("_k"), _digest(_json(changes.shapes[name].names)).alias("_f"))
    return log.join(now, "_k", "left").where(~F.col("_f").eqNullSafe(F.col("_d"))).select(
        "_u", F.col("_f").eqNullSafe(F.col("_a")).alias("libre"))


def _there(changes: ChangeSet, stored: Tables) -> list[str]:
    return [n for n in changes.shapes if n in stored]


def _decided(changes: ChangeSet, there: Sequence[str], unmet: Sequence[DataFrame]) -> DataFrame:
    """The decision on each unit, from its rows of tables that are not there and the unmet ones of the others."""
    there = F.col("tabla").isin(list(there))
    units = changes.log.groupBy("unidad").agg(
        F.max("veces").alias("_n"), F.count(F.lit(1)).alias("cambios"), F.bool_and(there).alias("_done"),
        F.bool_and(there | F.col("antes").isNull()).alias("_free")).withColumn("_u", _digest("unidad"))
    if unmet:
        rows = reduce(DataFrame.unionByName, unmet).groupBy("_u").agg(F.bool_and("libre").alias("libre"))
        units = units.join(rows, "_u", "left")
    else:
        units = units.withColumn("libre", F.lit(None).cast("boolean"))
    done = F.col("_done") & F.col("libre").isNull()
    free = F.col("_free") & F.coalesce("libre", F.lit(True))
    return units.select(
        "unidad", F.when(F.col("unidad").isNull(), "sin_unidad").when(F.col("_n") > 1, "ambigua").when(done, "repetida")
        .when(free, "aplicada").otherwise("obsoleta").alias("estado"), "cambios")


def judge(changes: ChangeSet, stored: Tables) -> DataFrame:
    """(unidad, estado, cambios): aplicada, repetida, obsoleta, ambigua or sin_unidad, and its number of rows."""
    there = _there(changes, stored)
    return _decided(changes, there, [_unmet(changes, stored, n) for n in there])


def _taken(decisions: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
    """What keeps the rows of the units that are applied, by the applied or the refused units, whichever are
    fewer; None if no unit is applied."""
    applied = F.col("estado") == "aplicada"
    n = decisions.agg(F.count(F.lit(1)).alias("all"), F.count_if(applied).alias("applied")).first()
    if not n["applied"]:
        return None
    few = 2 * n["applied"] <= n["all"]
    units = written(decisions.where(applied if few else ~applied).select(_digest("unidad").alias("_u")), "units")
    return lambda rows: rows.where(F.col("_u").isNotNull()).join(units, "_u", "left_semi" if few else "left_anti").drop("_u")


def apply_changes(changes: ChangeSet, stored: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables afterwards, the decision on each unit).

    Each table meets the log in a job of its own. Tables without a change are returned as they are; one
    that was not there consists of the log's rows.
    """
    there = _there(changes, stored)
    unmet = [written(_unmet(changes, stored, n), "unmet-rows") for n in there]
    decisions = written(_decided(changes, there, unmet), "decisions")
    taken = _taken(decisions)
    after = dict(stored)
    for name, shape in changes.shapes.items():
        # parsed before the units are chosen, so that a shuffle for that carries the columns in use only
        rows = changes.log.where(F.col("tabla") == name).select(
            _digest("unidad").alias("_u"), F.from_json("despues", shape).alias("_r")).select("_u", "_r.*")
        if taken is None:
            if name not in stored:
                after[name] = rows.drop("_u").where("false")
            continue
        rows = taken(rows)
        if name in stored:
            # a null key is a key here, so rows are replaced by the digest of the key's text
            key = _digest(_json(changes.keys[name]))
            old = stored[name].withColumn("_key", key)
            rows = rows.withColumn("_key", key)
            kept = [c for c in stored[name].columns if c not in shape.names]
            if kept:  # columns that the log does not know stay as they are
                rows = rows.join(old.select("_key", *kept), "_key", "left")
            rows = upsert(old, rows, ["_key"]).drop("_key")
        after[name] = rows
    return after, decisions
