"""Mixing sources to target weights by pivotal dependent rounding, on DataFrames only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import WORD, uniform, written

#: Units folded together in one node of the reduction tree, on average.
FAN_IN = 128
SEED = 20_240_607


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sized: DataFrame, weights: tuple[float, ...], share: float, most: float
) -> DataFrame:
    """One row per source: size, and the target in words.

    Sources in code point order (null last) carry ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times the size and the rest is shared again by weight until
    none is above. Solved for the level ``words per weight``, of which only scalars reach the
    driver; positions come from a range partitioning, so that no task sees all sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = written(
        sums.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
        ),
        "sources",
    )
    # at most one count per shuffle partition
    before, seen = {}, 0
    for part, n in sorted(ordered.groupBy("_part").count().collect()):
        before[part], seen = seen, seen + n
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    if starts is None:
        return ordered.select("source", "source_size", F.lit(0.0).alias("target"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    position = starts[F.col("_part")] + F.col("_row")
    ranked = ordered.select(
        "source",
        "source_size",
        F.get(cycle, (position % len(weights)).cast("int")).alias("_w"),
        (F.col("source_size") * most).alias("_cap"),
    )
    words, weight = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    goal, held = share * (words or 0), -1
    level = goal / weight
    while True:
        capped = F.col("_cap") <= level * F.col("_w")
        n, caps, rest = ranked.agg(
            F.count_if(capped),
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0.0)),
        ).first()
        if n == held or rest == 0:
            break
        held, level = n, (goal - caps) / rest
    return ranked.select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"),
    )


def _pair(cur: Column, new: Column) -> Column:
    """One pivotal step: move word mass between two fractional units until one is integral.

    The moved mass keeps ``size * p`` of the pair, and the direction is drawn so that both keep
    their expected value. Returns (settled, open).
    """
    a, p, b, q = cur.size, cur.p, new.size, new.p
    room_up, room_down = a * (F.lit(1.0) - p), b * q  # mass that can go from new to cur
    up = F.least(room_up, room_down)
    lose_down, lose_up = a * p, b * (F.lit(1.0) - q)  # mass that can go from cur to new
    down = F.least(lose_down, lose_up)
    goes_up = uniform(cur.h, new.h, F.lit(SEED)) * (up + down) < down

    def at(u: Column, value: Column) -> Column:
        return F.struct(u.size.alias("size"), u.h.alias("h"), u.doc_id.alias("doc_id"),
                        u.rows.alias("rows"), u.base.alias("base"), value.alias("p"))

    one, zero = F.lit(1.0), F.lit(0.0)
    bounded = lambda c: F.least(F.greatest(c, zero), one)
    cur_full, new_empty = at(cur, one), at(new, zero)
    cur_empty, new_full = at(cur, zero), at(new, one)
    return F.when(
        goes_up,
        F.when(room_up <= room_down, F.struct(cur_full.alias("done"), at(new, bounded(q - up / b)).alias("open")))
        .otherwise(F.struct(new_empty.alias("done"), at(cur, bounded(p + up / a)).alias("open"))),
    ).otherwise(
        F.when(lose_down <= lose_up, F.struct(cur_empty.alias("done"), at(new, bounded(q + down / b)).alias("open")))
        .otherwise(F.struct(new_full.alias("done"), at(cur, bounded(p - down / a)).alias("open")))
    )


def _fold(units: Column, kind: str) -> Column:
    """Chain the pivotal step through a bounded, ordered array; (settled units, open unit)."""
    start = F.struct(
        F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open")
    )

    def step(acc: Column, new: Column) -> Column:
        whole = (acc.open.p == 0.0) | (acc.open.p == 1.0)
        paired = _pair(acc.open, new)
        return F.when(acc.open.isNull(), F.struct(acc.done.alias("done"), new.alias("open"))).when(
            whole, F.struct(F.concat(acc.done, F.array(acc.open)).alias("done"), new.alias("open"))
        ).otherwise(
            F.struct(F.concat(acc.done, F.array(paired.done)).alias("done"), paired.open.alias("open"))
        )

    return F.aggregate(units, start, step)


def _dealt(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Whole copies per document so that each source's words come near its target.

    One row per input row, with ``_k`` to tell rows alike apart. Every document of a source expects target / source_size copies; the whole part is given, the
    fractional parts are rounded by the pivotal method with the word mass of a source held fixed.
    Units are dealt by a hash of their id to nodes of about ``fan_in`` units, each node leaves one
    open unit, and the open units of ``fan_in`` nodes meet in the next level; large documents come
    first in a node, so that the unit left open is mostly a small one. So a source that
    holds most rows is spread like any other, and a source misses its target by at most one of
    its documents.

    Null or empty texts have size 0 and no copies. Rows alike in id, source and size form one unit
    with that many rows; their copies are dealt evenly to the rows. A null id is a value like any
    other, a null source a source of its own, ordered last. An empty table gives an empty result.
    Columns other than doc_id, text and source are not read.
    """
    sized = written(
        docs.select("doc_id", F.col("source"), word_count(F.col("text")).alias("size")), "sizes"
    )
    targets = written(source_targets(sized, weights, share, most), "targets").withColumnRenamed("source", "_s")
    units = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = units.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("rows")).otherwise(0.0)
    units = units.withColumn("_e", F.when(F.col("size") > 0, copies).otherwise(0.0)).select(
        "*",
        F.floor("_e").alias("base"),
        (F.col("_e") - F.floor("_e")).alias("p"),
        F.xxhash64("doc_id", "size", "source", F.lit(SEED)).alias("h"),
    )
    units = written(units.drop("_e"), "units")
    open_ = units.where((F.col("p") > 0) & (F.col("p") < 1))
    counts = open_.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("source", "_s")
    facts = ["source", "source_size", "target"]
    fields = ["size", "h", "doc_id", "rows", "base", "p"]
    result = [units.where(~((F.col("p") > 0) & (F.col("p") < 1))).select(*facts, *fields)]

    largest = counts.agg(F.max("_n")).first()[0] or 0
    nodes = F.greatest(F.ceil(F.col("_n") / fan_in), F.lit(1)).cast("bigint")
    level = open_.join(counts, F.col("source").eqNullSafe(F.col("_s"))).select(
        *facts, *fields, F.pmod(F.xxhash64("h", F.lit("node")), nodes).alias("node")
    )
    width = max(1, math.ceil(largest / fan_in))
    while largest:
        unit = F.struct(*fields)
        folded = level.groupBy(*facts, "node").agg(F.sort_array(F.collect_list(unit), asc=False).alias("_u"))
        kind = folded.schema["_u"].dataType.elementType.simpleString()
        folded = written(folded.select(*facts, "node", _fold(F.col("_u"), kind).alias("_f")), "node")
        result.append(folded.select(*facts, F.explode("_f.done").alias("_d")).select(*facts, "_d.*"))
        rest = folded.select(*facts, "node", "_f.open.*")
        if width == 1:
            draw = F.when(uniform("h", F.lit("root")) < F.col("p"), 1.0).otherwise(0.0)
            result.append(rest.withColumn("p", draw).select(*facts, *fields))
            break
        width = math.ceil(width / fan_in)
        level = rest.withColumn("node", F.floor(F.col("node") / fan_in))

    settled = reduce(DataFrame.unionByName, result).withColumn(
        "_c", (F.col("base") + F.col("p")).cast("bigint")
    )
    each = F.floor(F.col("_c") / F.col("rows")) + (F.col("_k") <= F.col("_c") % F.col("rows")).cast("bigint")
    return (
        settled.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
        .withColumn("copies", each.cast("bigint"))
        .select("doc_id", "source", "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"), "_k")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    return _dealt(docs, **options).drop("_k")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that have copies, with size, source_size, target, copies and taken.

    Copies stay a number beside the row. Columns of ``docs`` with these names are replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    same = F.xxhash64("doc_id", "source", "size")
    dealt = _dealt(docs, **options).where("copies > 0").select(same.alias("_unit"), "_k", F.struct(*made).alias("_m"))
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"), F.struct(*kept).alias("_row"))
    rows = rows.select(same.alias("_unit"), F.xxhash64("text").alias("_text"), "_row")
    place = F.row_number().over(Window.partitionBy("_unit").orderBy("_text"))
    numbered = rows.withColumn("_k", place.cast("bigint"))
    return numbered.join(dealt, ["_unit", "_k"]).select("_row.*", "_m.*")
