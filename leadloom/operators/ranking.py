"""Positions and running values that stay spread out when one group holds most rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions.text import col
from leadloom.session import cut_lineage


@dataclass(frozen=True)
class Key:
    """One sort key with its direction and null placement."""

    expr: Column | str
    desc: bool = False
    nulls_last: bool = False

    def sort(self, expr: Column | None = None) -> Column:
        c = col(self.expr) if expr is None else expr
        if self.desc:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


def null_safe_key(columns: Sequence[Column | str]) -> Column:
    """One non-null text per combination of values, null included."""
    return F.concat_ws(
        "\x1f", F.lit("k"), *[F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in columns]
    )


def with_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Key],
    coarse: Sequence[Key],
    fine: Sequence[Key] = (),
    out: str = "posicion",
) -> DataFrame:
    """Exact 1-based position per group without sorting a whole group in one task.

    ``coarse`` and ``fine`` are successive prefixes of ``order`` (or order-preserving functions of
    them). Rows are counted per bucket, the counts are accumulated, and only the rows of one
    bucket are sorted together. A bucket is as large as the rows that share both prefixes.
    """
    work = df
    names: list[list[str]] = []
    for depth, level in enumerate((coarse, fine)):
        names.append([f"_l{depth}_{i}" for i in range(len(level))])
        work = work.withColumns(dict(zip(names[-1], [col(k.expr) for k in level], strict=True)))
    outer_cols, inner_cols = names
    # counts and positions must see the same rows, and whatever made them is run once
    work = cut_lineage(work.withColumn("_b", null_safe_key([*group, *outer_cols, *inner_cols])))

    counts = work.groupBy("_b", *group, *outer_cols, *inner_cols).agg(
        F.count(F.lit(1)).alias("_n")
    ).withColumn("_o", null_safe_key([*group, *outer_cols]))
    before = (W.unboundedPreceding, -1)
    outer = counts.groupBy("_o", *group, *outer_cols).agg(F.sum("_n").alias("_n"))
    outer_window = (
        W.partitionBy(*group)
        .orderBy(*[k.sort(F.col(n)) for k, n in zip(coarse, outer_cols, strict=True)])
        .rowsBetween(*before)
    )
    outer = outer.select("_o", F.coalesce(F.sum("_n").over(outer_window), F.lit(0)).alias("_out"))
    if inner_cols:
        inner_window = (
            W.partitionBy("_o")
            .orderBy(*[k.sort(F.col(n)) for k, n in zip(fine, inner_cols, strict=True)])
            .rowsBetween(*before)
        )
        counts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner_window), F.lit(0)))
    else:
        counts = counts.withColumn("_in", F.lit(0).cast("bigint"))
    offsets = counts.join(outer, "_o").select("_b", (F.col("_in") + F.col("_out")).alias("_off"))

    local = F.row_number().over(W.partitionBy("_b").orderBy(*[k.sort() for k in order]))
    return (
        work.withColumn("_rn", local)
        .join(offsets, "_b")
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_b", "_rn", "_off", *outer_cols, *inner_cols)
    )


def numbered(df: DataFrame, order: Sequence[Key], out: str = "posicion") -> DataFrame:
    """Exact 1-based position over a whole table, without a task that sees all of it.

    Rows are dealt by ranges of the full order and counted per range; a row's position is its place
    in its range after the rows of the ranges before. The dealt rows are kept in the shared folder,
    because the counts and the positions must see the same ranges.
    """
    keys = [k.sort() for k in order]
    dealt = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = F.coalesce(
        F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(
        out, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def attach_single(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row (an equality join on a constant)."""
    return (
        df.withColumn("_one", F.lit(1))
        .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one")
        .drop("_one")
    )


#: Chunks whose summaries meet in one task of the carrying step.
CARRIED = 1024


@dataclass(frozen=True)
class Running:
    """A running value: ``last`` / ``sum`` / ``max`` over earlier rows, or ``next`` after."""

    kind: str
    value: Column
    inclusive: bool = False


def with_running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: dict[str, Running],
    levels: int = 2,
) -> DataFrame:
    """Running values per group, computed per chunk and carried from chunk to chunk.

    ``chunk`` is a monotone number of the first order column, so a long group is cut into many
    tasks; only one summary row per chunk crosses between them. The summaries are carried in the
    same way, ``CARRIED`` at a time, so that no task meets all chunks of a long group. Group columns
    must not be null.
    """
    work = df.withColumn("_c", chunk)
    for name, spec in values.items():
        work = work.withColumn(f"_v_{name}", spec.value)
    keys = [*group, "_c"]
    at = F.struct(*order)
    inside = W.partitionBy(*keys).orderBy(*order)
    across = W.partitionBy(*group).orderBy("_c")
    backward, forward = (W.unboundedPreceding, -1), (1, W.unboundedFollowing)

    summaries, carries, locals_, finals = [], [], {}, {}
    for name, spec in values.items():
        v = F.col(f"_v_{name}")
        edge = 0 if spec.inclusive else -1
        if spec.kind == "last":
            summaries.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_s_{name}"))
            carry = F.last(f"_s_{name}", ignorenulls=True).over(across.rowsBetween(*backward))
            local = F.last(v, ignorenulls=True).over(
                inside.rowsBetween(W.unboundedPreceding, edge))
            finals[name] = F.coalesce(F.col(f"_w_{name}"), F.col(f"_k_{name}"))
        elif spec.kind == "next":
            summaries.append(F.min_by(v, F.when(v.isNotNull(), at)).alias(f"_s_{name}"))
            carry = F.first(f"_s_{name}", ignorenulls=True).over(across.rowsBetween(*forward))
            local = F.first(v, ignorenulls=True).over(
                inside.rowsBetween(-edge, W.unboundedFollowing))
            finals[name] = F.coalesce(F.col(f"_w_{name}"), F.col(f"_k_{name}"))
        else:
            fold = F.sum if spec.kind == "sum" else F.max
            summaries.append(fold(v).alias(f"_s_{name}"))
            carry = fold(f"_s_{name}").over(across.rowsBetween(*backward))
            local = fold(v).over(inside.rowsBetween(W.unboundedPreceding, edge))
            if spec.kind == "sum":
                finals[name] = F.coalesce(F.col(f"_w_{name}"), F.lit(0)) + F.coalesce(
                    F.col(f"_k_{name}"), F.lit(0))
            else:
                finals[name] = F.greatest(F.col(f"_w_{name}"), F.col(f"_k_{name}"))
        carries.append(carry.alias(f"_k_{name}"))
        locals_[f"_w_{name}"] = local

    summary = work.groupBy(*keys).agg(*summaries)
    if levels > 1:
        outer = {f"_k_{n}": Running(v.kind, F.col(f"_s_{n}")) for n, v in values.items()}
        carried = with_running(
            summary.withColumnRenamed("_c", "_at"), group, ["_at"], F.floor(F.col("_at") / CARRIED),
            outer, levels - 1,
        ).select(*group, F.col("_at").alias("_c"), *outer)
    else:
        carried = summary.select(*keys, *carries)
    return (
        work.withColumns(locals_)
        .join(carried, keys)
        .withColumns(finals)
        .drop("_c", *[f"{p}{n}" for n in values for p in ("_v_", "_w_", "_k_")])
    )


def group_codes(
    df: DataFrame, keys: Sequence[str], prefix: str, out: str = "codigo", width: int = 3
) -> DataFrame:
    """Number the distinct keys in sorted order: ``DUP-001``, ``DUP-002``, ..."""
    distinct = df.select(*keys).distinct()
    first, rest = keys[0], keys[1:]
    coarse = [Key(first), *[Key(F.substring(F.col(k).cast("string"), 1, 7)) for k in rest]]
    numbered = with_positions(distinct, [], [Key(k) for k in keys], coarse, out="_p")
    text = F.col("_p").cast("string")
    return numbered.select(
        *keys,
        F.concat(
            F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
        ).alias(out),
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Key]) -> DataFrame:
    """One row per key, the last in ``order``; a partial aggregate, no per-key sort.

    Descending keys are read as "largest first", as in ORDER BY ... DESC LIMIT 1.
    """
    rest = [c for c in df.columns if c not in keys]
    if any(not k.desc for k in order):
        raise ValueError("latest_per_key orders by descending keys only.")
    best = F.max_by(F.struct(*rest), F.struct(*[col(k.expr) for k in order])).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Key], n: int, out: str = "orden"
) -> DataFrame:
    """First ``n`` rows per group; Spark trims each map task to ``n`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*[k.sort() for k in order]))
    return df.withColumn(out, rank).where(F.col(out) <= n)


def page(df: DataFrame, order: Sequence[Key], limit: int, offset: int) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*[k.sort() for k in order]).offset(offset).limit(limit)


def append_positions(
    new: DataFrame, current: DataFrame, group: Sequence[str], order: Sequence[Key],
    coarse: Sequence[Key], position: str,
) -> DataFrame:
    """Continue the numbering of ``current`` for the rows of ``new``."""
    top = current.groupBy(*group).agg(F.max(position).alias("_top"))
    numbered = with_positions(new, group, order, coarse, out="_p")
    return (
        numbered.join(top, list(group), "left")
        .withColumn(position, F.coalesce(F.col("_top"), F.lit(0)) + F.col("_p"))
        .drop("_p", "_top")
    )


def batches_of(
    df: DataFrame, owner: str, order: Sequence[Key], coarse: Sequence[Key], size: int = 5
) -> DataFrame:
    """Number batches of at most ``size`` rows per owner; a row without owner travels alone."""
    owned = with_positions(df.where(F.col(owner).isNotNull()), [owner], order, coarse, out="_p")
    owned = owned.withColumn("lote", F.floor((F.col("_p") - 1) / size).cast("bigint")).drop("_p")
    lone = df.where(F.col(owner).isNull()).withColumn("lote", F.lit(None).cast("bigint"))
    return owned.unionByName(lone)


def provable_latest(
    df: DataFrame, keys: Sequence[str], date: str, has_hour: str, row_id: str
) -> DataFrame:
    """Per key the id of the latest event if the order can be proven, else the reason.

    ``date`` is a timestamp (null = unreadable) and ``has_hour`` tells whether the source gave an
    hour. Counting per day and instant first keeps a hot key to a few rows.
    """
    day = F.to_date(date)
    per_instant = df.groupBy(*keys, day.alias("_d"), F.col(date).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.col(has_hour)).alias("_hours"),
        F.min(row_id).alias("_id"),
    )
    per_day = per_instant.groupBy(*keys, "_d").agg(
        F.sum("_n").alias("_n"),
        F.bool_and("_hours").alias("_hours"),
        F.max(F.struct("_t", "_n", "_id")).alias("_last"),
    )
    per_key = per_day.groupBy(*keys).agg(
        F.bool_or(F.col("_d").isNull()).alias("_bad"),
        F.max(F.struct("_d", "_n", "_hours", "_last")).alias("_top"),
    )
    top, last = F.col("_top"), F.col("_top._last")
    reason = (
        F.when(F.col("_bad"), "fecha_invalida")
        .when(top["_n"] == 1, None)
        .when(~top["_hours"], "orden_intradia_desconocido")
        .when(last["_n"] > 1, "empate_fecha")
    )
    return per_key.select(
        *keys,
        F.when(reason.isNull(), last["_id"]).alias(row_id),
        reason.alias("motivo"),
    )


def trailing_counts(
    df: DataFrame, group: Sequence[str], ts: str, row_id: str, spans: dict[str, int],
) -> DataFrame:
    """Events of the group in ``(ts - span, ts]`` for several spans (in seconds).

    Each row is counted once and asked about twice: how many events up to its instant, and up to
    the start of its window. The difference is the window count; minute chunks keep a busy group
    in many tasks. Returns ``row_id`` plus one column per span.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    base = df.select(*group, F.col(row_id), micros.alias("_t"))
    probes = [base.withColumns({"_add": F.lit(1), "_span": F.lit("")})]
    for name, seconds in {"": 0, **spans}.items():
        asked = base.withColumns({"_add": F.lit(0), "_span": F.lit("now" if not name else name)})
        probes.append(asked.withColumn("_t", F.col("_t") - seconds * 1_000_000))
    stream = probes[0]
    for probe in probes[1:]:
        stream = stream.unionByName(probe)
    # at one instant the events come before the questions
    stream = stream.withColumn("_last", F.lit(1) - F.col("_add"))
    counted = with_running(
        stream, group, ["_t", "_last"], F.floor(F.col("_t") / 60_000_000),
        {"_n": Running("sum", F.col("_add"), inclusive=True)},
    ).where("_add = 0")
    pivot = [
        F.sum(F.when(F.col("_span") == name, F.col("_n"))).alias(f"_q_{name}")
        for name in ["now", *spans]
    ]
    wide = counted.groupBy(row_id).agg(*pivot)
    return wide.select(
        row_id, *[(F.col("_q_now") - F.col(f"_q_{name}")).cast("bigint").alias(name)
                  for name in spans]
    )
