"""Running values over ordered groups of any size.

A plain window sorts a whole group in one task. Here a group is cut into
blocks along its order; each block is scanned on its own, the block summaries
(one row per block) are scanned per group, and the carry is added back. A group
of one block has no carry, so for ordinary groups the carry table is empty and
adaptive execution broadcasts it. There is one plan for every size of input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from patchlore.plans.skew import hot_keys, mark_hot

BLOCK_ROWS = 1 << 18
ALONE = (1 << 63) - 1  # the block of a group that is not cut; asked of an aggregate, since Spark would push a filter of the block below the shared exchange


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column
    inclusive: bool = True


def running_sum(value: Column, inclusive: bool = True) -> Step:
    return Step("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Step:
    return Step("max", value, inclusive)


def last_value(value: Column, inclusive: bool = True) -> Step:
    """Last non-null value so far; with ``inclusive=False`` the one before this row."""
    return Step("last", value, inclusive)


def row_before(value: Column) -> Step:
    """Value of the previous row, null at the first one; wrap nullable values in a struct."""
    return Step("last", value, False)


def group_max(value: Column) -> Step:
    return Step("gmax", value)


def group_min(value: Column) -> Step:
    return Step("gmin", value)


def group_sum(value: Column) -> Step:
    return Step("gsum", value)


def by_width(col: str, width: int | None = None) -> Column:
    """Block number for an integer order column (row index, line number, offset)."""
    spark = SparkSession.getActiveSession()
    rows = int(spark.conf.get("patchlore.block.rows", str(width or BLOCK_ROWS)))
    return F.floor(F.col(col) / F.lit(rows))


# True for every row, but it makes the windows and the summaries ask for the same columns, without which Spark would not share their exchange.
SHARED = "_all >= -9223372036854775808L"


def blocked(df: DataFrame, keys: Sequence[str], block: Column, split_hot_only: bool) -> tuple[DataFrame, list[str]]:
    """``df`` shuffled by group ``_g`` and block ``_blk``, with the hash ``_all`` of its columns; and the group columns."""
    first = F.lit(-(1 << 63)).cast("long")
    piece = F.coalesce(block.cast("long"), first)
    if split_hot_only:
        d = mark_hot(df, keys, hot_keys(df, keys)).withColumn("_blk", F.when(F.col("_fan").isNotNull(), piece).otherwise(F.lit(ALONE))).drop("_fan")
    else:
        d = df.withColumn("_blk", piece)
    on = ["_g"] if keys else []
    d = d.select("*", *([F.struct(*keys).alias("_g")] if keys else [])).repartition(*on, "_blk")
    return d.withColumn("_all", F.xxhash64(*d.columns)), on


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: Mapping[str, Step], block: Column,
         reverse: bool = False, split_hot_only: bool = False) -> DataFrame:
    """Add one column per step, computed over ``keys`` in ``order``.

    ``block`` must grow with the first order column; rows without a block (null
    order) form the first one, as they sort. With ``split_hot_only`` it is used
    for hot keys only (for sparse orders such as time), which costs one map-side
    combined count of the keys. Null keys are one group like any other: groups
    are told apart by a struct of the keys, which is never null, so that plain
    equality lets the carry join reuse the partitioning of the window.

    The rows are shuffled once, by group and block: the windows and the block
    summaries both start from that exchange.
    """
    d, on = blocked(df, keys, block, split_hot_only)
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    rank = F.struct(*order)
    rows = Window.partitionBy(*on, "_blk").orderBy(*sort)
    whole = Window.partitionBy(*on, "_blk")
    blocks = Window.partitionBy(*on).orderBy(F.col("_blk").desc() if reverse else F.col("_blk"))
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.partitionBy(*on)

    local, summary, carry = {}, [], []
    for i, (name, s) in enumerate(steps.items()):
        frame = rows.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        part, got = f"_s{i}", f"_c{i}"
        if s.kind == "sum":
            local[name] = F.sum(s.value).over(frame)
            summary.append(F.sum(s.value).alias(part))
            carry.append(F.sum(part).over(before).alias(got))
        elif s.kind == "max":
            local[name] = F.max(s.value).over(frame)
            summary.append(F.max(s.value).alias(part))
            carry.append(F.max(part).over(before).alias(got))
        elif s.kind == "last":
            local[name] = F.last(s.value, ignorenulls=True).over(frame)
            pick = F.min_by if reverse else F.max_by
            summary.append(pick(s.value, F.when(s.value.isNotNull(), rank)).alias(part))
            carry.append(F.last(part, ignorenulls=True).over(before).alias(got))
        else:
            agg = {"gmax": F.max, "gmin": F.min, "gsum": F.sum}[s.kind]
            local[name] = agg(s.value).over(whole)
            summary.append(agg(s.value).alias(part))
            carry.append(agg(part).over(all_blocks).alias(got))

    scanned = d.select("*", *[c.alias(n) for n, c in local.items()]).filter(SHARED)
    sums = d.groupBy(*on, "_blk").agg(*summary, F.max("_all").alias("_all"), F.max("_blk").alias("_last")).filter(SHARED).filter(F.col("_last") != ALONE)
    sums = sums.select(*on, "_blk", F.count("*").over(all_blocks).alias("_nb"), *carry)
    sums = sums.filter(F.col("_nb") > 1).drop("_nb")
    joined = scanned.join(sums, on + ["_blk"], "left")
    out = [F.col(c) for c in df.columns]
    for i, (name, s) in enumerate(steps.items()):
        mine, got = F.col(name), F.col(f"_c{i}")
        if s.kind == "sum":
            merged = F.coalesce(mine, F.lit(0)) + F.coalesce(got, F.lit(0))
        elif s.kind == "max":
            merged = F.greatest(mine, got)
        elif s.kind == "last":
            merged = F.coalesce(mine, got)
        else:
            merged = F.coalesce(got, mine)
        out.append(merged.alias(name))
    return joined.select(*out)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "rn",
                reverse: bool = False, split_hot_only: bool = False) -> DataFrame:
    """Row number (from 1) per key, without sorting a whole hot key in one task."""
    return scan(df, keys, order, {name: running_sum(F.lit(1).cast("long"))}, block, reverse, split_hot_only)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, block: Column,
            name: str = "run", reverse: bool = False, split_hot_only: bool = False) -> DataFrame:
    """Number the maximal runs of equal ``value`` (null equals null) from 1.

    Runs are numbered per block, whose first row always opens one. The summary of
    a block is its number of runs and its first and last value: a block that goes
    on with the value the block before ended with counts one run less.
    """
    d, on = blocked(df.withColumn("_v", F.struct(value.alias("v"))), keys, block, split_hot_only)
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    rows = Window.partitionBy(*on, "_blk").orderBy(*sort)
    opened = d.withColumn("_prev", F.lag("_v").over(rows))
    opens = F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col("_v.v"))
    opened = opened.withColumn("_open", F.when(opens, 1).otherwise(0).cast("long"))
    numbered = opened.withColumn(name, F.sum("_open").over(rows.rowsBetween(Window.unboundedPreceding, 0))).filter(SHARED)
    low, high = F.min_by("_v", F.struct(*order)), F.max_by("_v", F.struct(*order))
    ends = (high, low) if reverse else (low, high)
    sums = opened.groupBy(*on, "_blk").agg(F.sum("_open").alias("_n"), ends[0].alias("_from"), ends[1].alias("_to"), F.max("_all").alias("_all"), F.max("_blk").alias("_last")).filter(SHARED).filter(F.col("_last") != ALONE)
    blocks = Window.partitionBy(*on).orderBy(F.col("_blk").desc() if reverse else F.col("_blk"))
    sums = sums.withColumn("_goes_on", F.coalesce(F.lag("_to").over(blocks)["v"].eqNullSafe(F.col("_from.v")) & F.lag("_to").over(blocks).isNotNull(), F.lit(False)).cast("long"))
    runs = F.coalesce(F.sum("_n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    merged = F.sum("_goes_on").over(blocks.rowsBetween(Window.unboundedPreceding, 0))
    carry = sums.select(*on, "_blk", F.count("*").over(Window.partitionBy(*on)).alias("_nb"), (runs - merged).alias("_before")).filter("_nb > 1").drop("_nb")
    joined = numbered.join(carry, on + ["_blk"], "left")
    return joined.select(*df.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name))
