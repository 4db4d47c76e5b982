"""Joins and group splits that hold when one key owns a large share of the rows.

Joins are left to adaptive execution, which splits a skewed partition of a
sort-merge join by the sizes it measures in the shuffle itself; nothing is
counted beforehand. Where a group is to be numbered or sent along edges, its
rows must be split before the shuffle: such hot keys are found by a count that
combines map-side, as part of the same plan, or once for a written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlore.session import cut

HOT_ROWS = 1_000_000  # a key with more rows than this is split into pieces of about this many
HOT_MOST = 10_000     # the heaviest keys that are split; any further key holds less than a 10,000th of the rows
HOT_SLOTS = 1 << 14   # hash values by which a written table is counted before its keys are
FORCE_SPLIT = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("patchlore.hot.rows", str(HOT_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _fan) of the heaviest keys with more than ``hot_rows`` rows, null keys too; starts no job."""
    limit = hot_rows(df.sparkSession)
    heavy = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    most = heavy.orderBy(F.col("_n").desc(), *keys).limit(HOT_MOST)
    return most.select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("long").alias("_fan"))


def written_hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The hot keys of a written table as a table of their own, None if it has none.

    Rows are counted by a hash of the key first, so that keys are only told apart
    where so many share a hash value that a hot one may be among them.
    """
    limit = hot_rows(df.sparkSession)
    if df.count() <= limit:  # no key can have more; a written table knows its rows
        return None
    slot = F.pmod(F.xxhash64(*keys), F.lit(HOT_SLOTS))
    full = [r[0] for r in df.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select("_slot").collect()]
    if not full:
        return None
    hot = cut(hot_keys(df.filter(slot.isin(full)), keys), "hot")
    return None if hot.isEmpty() else hot


def mark_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_fan``, null for keys that are not hot. The list has at most ``HOT_MOST`` rows."""
    named = hot.select(*[F.col(k).alias(f"_hk{i}") for i, k in enumerate(keys)], "_fan")
    same = all_of([F.col(k).eqNullSafe(F.col(f"_hk{i}")) for i, k in enumerate(keys)])
    return df.join(F.broadcast(named), same, "left").drop(*[f"_hk{i}" for i in range(len(keys))])


def salt_many(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Spread the rows of each hot key over its pieces."""
    payload = [c for c in df.columns if c not in keys] or list(keys)
    salt = F.when(F.col("_fan").isNotNull(), F.pmod(F.xxhash64(*payload), F.col("_fan"))).otherwise(F.lit(0))
    return mark_hot(df, keys, hot).withColumn("_salt", salt.cast("long")).drop("_fan")


def salt_copies(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Give the other side one copy per piece, for hot keys only."""
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_fan"), F.lit(1).cast("long")) - 1)
    return mark_hot(df, keys, hot).withColumn("_salt", F.explode(salts)).drop("_fan")


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join whose left side may have hot keys: inner, left, left_semi or left_anti.

    Adaptive execution splits the hot partitions of the left side in each of
    these. It would not where an aggregate on the same keys follows, as this
    takes another shuffle; the session is told to split there too.
    """
    left.sparkSession.conf.set(FORCE_SPLIT, "true")
    return left.join(right, list(on), how)


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
