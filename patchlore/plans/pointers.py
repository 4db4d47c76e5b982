"""Pointer doubling: where every node of a functional graph ends, in rounds that grow with the logarithm of the longest path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from patchlore.plans.skew import skew_join
from patchlore.session import cut


def ends(steps: DataFrame, keys: Sequence[str], node: Sequence[str], onto: Sequence[str]) -> DataFrame:
    """(keys, node, end_*, dist, live, low) of every node, written.

    ``steps`` has one row per node: columns ``node`` name it and ``onto`` the node
    it leads to, null where a path ends. ``end_*`` is the last node, ``dist`` the
    steps to it and ``low`` the smallest node on the way. Paths that run into a
    cycle never end: they stay ``live``, and ``low`` of a node on the cycle is
    then the cycle's smallest node. A step may lead to a node without a row; the
    path ends there.
    """
    keys, node, onto = list(keys), list(node), list(onto)
    last = [f"end_{c}" for c in node]
    has = F.col(onto[0]).isNotNull()
    start = steps.select(*keys, *node, *[F.coalesce(F.col(t), F.col(c)).alias(e) for c, t, e in zip(node, onto, last, strict=True)],
                         has.cast("long").alias("dist"), has.alias("live"), F.struct(*node).alias("low"))
    at = cut(start, "pointers")
    going = not at.filter("live").isEmpty()
    while going:
        there = at.select(*keys, *[F.col(c).alias(e) for c, e in zip(node, last, strict=True)],
                          *[F.col(e).alias(f"_{e}") for e in last], F.col("dist").alias("_dist"), F.col("live").alias("_live"), F.col("low").alias("_low"))
        met = skew_join(at, there, keys + last, "left")
        go = F.col("live") & F.col("_dist").isNotNull()
        low = F.when(go, F.least("low", "_low")).otherwise(F.col("low"))
        step = met.select(*keys, *node, *[F.when(go, F.col(f"_{e}")).otherwise(F.col(e)).alias(e) for e in last],
                          F.when(go, F.col("dist") + F.col("_dist")).otherwise(F.col("dist")).alias("dist"),
                          (go & F.col("_live")).alias("live"), low.alias("low"), (F.col("live") & (~(go & F.col("_live")) | (low != F.col("low")))).alias("_moved"))
        # while a path has not ended, some node of it ends in every round; round a cycle, the smallest node is known once none changes
        step = cut(step, "pointers")
        going = not step.filter("_moved").isEmpty()
        at = step.drop("_moved")
    return at
