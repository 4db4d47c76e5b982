"""Which file a path meant at a commit: renames, swaps, removals and the reuse of paths over time.

``ord`` counts commits from 1, the newest. A rename or removal at ``ord`` ends what
its old path meant for older commits (larger ``ord``); a commit that renames a file
shows it under its new path. So a path of some commit leads to the first newer
event of that path, the event's new path to the first event of that path newer
still, and so on. Events form paths that only go forward in time; their ends are
found by pointer doubling, and each step in time by one ordered scan per path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from patchlore.plans.pointers import ends
from patchlore.plans.scan import by_width, last_value, scan
from patchlore.plans.skew import skew_join
from patchlore.session import cut

PR = ("pr_id",)
ORD_BLOCK = 1 << 16


def _next_event(asked: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` (keys, path, ord, ...) with ``_next``: the ord of the first newer event of that path, null if none."""
    rest = [c for c in asked.columns if c not in (*keys, "path", "ord")]
    q = asked.select(*keys, "path", "ord", F.lit(0).alias("_event"), *rest)
    e = events.select(*keys, F.col("old_path").alias("path"), "ord", F.lit(1).alias("_event"), F.col("ord").alias("_at"))
    both = q.unionByName(e, allowMissingColumns=True)
    # at one commit questions come before events: what a commit itself ends is of no use to it
    found = scan(both, keys + ["path"], ["ord", "_event"], {"_next": last_value(F.col("_at"))}, by_width("ord", ORD_BLOCK))
    return found.filter("_event = 0").drop("_event", "_at")


def path_events(renames: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, old_path, ord, path, head_path) of every event, ``head_path`` being what its file is called at the newest commit.

    ``renames`` has (keys, old_path, path, ord); a null ``path`` removes the file.
    Of several events of one path at one commit the smallest new path counts, a
    removal only if it is alone.
    """
    keys = list(keys)
    events = renames.groupBy(*keys, "old_path", "ord").agg(F.min("path").alias("path"))
    events = cut(events, "path-events")
    onward = _next_event(events.select(*keys, "path", "ord", "old_path"), events, keys)
    steps = onward.select(*keys, "old_path", "ord", F.when(F.col("_next").isNotNull(), F.col("path")).alias("_to"), F.col("_next").alias("_to_ord"))
    last = ends(steps, keys, ["old_path", "ord"], ["_to", "_to_ord"])
    named = events.select(*keys, F.col("old_path").alias("end_old_path"), F.col("ord").alias("end_ord"), F.col("path").alias("head_path"))
    placed = skew_join(last.select(*keys, "old_path", "ord", "end_old_path", "end_ord"), named, keys + ["end_old_path", "end_ord"])
    return events.join(placed.select(*keys, "old_path", "ord", "head_path"), keys + ["old_path", "ord"])


def head_paths(written: DataFrame, renames: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, path, ord, head_path) for every distinct (path, ord) of ``written``; null where the file is gone since."""
    keys = list(keys)
    events = path_events(renames, keys)
    asked = _next_event(written.select(*keys, "path", "ord").distinct(), events, keys)
    to = events.select(*keys, F.col("old_path").alias("path"), F.col("ord").alias("_next"), "head_path", F.lit(True).alias("_moved"))
    d = skew_join(asked, to, keys + ["path", "_next"], "left")
    return d.select(*keys, "path", "ord", F.when(F.col("_moved"), F.col("head_path")).otherwise(F.col("path")).alias("head_path"))


def at_head(written: DataFrame, renames: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """``written`` with ``path`` replaced by the file's path at the newest commit; lines of removed files go."""
    keys = list(keys)
    d = skew_join(written, head_paths(written, renames, keys), keys + ["path", "ord"])
    return d.filter(F.col("head_path").isNotNull()).withColumn("path", F.col("head_path")).drop("head_path")
