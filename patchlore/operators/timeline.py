"""Commits on the time axis: sweeps, bands and who wrote what first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlore.functions.text import is_merge_message
from patchlore.functions.times import when_range
from patchlore.plans.scan import by_width, group_max, group_sum, islands, number_rows, row_before, running_sum, scan
from patchlore.plans.skew import skew_join
from patchlore.session import cut

# Gap that opens a sweep, and the length of the band ramp.
SWEEP_GAP_HOURS = 2
BANDS = 4


def _micros(ts: str) -> Column:
    """Microseconds on the clock of the log itself: no session time zone, no clock change."""
    clock = F.col(ts).cast("timestamp_ntz")
    seconds = F.datediff(clock, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(clock).cast("long") * 3_600 + F.minute(clock).cast("long") * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), clock) * 1_000_000).cast("long")


def sweep_ids(commits: DataFrame, keys: Sequence[str] = ("pr_id",), ts: str = "ts", order: str = "ord",
              gap_hours: float = SWEEP_GAP_HOURS, width: int | None = None) -> DataFrame:
    """Add ``sweep`` (from 1, oldest first).

    Commits are walked from the largest ``order`` (a log is newest first); a
    sweep opens at the first commit, on another calendar day, or after a gap
    strictly longer than ``gap_hours``.
    """
    d = commits.withColumn("_now", F.when(F.col(ts).isNotNull(), F.struct(_micros(ts).alias("t"), F.to_date(ts).alias("day"))))
    d = scan(d, keys, [order], {"_was": row_before(F.col("_now"))}, by_width(order, width), reverse=True)
    opens = (F.col("_was").isNull() | (F.col("_was.day") != F.col("_now.day"))
             | (F.col("_now.t") - F.col("_was.t") > F.lit(int(gap_hours * 3600 * 1_000_000))))
    d = d.withColumn("_open", opens.cast("long")).drop("_now", "_was")
    return scan(d, keys, [order], {"sweep": running_sum(F.col("_open"))}, by_width(order, width), reverse=True).drop("_open")


def _fold(i: Column, n: Column) -> Column:
    return F.least(F.lit(BANDS), F.floor(i * BANDS / n) + 1)


def sweep_bands(sweeps: DataFrame, keys: Sequence[str] = ("pr_id",), order: str = "ord", width: int | None = None) -> DataFrame:
    """Add ``band`` 1..4: the sweep number itself up to four sweeps, else folded onto four."""
    d = scan(sweeps, keys, [order], {"_n": group_max(F.col("sweep"))}, by_width(order, width))
    band = F.when(F.col("_n") <= BANDS, F.col("sweep")).otherwise(_fold(F.col("sweep") - 1, F.col("_n")))
    return d.withColumn("band", band.cast("long")).drop("_n")


def order_bands(commits: DataFrame, keys: Sequence[str] = ("pr_id",), order: str = "ord", width: int | None = None) -> DataFrame:
    """Add ``band`` by position in the log (``order`` counts from 1, newest first)."""
    d = scan(commits, keys, [order], {"_m": group_sum(F.lit(1).cast("long"))}, by_width(order, width))
    return d.withColumn("band", _fold(F.col("_m") - F.col(order), F.col("_m")).cast("long")).drop("_m")


def commit_bands(commits: DataFrame, keys: Sequence[str] = ("pr_id",), ts: str = "ts", order: str = "ord",
                 gap_hours: float = SWEEP_GAP_HOURS, width: int | None = None) -> DataFrame:
    """Sweep bands, or order bands where the oldest commit has no time."""
    d = cut(sweep_ids(commits, keys, ts, order, gap_hours, width), "sweeps")
    timed = F.struct(F.col(order).alias("o"), F.col(ts).isNotNull().alias("timed"))
    d = scan(d, keys, [order], {"_n": group_max(F.col("sweep")), "_m": group_sum(F.lit(1).cast("long")), "_oldest": group_max(timed)},
             by_width(order, width))
    by_sweep = F.when(F.col("_n") <= BANDS, F.col("sweep")).otherwise(_fold(F.col("sweep") - 1, F.col("_n")))
    by_order = _fold(F.col("_m") - F.col(order), F.col("_m"))
    band = F.when(F.col("_oldest.timed"), by_sweep).otherwise(by_order)
    return d.withColumn("band", band.cast("long")).drop("_n", "_m", "_oldest")


def band_ranges(commits: DataFrame, keys: Sequence[str] = ("pr_id",), ts: str = "ts", band: str = "band",
                message: str = "message") -> DataFrame:
    """First and last time per band over non-merge commits; nothing for a group with a missing time."""
    per = commits.filter(~is_merge_message(F.col(message))).groupBy(*keys, band).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.max(F.col(ts).isNull()).alias("_gap"))
    w = Window.partitionBy(*keys)  # at most four rows per group
    per = per.withColumn("_any", F.max("_gap").over(w)).filter(~F.col("_any")).drop("_gap", "_any")
    return per.withColumn("label", when_range(F.col("first_ts"), F.col("last_ts")))


def commits_of(commits: DataFrame, touches: DataFrame, keys: Sequence[str] = (), sha: str = "sha") -> DataFrame:
    """Touch rows with their commit (a commit may touch very many entries)."""
    return skew_join(touches, commits, list(keys) + [sha])


def introducer_of(touched: DataFrame, keys: Sequence[str] = (), entry: str = "entry_id", sha: str = "sha", band: str = "band",
                  order: str = "ord", message: str = "message") -> DataFrame:
    """Per entry the non-merge commit of the lowest band, the earliest of those (largest ``order``)."""
    real = touched.filter(~is_merge_message(F.col(message)))
    pick = F.min(F.struct(F.col(band), (-F.col(order)).alias("o"), F.col(sha).alias("sha"))).alias("p")
    return real.groupBy(*keys, entry).agg(pick).select(*keys, entry, F.col("p.sha").alias("introducer"), F.col(f"p.{band}").alias("band"))


def node_band(entries: DataFrame, touched: DataFrame, keys: Sequence[str] = (), entry: str = "entry_id", band: str = "band",
              message: str = "message") -> DataFrame:
    """Lowest band per entry over non-merge commits, null if none touched it."""
    low = touched.filter(~is_merge_message(F.col(message))).groupBy(*keys, entry).agg(F.min(band).alias("node_band"))
    return entries.join(low, list(keys) + [entry], "left")


def file_bands(lines: DataFrame, keys: Sequence[str] = ("pr_id", "path"), band: str = "band") -> DataFrame:
    """Sorted distinct bands on a file's lines, as an array of at most four."""
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_set(band)).alias("bands"))


def day_groups(commits: DataFrame, keys: Sequence[str] = ("pr_id",), day: Column | None = None, order: str = "ord",
               message: str = "message", width: int | None = None) -> DataFrame:
    """Runs of equal day in the newest-first list of non-merge commits."""
    real = commits.filter(~is_merge_message(F.col(message)))
    real = real.withColumn("day", F.col("day") if day is None else day)
    runs = islands(real, keys, [order], F.col("day"), by_width(order, width))
    return runs.groupBy(*keys, "run").agg(F.first("day").alias("day"), F.count("*").alias("commits"),
                                          F.min(order).alias("first_ord"), F.max(order).alias("last_ord"))


def story_steps(touched: DataFrame, entries: DataFrame, keys: Sequence[str] = (), comp: str = "comp_id", entry: str = "entry_id",
                sha: str = "sha", band: str = "band", order: str = "ord", message: str = "message",
                width: int | None = None) -> DataFrame:
    """(keys, comp, sha, order, band, step): non-merge commits touching a component, oldest first from 0."""
    real = touched.filter(~is_merge_message(F.col(message)))
    by_comp = skew_join(real, entries.select(*keys, comp, entry), list(keys) + [entry])
    steps = cut(by_comp.groupBy(*keys, comp, sha).agg(F.max(order).alias(order), F.max(band).alias(band)), "steps")
    steps = number_rows(steps, list(keys) + [comp], [order], by_width(order, width), "step", reverse=True)
    return steps.withColumn("step", F.col("step") - 1)


def story_replay(touched: DataFrame, entries: DataFrame, keys: Sequence[str] = (), comp: str = "comp_id", entry: str = "entry_id",
                 sha: str = "sha", band: str = "band", order: str = "ord", message: str = "message",
                 width: int | None = None) -> DataFrame:
    """(keys, comp, entry, step, band): the step that lights an entry, and the band of that step."""
    touched = cut(touched.select(*keys, entry, sha, band, order, message), "touched")
    steps = story_steps(touched, entries, keys, comp, entry, sha, band, order, message, width)
    hits = skew_join(touched.select(*keys, entry, sha), entries.select(*keys, comp, entry), list(keys) + [entry])
    lit = skew_join(hits, steps.select(*keys, comp, sha, "step", band), list(keys) + [comp, sha])
    first = lit.groupBy(*keys, comp, entry).agg(F.min(F.struct("step", band)).alias("p"))
    return first.select(*keys, comp, entry, "p.step", f"p.{band}")


def story_edges(replay: DataFrame, edges: DataFrame, keys: Sequence[str] = (), comp: str = "comp_id", entry: str = "entry_id") -> DataFrame:
    """Component edges with the step at which both ends are lit (null if never)."""
    lit = replay.select(*keys, comp, F.col(entry).alias("_e"), "step")
    on = list(keys) + [comp]
    a = lit.withColumnsRenamed({"_e": "a", "step": "step_a"})
    b = lit.withColumnsRenamed({"_e": "b", "step": "step_b"})
    d = skew_join(edges, a, on + ["a"], "left")
    d = skew_join(d, b, on + ["b"], "left")
    both = F.col("step_a").isNotNull() & F.col("step_b").isNotNull()
    return d.withColumn("on_step", F.when(both, F.greatest("step_a", "step_b")))


def story_near(story: DataFrame, keys: Sequence[str] = (), comp: str = "comp_id") -> DataFrame:
    """(keys, comp, entry, near_from, near_until): steps during which an entry is a lit entry's unlit neighbour."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("entry_id"), F.col("step_a").alias("own"), F.col("step_b").alias("other")),
                             F.struct(F.col("b").alias("entry_id"), F.col("step_b").alias("own"), F.col("step_a").alias("other"))))
    e = story.select(*keys, comp, ends.alias("e")).select(*keys, comp, "e.*")
    per = e.groupBy(*keys, comp, "entry_id").agg(F.min("other").alias("near_from"), F.min("own").alias("near_until"))
    early = F.col("near_until").isNull() | (F.col("near_from") < F.col("near_until"))
    return per.filter(F.col("near_from").isNotNull() & early)
