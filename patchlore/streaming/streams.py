"""Streaming forms of sessionising, checkpoint ageing and the outbox."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from patchlore.operators.timeline import SWEEP_GAP_HOURS
from patchlore.plans.skew import all_of
from patchlore.session import cut, new_path
from patchlore.sources.writers import OUTBOX_BUCKETS

SALTS = 16


def sweeps_stream(commits: DataFrame, keys: Sequence[str] = ("pr_id",), ts: str = "ts", gap_hours: float = SWEEP_GAP_HOURS,
                  late: str = "1 day") -> DataFrame:
    """(keys, day, first_ts, commits): sweeps of a commit stream.

    Sessions never cross a calendar day. A commit later than ``late`` behind the
    newest one is dropped; in append mode a sweep appears once the watermark has
    passed its end.
    """
    c = commits.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    gap = f"{int(gap_hours * 3600)} seconds"
    per = c.groupBy(*keys, F.to_date(ts).alias("day"), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("commits"))
    return per.select(*keys, "day", F.col("w.start").alias("first_ts"), "commits")


def review_ageing_stream(pushes: DataFrame, states: DataFrame, seen: DataFrame, keys: Sequence[str] = ("pr_id",), pieces: int = SALTS) -> DataFrame:
    """(reviewer, keys, id, reviewed_at, fresh): changed lines by unseen commits, in update mode.

    ``pushes`` streams (keys, id, by, kind); ``states`` and ``seen`` are tables,
    read again for every micro-batch. The checkpoint time is part of the key, so
    marking again starts new counts; an id is unread while its newest checkpoint
    has a row. Counts combine map-side. The copies of the tables are shuffled:
    Spark does not see that they are copies and would broadcast them.
    """
    keys = list(keys)
    p = pushes.filter((F.col("kind") != "ctx") & F.col("by").isNotNull())
    # streams have no runtime skew handling: the few rows of state and seen commits are
    # copied over ``pieces`` salts, so that the pushes of one busy request, or of one
    # busy commit, meet them in many tasks
    copies = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("_salt")
    marked = states.filter(F.col("reviewed_at") > 0).select("reviewer", *keys, "reviewed_at", copies).hint("merge")
    d = p.withColumn("_salt", F.pmod(F.xxhash64("by", "id"), F.lit(pieces)).cast("int")).join(marked, keys + ["_salt"])
    known = seen.select("reviewer", *keys, F.col("sha").alias("by"), copies).hint("merge")
    d = d.join(known, ["reviewer", *keys, "by", "_salt"], "left_anti")
    return d.groupBy("reviewer", *keys, "id", "reviewed_at").agg(F.count("*").alias("fresh"))


def outbox_stream(items: DataFrame, keys: Sequence[str] = ("pr_id",), ts: str = "ts", late: str = "7 days") -> DataFrame:
    """Each (keys, id) once; repeats within ``late`` of the first are dropped.

    The state is bounded by ``late``; ``run_outbox`` drops repeats of any age.
    """
    d = items.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return d.dropDuplicatesWithinWatermark([*keys, "id"])


def run_available(stream: DataFrame, mode: str, name: str, folder: str | None = None) -> str:
    """Run a stream over what has arrived; returns the folder of its output table.

    Append writes rows once. Update and complete write each micro-batch to its
    own sub-folder, replaced when the batch is retried; see ``latest``. With
    ``folder`` a later run goes on where the last one ended.
    """
    spark = stream.sparkSession
    out = new_path(spark, name) if folder is None else f"{folder}/{name}"
    log = new_path(spark, f"{name}-log") if folder is None else f"{folder}/{name}-log"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        q = w.foreachBatch(save).start()
    q.awaitTermination()
    return out


def run_outbox(items: DataFrame, folder: str, keys: Sequence[str] = ("pr_id",)) -> str:
    """Append the (keys, id) of ``items`` that the outbox has not had, however long ago; returns its folder.

    Each micro-batch is compared with those rows of the others that lie in the
    hash buckets it has rows for, and has a folder of its own, so a retried batch replaces itself and nothing is sent twice.
    """
    out, on = f"{folder}/outbox", [*keys, "id"]

    def save(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(on).withColumn("bucket", F.pmod(F.xxhash64(*on), F.lit(OUTBOX_BUCKETS)).cast("int"))
        fresh = cut(fresh, "outbox-batch")
        buckets = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most OUTBOX_BUCKETS
        try:
            sent = fresh.sparkSession.read.parquet(out).filter((F.col("batch") != batch_id) & F.col("bucket").isin(buckets)).select(*on)
        except AnalysisException:  # nothing sent yet
            sent = None
        if sent is not None:
            same = all_of([F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in on])
            fresh = fresh.alias("n").join(sent.alias("s"), same, "left_anti")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={batch_id}")

    items.writeStream.option("checkpointLocation", f"{folder}/outbox-log").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return out


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of an update-mode table (column ``batch``)."""
    rest = [c for c in table.columns if c not in keys and c != "batch"]
    pick = F.max_by(F.struct(*rest), "batch").alias("_r")
    return table.groupBy(*keys).agg(pick).select(*keys, "_r.*")
