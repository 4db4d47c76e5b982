import datetime as dt
import random

from pyspark.sql import Window, functions as F

from patchlore.functions.times import is_stale_writer, when_range
from patchlore.operators import timeline as tl
from patchlore.plans import scan as sc
from tests.conftest import rows

T = "pr_id string, sha string, ts timestamp_ntz, ord long"


def log(spark, *stamps):
    """Stamps oldest first; the log is newest first."""
    at = lambda s: dt.datetime.strptime(s, "%Y-%m-%d %H:%M") if s else None
    n = len(stamps)
    return spark.createDataFrame([("p", f"c{i + 1}", at(s), n - i) for i, s in enumerate(stamps)], T)


def bands(spark, *stamps):
    return [r[1] for r in rows(tl.commit_bands(log(spark, *stamps)).select(F.substring("sha", 2, 9).cast("int"), "band"))]


def test_sweeps(spark, plans):
    assert bands(spark, "2019-05-06 08:05", "2019-05-06 10:05", "2019-05-06 12:05", "2019-05-06 14:06") == [1, 1, 1, 2]
    assert bands(spark, "2019-05-06 22:10", "2019-05-07 00:01", "2019-05-07 00:02") == [1, 2, 2]
    assert bands(spark, "2019-05-06 01:00", "2019-05-06 09:00", "2019-05-06 17:00", "2019-05-09 17:00") == [1, 2, 3, 4]
    weekly = [f"2019-{m:02d}-{d:02d} 06:30" for m in (7, 8) for d in (3, 10, 17, 24)]
    assert bands(spark, *weekly) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert bands(spark, *[None] * 8) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert bands(spark, None) == [1]


def test_clock_going_back_opens_no_sweep_within_a_day(spark):
    assert bands(spark, "2019-05-06 16:40", "2019-05-06 13:00", "2019-05-06 14:59") == [1, 1, 1]


def test_stale_writer_and_labels(spark):
    noon = dt.datetime(2019, 5, 6, 12, tzinfo=dt.timezone.utc).timestamp()
    made = ["2019-05-06T11:59:59Z", "2019-05-06T12:00:00Z", "2019-05-06T13:30:00+02:00", "2019-05-06", "soon", None]
    d = spark.createDataFrame([(i, noon, c) for i, c in enumerate(made)], "i int, at double, c string")
    assert [r[1] for r in rows(d.select("i", is_stale_writer(F.col("at"), F.col("c"))))] == [True, False, True, True, False, False]
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    one = lambda a, b: spark.range(1).select(when_range(ts(a), ts(b))).first()[0]
    assert one("2024-06-03 14:02:00", "2024-06-03 14:02:30") == "Jun 3 · 14:02"
    assert one("2024-06-03 14:02:00", "2024-06-03 16:20:00") == "Jun 3 · 14:02–16:20"
    assert one("2024-06-03 14:02:00", "2024-06-05 09:12:00") == "Jun 3 14:02 → Jun 5 09:12"


def test_band_ranges_need_every_time(spark):
    c = log(spark, "2019-05-06 10:00", "2019-05-08 10:00").withColumn("band", F.lit(1)).withColumn("message", F.lit("x"))
    lost = c.withColumn("pr_id", F.lit("q")).withColumn("ts", F.when(F.col("ord") == 1, F.col("ts")))
    assert [r[0] for r in rows(tl.band_ranges(c.unionByName(lost)), "pr_id")] == ["p"]


def test_day_groups_may_repeat_a_day(spark, plans):
    data = [("p", i + 1, d, m) for i, (d, m) in enumerate([("Mon", "a"), ("Mon", "b"), ("Sun", "Merge branch x"), ("Sun", "c"), ("Mon", "d")])]
    d = spark.createDataFrame(data, "pr_id string, ord long, day string, message string")
    assert rows(tl.day_groups(d), "run", "day", "commits") == [(1, "Mon", 2), (2, "Sun", 1), (3, "Mon", 1)]


def test_blocked_scan_equals_plain_windows(spark, plans):
    rnd = random.Random(3)
    data = [(g, i, rnd.choice([None, rnd.randint(-5, 5)])) for g in "ab" for i in rnd.sample(range(60), 30 if g == "a" else 2)]
    d = spark.createDataFrame(data, "k string, i long, v long").repartition(3)
    for reverse in (False, True):
        steps = {"s": sc.running_sum(F.col("v")), "x": sc.running_max(F.col("v"), False), "l": sc.last_value(F.col("v")), "b": sc.row_before(F.col("i")),
                 "t": sc.group_max(F.col("v"))}
        got = sc.scan(d, ["k"], ["i"], steps, sc.by_width("i"), reverse)
        w = Window.partitionBy("k").orderBy(F.desc("i") if reverse else "i")
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        want = d.select("*", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(before).alias("x"), F.last("v", True).over(upto).alias("l"),
                        F.lag("i").over(w).alias("b"), F.max("v").over(Window.partitionBy("k")).alias("t"))
        assert rows(got) == rows(want)


def test_null_keys_and_times_are_numbered_like_others(spark, plans):
    data = [(k, None if i % 4 == 0 else i, i) for k in (None, "a", "b") for i in range(12)]
    d = spark.createDataFrame(data, "k string, t long, id long")
    got = sc.number_rows(d, ["k"], ["t", "id"], F.col("t"), "rn", split_hot_only=True)
    for key in (None, "a", "b"):
        mine = got.filter(F.col("k").eqNullSafe(F.lit(key))).orderBy("rn").collect()
        assert [r.rn for r in mine] == list(range(1, 13)) and [r.id for r in mine[:3]] == [0, 4, 8]
