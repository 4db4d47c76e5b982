import random

from patchlore.plans import intervals as iv
from tests.conftest import rows

SPANS = "k string, id long, a long, b long"


def test_points_meet_exactly_the_spans_around_them(spark):
    r = random.Random(1)
    spans = []
    for i in range(300):
        start = r.randrange(0, 5000)
        spans.append((r.choice("xy"), i, start, start + int(10 ** r.uniform(0, 6)) - 1))
    spans += [("x", 900, 10, 9), ("x", 901, 64, 64), ("x", 902, 63, 128), ("x", 903, None, 5), ("y", 904, 0, 10**10), (None, 905, 0, 99)]
    points = [(r.choice("xyz"), int(10 ** r.uniform(0, 6))) for _ in range(300)] + [("x", 0), ("x", 63), ("x", 64), ("x", 128), ("y", 10**10), (None, 5)]
    p, s = spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, SPANS)
    want = sorted(((k, at, i) for k, at in points for kk, i, a, b in spans if k == kk and k is not None and None not in (a, b) and a <= at <= b), key=str)
    assert rows(iv.points_in_spans(p, s, ["k"], "at", "a", "b"), "k", "at", "id") == want
    assert rows(iv.spans_hit(p, s, ["k"], "at", "a", "b"), "id") == sorted({(i,) for _, _, i in want}, key=str)


def test_a_long_span_takes_few_rows(spark):
    for first in (0, 1, 12_345, 2**33 - 5):
        for length in (1, 64, 65, 256, 257, 10_000_000, 10**11):
            s = spark.createDataFrame([("x", 1, first, first + length - 1)], SPANS)
            assert iv.bin_spans(s, "a", "b", 64).count() <= 2
    short = iv.bin_spans(spark.createDataFrame([("x", i, i, i + 9) for i in range(50)], SPANS), "a", "b", 64)
    asked = spark.createDataFrame([("x", 5), ("x", 70)], "k string, at long")
    assert iv.bin_points(asked, short, "at", 64).count() == 2     # one class, one row a point


def test_no_spans(spark):
    p, s = spark.createDataFrame([("x", 1)], "k string, at long"), spark.createDataFrame([], SPANS)
    assert iv.points_in_spans(p, s, ["k"], "at", "a", "b").collect() == [] and iv.spans_hit(p, s, ["k"], "at", "a", "b").collect() == []


def test_groups_that_are_not_cut_give_no_summaries(spark):
    """Only hot keys have blocks, so only they need a carry; their rows still come from one exchange."""
    from pyspark.sql import functions as F

    from patchlore.plans.scan import ALONE, blocked, number_rows
    d = spark.range(40).select((F.col("id") % 4).alias("k"), "id").unionByName(spark.range(100).select(F.lit(9).cast("long").alias("k"), "id"))
    spark.conf.set("patchlore.hot.rows", "20")
    try:
        cut_up, _ = blocked(d, ["k"], F.floor(F.col("id") / 10), True)
        assert {r.k for r in cut_up.filter(F.col("_blk") != ALONE).select("k").distinct().collect()} == {9}
        got = number_rows(d, ["k"], ["id"], F.floor(F.col("id") / 10), split_hot_only=True)
        assert sorted(r.rn for r in got.filter("k = 9").collect()) == list(range(1, 101))
        assert sorted(r.rn for r in got.filter("k = 1").collect()) == list(range(1, 11))
    finally:
        spark.conf.unset("patchlore.hot.rows")
