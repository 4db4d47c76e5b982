import datetime as dt

import pytest
from pyspark.sql import functions as F

from patchlore.streaming import streams as st
from tests.conftest import rows

SCHEMA = "pr_id string, id long, by string, kind string, ts timestamp_ntz"


@pytest.fixture
def landed(spark, tmp_path):
    """Write rows as the next file of a landing folder, and read that folder as a stream, a file per micro-batch."""
    class Landing:
        out = str(tmp_path / "state")
        files = 0

        def add(self, *data):
            frame = spark.createDataFrame([(p, i, b, k, dt.datetime.fromisoformat(t)) for p, i, b, k, t in data], SCHEMA)
            frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            self.files += 1

        def stream(self):
            return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return Landing()


def test_sweeps_in_append_mode_with_late_rows_and_a_restart(spark, landed):
    landed.add(("p", 1, "c1", "add", "2021-03-01T10:00"), ("p", 2, "c2", "add", "2021-03-01T11:30"))
    landed.add(("p", 3, "c3", "add", "2021-03-03T09:00"))
    run = lambda: spark.read.parquet(st.run_available(st.sweeps_stream(landed.stream(), late="1 hour"), "append", "sweeps", landed.out))
    assert rows(run(), "day", "commits") == [(dt.date(2021, 3, 1), 2)]
    landed.add(("p", 4, "c4", "add", "2021-03-01T12:00"), ("p", 5, "c5", "add", "2021-03-05T09:00"))  # the first is too late
    landed.add(("p", 6, "c6", "add", "2021-03-09T09:00"))
    assert rows(run(), "day", "commits") == [(dt.date(2021, 3, 1), 2), (dt.date(2021, 3, 3), 1), (dt.date(2021, 3, 5), 1)]


def test_ageing_over_batches_equals_one_batch(spark, landed):
    states = spark.createDataFrame([("ann", "p", 5), ("bob", "p", 0), ("cid", "q", 7)], "reviewer string, pr_id string, reviewed_at long")
    seen = spark.createDataFrame([("ann", "p", "c1"), ("cid", "q", "c9")], "reviewer string, pr_id string, sha string")
    data = [("pq"[i % 2], i % 3, f"c{i % 5}", "ctx" if i % 7 == 0 else "add", "2021-03-01T10:00") for i in range(40)]
    for i in range(0, 40, 10):
        landed.add(*data[i:i + 10])
    whole = spark.createDataFrame([(p, i, b, k, dt.datetime.fromisoformat(t)) for p, i, b, k, t in data], SCHEMA)
    want = st.review_ageing_stream(whole, states, seen)
    out = spark.read.parquet(st.run_available(st.review_ageing_stream(landed.stream(), states, seen, pieces=3), "update", "ageing", landed.out))
    assert out.select("batch").distinct().count() >= 3
    assert rows(st.latest(out, ["reviewer", "pr_id", "id", "reviewed_at"]), *want.columns) == rows(want)


def test_ageing_does_not_broadcast_the_copies_of_its_tables(spark):
    states = spark.createDataFrame([("ann", "p", 5)], "reviewer string, pr_id string, reviewed_at long")
    seen = spark.createDataFrame([("ann", "p", "c1")], "reviewer string, pr_id string, sha string")
    pushes = spark.createDataFrame([("p", i, f"c{i}", "add") for i in range(4)], "pr_id string, id long, by string, kind string")
    got = st.review_ageing_stream(pushes, states, seen)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "reviewer", "id", "fresh") == [("ann", 0, 1), ("ann", 2, 1), ("ann", 3, 1)]


def test_outbox_sends_each_id_once_across_batches_and_runs(spark, landed):
    landed.add(("p", 1, "", "", "2021-03-01T10:00"), ("p", 1, "", "", "2021-03-01T10:05"), ("p", 2, "", "", "2021-03-01T10:00"))
    landed.add(("p", 2, "", "", "2021-03-02T10:00"), ("q", 1, "", "", "2021-03-02T10:00"))
    assert rows(spark.read.parquet(st.run_outbox(landed.stream(), landed.out)), "pr_id", "id") == [("p", 1), ("p", 2), ("q", 1)]
    landed.add(("p", 1, "", "", "2022-03-01T10:00"), ("p", 3, "", "", "2022-03-01T10:00"))  # a year later
    got = spark.read.parquet(st.run_outbox(landed.stream(), landed.out))
    assert rows(got, "pr_id", "id") == [("p", 1), ("p", 2), ("p", 3), ("q", 1)]
    within = spark.read.parquet(st.run_available(st.outbox_stream(landed.stream(), late="2 days"), "append", "within", landed.out))
    assert rows(within, "pr_id", "id") == [("p", 1), ("p", 2), ("p", 3), ("q", 1)]
