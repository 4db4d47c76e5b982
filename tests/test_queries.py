"""Registered queries against their SQL. CHECK_ALL=1 runs every one of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import canon
from patchlore.workload import all_queries

SF = os.environ.get("CHECK_SF", "/root/testdata/sf0.001")
SAMPLE = ["parse_unified_diff", "changed_head_lines", "sweep_bands", "story_near", "clamp_spans", "resolve_uses", "risk_report", "components", "attribute_lines",
          "leftover_context", "review_summary", "next_unread", "contribution_matrix", "file_tree", "sweeps_stream", "review_ageing_stream", "outbox_stream", "batch_rebuild"]
NAMES = list(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), cols)


def test_every_query_has_sql():
    assert set(all_queries.QUERIES) == set(all_queries.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    if SF.endswith("sf0.001"):
        assert entry.entry(spark).count() > 0
