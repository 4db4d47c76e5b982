"""Queries over lines followed through commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlore.operators import history as hi
from patchlore.session import cut
from patchlore.workload import tables as t
from patchlore.workload.registry import query

PR = ["pr_id"]


def changes(spark, sf):
    """Each supplier is a file and each order a commit; its parts give the numbers of the lines put in or taken out."""
    li = t.table(spark, sf, "lineitem").filter("l_returnflag IN ('A', 'R')")
    line = 1 + (F.col("l_partkey") + F.col("l_orderkey")) % 50
    written = li.select((F.col("l_suppkey") % 7).alias("pr_id"), F.col("l_suppkey").alias("path"), (-F.col("l_orderkey")).alias("ord"),
                        F.when(F.col("l_returnflag") == "A", "add").otherwise("del").alias("kind"), line.alias("old"), line.alias("new"))
    return cut(hi.line_changes(written, PR), "changes")


def base_lines(spark, sf):
    p = t.table(spark, sf, "part")
    path = F.col("p_partkey") % t.supplier_count(spark, sf)
    return p.select((path % 7).alias("pr_id"), path.alias("path"), F.lit(None).cast("long").alias("ord"), F.col("p_size").cast("long").alias("line"))


def walk(start: str) -> str:
    """Every line of ``start`` (path, ord, line, step) taken from one commit of its file to the next."""
    return f"""WITH RECURSIVE ch AS (SELECT DISTINCT l_suppkey AS path, l_orderkey AS c, l_returnflag AS f, 1 + (l_partkey + l_orderkey) % 50 AS line
  FROM lineitem WHERE l_returnflag IN ('A', 'R')),
pl AS (SELECT *, line - row_number() OVER (PARTITION BY path, c, f ORDER BY line) AS room FROM ch),
st AS (SELECT path, c, row_number() OVER (PARTITION BY path ORDER BY c) - 1 AS step,
  coalesce(list(line) FILTER (f = 'R'), []) AS outs, coalesce(list(room) FILTER (f = 'A'), []) AS rooms FROM pl GROUP BY path, c),
start AS ({start}),
fl AS (SELECT path, ord, line, line AS pos, step, NULL::BIGINT AS end_ord FROM start
  UNION ALL
  SELECT path, ord, line, CASE WHEN gone THEN pos ELSE mid + len(list_filter(rooms, lambda x: x < mid)) END, step + 1, CASE WHEN gone THEN -c END
  FROM (SELECT fl.*, st.c, rooms, list_contains(outs, pos) AS gone, pos - len(list_filter(outs, lambda x: x < pos)) AS mid
        FROM fl JOIN st ON st.path = fl.path AND st.step = fl.step WHERE end_ord IS NULL) n),
tr AS (SELECT path % 7 AS pr_id, path, ord, line, arg_max(end_ord, step) AS end_ord, arg_max(pos, step) AS end_line
  FROM (SELECT path, ord, line, coalesce(end_ord, 1) AS end_ord, pos, step FROM fl) GROUP BY path, ord, line)
"""


ADDED = walk("SELECT ch.path, -ch.c AS ord, line, step + 1 AS step FROM ch JOIN st ON st.path = ch.path AND st.c = ch.c WHERE f = 'A'")
BASE = walk("SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS path, NULL::BIGINT AS ord, p_size AS line, 0 AS step FROM part WHERE p_size >= 1")


@query("track_lines", ADDED + "SELECT pr_id, path, ord, line, CASE WHEN end_ord < 1 THEN end_ord END AS end_ord, end_line FROM tr")
def track_lines(spark, sf):
    return hi.track_lines(changes(spark, sf), PR)


@query("head_blame", ADDED + "SELECT pr_id, path, end_line AS line, ord FROM tr WHERE end_ord = 1")
def head_blame(spark, sf):
    return hi.head_blame(hi.track_lines(changes(spark, sf), PR), PR)


@query("removed_origins", ADDED + """SELECT d.path % 7 AS pr_id, d.path, -d.c AS ord, d.line, o.ord AS from_ord, o.line AS from_line
FROM (SELECT path, c, line FROM ch WHERE f = 'R') d LEFT JOIN (SELECT path, end_ord, end_line, ord, line FROM tr) o
ON o.path = d.path AND o.end_ord = -d.c AND o.end_line = d.line""")
def removed_origins(spark, sf):
    made = changes(spark, sf)
    return hi.removed_origins(hi.track_lines(made, PR), made, PR)


@query("follow_base_lines", BASE + "SELECT pr_id, path, ord, line, CASE WHEN end_ord < 1 THEN end_ord END AS end_ord, end_line FROM tr")
def follow_base_lines(spark, sf):
    return hi.follow_lines(base_lines(spark, sf), changes(spark, sf), PR)
