"""Queries for the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlore.operators import reports as rp
from patchlore.workload import tables as t
from patchlore.workload.registry import query
from patchlore.workload.tables import with_views

NOKEY: list[str] = []
VIEWS = "s_touches s_order_commits s_comp_entries"

CELLS = """cc AS (SELECT DISTINCT comp_id, c.sha, author, band, ts, ord FROM s_touches t JOIN s_comp_entries e USING (entry_id) JOIN s_order_commits c ON c.sha = t.sha WHERE NOT starts_with(message, 'Merge branch')),
mx AS (SELECT comp_id, author, count(*) AS commits, max(band) AS newest_band FROM cc GROUP BY ALL)
"""


def cells(spark, sf):
    return rp.component_commits(t.touches(spark, sf), t.order_commits(spark, sf), t.comp_entries(spark, sf), NOKEY)


@query("contribution_matrix", with_views(VIEWS, CELLS + "SELECT * FROM mx"))
def contribution_matrix(spark, sf):
    return rp.contribution_matrix(cells(spark, sf), NOKEY)


AUTHORS = ["dev0", "dev1", "dev2", "dev3", "dev4"]


@query("contribution_pivot", with_views(VIEWS, CELLS + "SELECT comp_id, " + ", ".join(
    f"CAST(sum(commits) FILTER (author = '{a}') AS BIGINT) AS {a}" for a in AUTHORS) + " FROM mx GROUP BY comp_id"))
def contribution_pivot(spark, sf):
    return rp.contribution_pivot(rp.contribution_matrix(cells(spark, sf), NOKEY), AUTHORS, NOKEY)


@query("matrix_detail", with_views(VIEWS, CELLS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY comp_id, author ORDER BY ts DESC, ord) AS r, count(*) OVER (PARTITION BY comp_id, author) AS n FROM cc)
SELECT comp_id, author, sha, CAST(r AS INTEGER) AS "rank", greatest(n - 5, 0) AS more FROM rk WHERE r <= 5"""))
def matrix_detail(spark, sf):
    return rp.matrix_detail(cells(spark, sf), NOKEY).select("comp_id", "author", "sha", "rank", "more")


@query("author_totals", with_views("s_commits", "SELECT pr_id, author, count(*) AS commits FROM s_commits WHERE NOT starts_with(message, 'Merge branch') GROUP BY ALL"))
def author_totals(spark, sf):
    e = t.table(spark, sf, "events")
    c = e.select(F.col("user_id").alias("pr_id"), F.concat(F.lit("dev"), (F.col("event_id") % 7).cast("string")).alias("author"),
                 F.when(F.col("event_type") == "signup", "Merge branch main").otherwise(F.col("event_type")).alias("message"))
    return rp.author_totals(c)


@query("overview", with_views("s_commits", """
a AS (SELECT pr_id, count(*) AS commits, count(DISTINCT author) AS contributors FROM s_commits WHERE NOT starts_with(message, 'Merge branch') GROUP BY pr_id),
b AS (SELECT p_partkey % 200 AS pr_id, count(DISTINCT p_brand) AS n FROM part GROUP BY 1),
c AS (SELECT conv_id % 200 AS pr_id, count(DISTINCT turn) AS n FROM conversations WHERE turn % 3 <> 0 GROUP BY 1),
d AS (SELECT l_suppkey AS pr_id, count(*) FILTER (l_orderkey % 10 = 0) AS n FROM lineitem GROUP BY 1)
SELECT pr_id, commits, contributors, coalesce(b.n, 0) AS components, coalesce(c.n, 0) AS entries_with_threads, coalesce(d.n, 0) AS conflict_lines
FROM a LEFT JOIN b USING (pr_id) LEFT JOIN c USING (pr_id) LEFT JOIN d USING (pr_id)"""))
def overview(spark, sf):
    e = t.table(spark, sf, "events")
    commits = e.select(F.col("user_id").alias("pr_id"), F.concat(F.lit("dev"), (F.col("event_id") % 7).cast("string")).alias("author"),
                       F.when(F.col("event_type") == "signup", "Merge branch main").otherwise(F.col("event_type")).alias("message"))
    comps = t.table(spark, sf, "part").select((F.col("p_partkey") % 200).alias("pr_id"), F.col("p_brand").alias("comp_id"))
    threads = t.table(spark, sf, "conversations").select((F.col("conv_id") % 200).alias("pr_id"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("entry_id"))
    lines = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pr_id"), (F.col("l_orderkey") % 10 == 0).alias("conflict"))
    return rp.overview(commits, comps, threads, lines)


FEED = "fe AS (SELECT sha, comp_id, entry_id, pos FROM s_touches JOIN s_comp_entries USING (entry_id))"


@query("feed_entries", with_views("s_touches s_comp_entries", FEED + "SELECT * FROM fe"))
def feed_entries(spark, sf):
    return rp.feed_entries(t.touches(spark, sf), t.comp_entries(spark, sf), NOKEY)


@query("feeds", with_views("s_touches s_comp_entries", FEED + "SELECT sha, comp_id, count(*) AS entries, arg_min(entry_id, pos) AS first_entry FROM fe GROUP BY ALL"))
def feeds(spark, sf):
    return rp.feeds(rp.feed_entries(t.touches(spark, sf), t.comp_entries(spark, sf), NOKEY), NOKEY)


def file_deltas(spark, sf):
    return t.file_paths(spark, sf).select("path", F.col("n_chars").alias("add"), (F.col("doc_id") % 9).alias("del"))


@query("file_tree", with_views("s_files", """
fs AS (SELECT path, string_split(path, '/') AS p, n_chars AS "add", doc_id % 9 AS del FROM s_files),
ds AS (SELECT list_slice(p, 1, k) AS seg, "add", del FROM fs, range(1, 10) r(k) WHERE k < len(p))
SELECT array_to_string(seg, '/') AS node, true AS is_dir, len(seg) - 1 AS depth, CAST(sum("add") AS BIGINT) AS "add", CAST(sum(del) AS BIGINT) AS del, count(*) AS files,
  array_to_string(['0' || x FOR x IN seg], '/') AS sort_key FROM ds GROUP BY seg
UNION ALL SELECT path, false, len(p) - 1, "add", del, 1, array_to_string(list_append(['0' || x FOR x IN list_slice(p, 1, len(p) - 1)], '1' || p[len(p)]), '/') FROM fs"""))
def file_tree(spark, sf):
    d = rp.file_tree(file_deltas(spark, sf), NOKEY)
    return d.withColumn("sort_key", F.array_join("sort_key", "/")).withColumn("depth", F.col("depth").cast("long"))


@query("dir_groups", with_views("s_files", """
SELECT array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') AS dir, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS "add", CAST(sum(doc_id % 9) AS BIGINT) AS del FROM s_files GROUP BY 1"""))
def dir_groups(spark, sf):
    return rp.dir_groups(file_deltas(spark, sf), NOKEY)


@query("component_rail", """WITH w AS (SELECT p_brand AS comp_id, p_partkey AS id, p_partkey % 10 < 4 AS changed FROM part),
s AS (SELECT comp_id, count(*) FILTER (changed) AS stops, count(*) FILTER (NOT changed) AS unchanged FROM w GROUP BY 1)
SELECT 'r' || k AS reviewer, comp_id, stops, (SELECT count(*) FROM w WHERE w.comp_id = s.comp_id AND changed AND (id + k) % 3 = 0) AS read, unchanged FROM s, range(3) r(k)""")
def component_rail(spark, sf):
    part = t.table(spark, sf, "part").select(F.lit(1).alias("pr_id"), F.col("p_brand").alias("comp_id"), F.col("p_partkey").alias("id"))
    walk, ctx = part.filter("id % 10 < 4"), part.filter("id % 10 >= 4")
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    marks = part.select("pr_id", "id", k).select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("reviewer"), "pr_id", "id", ((F.col("id") + F.col("k")) % 3 == 0).alias("read"))
    return rp.component_rail(walk, ctx, marks, marks).drop("pr_id")


ENTRY_PATHS = "SELECT DISTINCT l_partkey AS entry_id, l_suppkey AS path FROM lineitem"


@query("component_totals", with_views("s_diff_lines s_comp_entries", f"""
fd AS (SELECT path, count(*) FILTER (kind = 'add') AS a, count(*) FILTER (kind = 'del') AS d FROM s_diff_lines GROUP BY path),
cp AS (SELECT DISTINCT comp_id, path FROM ({ENTRY_PATHS}) JOIN s_comp_entries USING (entry_id))
SELECT comp_id, count(*) AS files, CAST(sum(a) AS BIGINT) AS "add", CAST(sum(d) AS BIGINT) AS del FROM cp JOIN fd USING (path) GROUP BY comp_id"""))
def component_totals(spark, sf):
    li = entry_lines(spark, sf)
    deltas = li.groupBy("path").agg(F.count_if(F.col("kind") == "add").alias("add"), F.count_if(F.col("kind") == "del").alias("del"))
    return rp.component_totals(deltas, li, t.comp_entries(spark, sf), NOKEY)


def entry_lines(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "del").otherwise("ctx")
    return t.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entry_id"), F.col("l_suppkey").alias("path"), kind.alias("kind"))


@query("file_objects", """SELECT l_suppkey AS path, l_partkey AS entry_id, any_value(p_brand) AS comp_id,
  count(*) FILTER (l_returnflag = 'A') AS "add", count(*) FILTER (l_returnflag = 'R') AS del FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def file_objects(spark, sf):
    return rp.file_objects(entry_lines(spark, sf), t.comp_entries(spark, sf), NOKEY)


@query("context_group", """WITH c AS (SELECT p_brand AS comp_id, p_partkey AS pos, 'f' || (p_partkey % 17) || '.ts' AS name FROM part WHERE p_partkey % 10 <> 0),
n AS (SELECT comp_id, name, min(pos) AS first_pos FROM c GROUP BY ALL),
g AS (SELECT comp_id, array_to_string(list_slice(list(name ORDER BY first_pos), 1, 3), ', ') AS names, greatest(count(*) - 3, 0) AS more_files FROM n GROUP BY comp_id)
SELECT comp_id, (SELECT count(*) FROM c WHERE c.comp_id = g.comp_id) AS objects, names, more_files FROM g""")
def context_group(spark, sf):
    c = t.comp_entries(spark, sf).filter("entry_id % 10 <> 0")
    c = c.withColumn("file", F.concat(F.lit("src/f"), (F.col("entry_id") % 17).cast("string"), F.lit(".ts")))
    return rp.context_group(c, NOKEY).withColumn("names", F.array_join("names", ", "))


@query("commit_dots", with_views("s_touches s_order_commits", "SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY ord) AS pos, band FROM s_touches JOIN s_order_commits USING (sha)"))
def commit_dots(spark, sf):
    from patchlore.operators.timeline import commits_of
    return rp.commit_dots(commits_of(t.order_commits(spark, sf), t.touches(spark, sf)), NOKEY)


@query("check_snapshot", with_views("s_check_runs", """
r AS (SELECT *, status = 'completed' AND coalesce(conclusion, 'none') NOT IN ('success', 'neutral', 'skipped') AS bad FROM s_check_runs)
SELECT pr_id, count(*) AS total, count(*) FILTER (bad) AS failing, count(*) FILTER (status <> 'completed') AS running,
  CASE WHEN bool_or(bad) THEN 'failing' WHEN bool_or(status <> 'completed') THEN 'running' ELSE 'passing' END AS state,
  coalesce(array_to_string(list_slice(list('check ' || run_id ORDER BY run_id) FILTER (bad), 1, 3), ', '), '') AS names FROM r GROUP BY pr_id"""))
def check_snapshot(spark, sf):
    runs = t.check_runs(spark, sf).withColumn("name", F.concat(F.lit("check "), F.col("run_id").cast("string")))
    return rp.check_snapshot(runs).withColumn("names", F.array_join("names", ", "))
