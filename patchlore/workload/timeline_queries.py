"""Queries over commits, sweeps and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlore.functions.times import is_stale_writer
from patchlore.operators import diff, timeline as tl
from patchlore.workload import tables as t
from patchlore.workload.registry import query
from patchlore.workload.tables import with_views

SWEEPS = """
g AS (SELECT *, lag(ts) OVER (PARTITION BY pr_id ORDER BY ord DESC) AS was FROM s_commits),
sw AS (SELECT pr_id, sha, ts, author, message, ord,
       CAST(sum(CASE WHEN was IS NULL OR CAST(was AS DATE) <> CAST(ts AS DATE) OR ts - was > INTERVAL 2 HOUR THEN 1 ELSE 0 END)
       OVER (PARTITION BY pr_id ORDER BY ord DESC) AS BIGINT) AS sweep FROM g),
bd AS (SELECT *, CASE WHEN max(sweep) OVER (PARTITION BY pr_id) <= 4 THEN sweep
       ELSE least(4, ((sweep - 1) * 4) // max(sweep) OVER (PARTITION BY pr_id) + 1) END AS band FROM sw)
"""


@query("sweep_ids", with_views("s_commits", SWEEPS + "SELECT pr_id, sha, ord, sweep FROM sw"))
def sweep_ids(spark, sf):
    return tl.sweep_ids(t.commits(spark, sf)).select("pr_id", "sha", "ord", "sweep")


@query("sweep_bands", with_views("s_commits", SWEEPS + "SELECT pr_id, sha, sweep, band FROM bd"))
def sweep_bands(spark, sf):
    return tl.sweep_bands(tl.sweep_ids(t.commits(spark, sf))).select("pr_id", "sha", "sweep", "band")


@query("order_bands", with_views("s_commits", """
SELECT pr_id, sha, least(3, ((count(*) OVER (PARTITION BY pr_id) - ord) * 4) // count(*) OVER (PARTITION BY pr_id)) + 1 AS band FROM s_commits"""))
def order_bands(spark, sf):
    return tl.order_bands(t.commits(spark, sf)).select("pr_id", "sha", "band")


@query("commit_bands", with_views("s_commits", SWEEPS + """
, ob AS (SELECT pr_id, sha, least(3, ((count(*) OVER (PARTITION BY pr_id) - ord) * 4) // count(*) OVER (PARTITION BY pr_id)) + 1 AS band FROM s_commits)
SELECT bd.pr_id, bd.sha, CASE WHEN bd.pr_id % 5 = 0 THEN ob.band ELSE bd.band END AS band FROM bd JOIN ob USING (pr_id, sha)"""))
def commit_bands(spark, sf):
    """Every fifth group has lost its times and falls back to commit order."""
    c = t.commits(spark, sf).withColumn("ts", F.when(F.col("pr_id") % 5 != 0, F.col("ts")))
    return tl.commit_bands(c).select("pr_id", "sha", "band")


@query("band_ranges", with_views("s_commits", SWEEPS + """
, lost AS (SELECT * REPLACE (CASE WHEN sha % 997 <> 0 THEN ts END AS ts) FROM bd WHERE NOT starts_with(message, 'Merge branch'))
SELECT pr_id, band, min(ts) AS first_ts, max(ts) AS last_ts,
  CASE WHEN date_trunc('minute', min(ts)) = date_trunc('minute', max(ts)) THEN strftime(min(ts), '%b %-d · %H:%M')
       WHEN CAST(min(ts) AS DATE) = CAST(max(ts) AS DATE) THEN strftime(min(ts), '%b %-d · %H:%M') || '–' || strftime(max(ts), '%H:%M')
       ELSE strftime(min(ts), '%b %-d %H:%M') || ' → ' || strftime(max(ts), '%b %-d %H:%M') END AS label
FROM lost WHERE pr_id NOT IN (SELECT pr_id FROM lost WHERE ts IS NULL) GROUP BY pr_id, band"""))
def band_ranges(spark, sf):
    c = tl.sweep_bands(tl.sweep_ids(t.commits(spark, sf)))
    return tl.band_ranges(c.withColumn("ts", F.when(F.col("sha") % 997 != 0, F.col("ts"))))


@query("stale_writers", """SELECT event_id, coalesce(epoch(ts) > epoch(TIMESTAMP '2024-01-15 12:00:00') AND event_type <> 'view', false) AS stale FROM events""")
def stale_writers(spark, sf):
    e = t.table(spark, sf, "events")
    made = F.when(F.col("event_type") == "view", "not a date").otherwise("2024-01-15T12:00:00Z")
    return e.select("event_id", is_stale_writer(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, made).alias("stale"))


TOUCHED = "tc AS (SELECT * FROM s_touches JOIN s_order_commits USING (sha))"


def touched(spark, sf):
    return tl.commits_of(t.order_commits(spark, sf), t.touches(spark, sf))


@query("commits_of", with_views("s_touches s_order_commits", TOUCHED + "SELECT entry_id, count(*) AS commits, min(ord) AS newest, max(ord) AS oldest FROM tc GROUP BY entry_id"))
def commits_of(spark, sf):
    return touched(spark, sf).groupBy("entry_id").agg(F.count("*").alias("commits"), F.min("ord").alias("newest"), F.max("ord").alias("oldest"))


@query("introducers", with_views("s_touches s_order_commits", TOUCHED + """
SELECT entry_id, sha AS introducer, band FROM tc WHERE NOT starts_with(message, 'Merge branch')
QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY band, ord DESC) = 1"""))
def introducers(spark, sf):
    return tl.introducer_of(touched(spark, sf))


@query("node_band", with_views("s_touches s_order_commits s_comp_entries", TOUCHED + """
SELECT entry_id, (SELECT min(band) FROM tc WHERE tc.entry_id = e.entry_id AND NOT starts_with(message, 'Merge branch')) AS node_band
FROM s_comp_entries e"""))
def node_band(spark, sf):
    return tl.node_band(t.comp_entries(spark, sf).select("entry_id"), touched(spark, sf))


@query("file_bands", with_views("s_diff_lines", "SELECT path, array_to_string(list_sort(list(DISTINCT by_sha % 4 + 1)), ',') AS bands FROM s_diff_lines GROUP BY path"))
def file_bands(spark, sf):
    li = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 4 + 1).alias("band"))
    return tl.file_bands(li, ["path"]).select("path", F.array_join("bands", ",").alias("bands"))


@query("day_groups", with_views("s_commits", """
r AS (SELECT *, strftime(ts, '%a') AS day FROM s_commits WHERE NOT starts_with(message, 'Merge branch')),
m AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY ord) - row_number() OVER (PARTITION BY pr_id, day ORDER BY ord) AS isl FROM r)
SELECT pr_id, day, count(*) AS commits, min(ord) AS first_ord, max(ord) AS last_ord FROM m GROUP BY pr_id, day, isl"""))
def day_groups(spark, sf):
    return tl.day_groups(t.commits(spark, sf), day=F.date_format("ts", "EEE")).drop("run")


STORY = TOUCHED + """,
st AS (SELECT comp_id, sha, max(band) AS band, row_number() OVER (PARTITION BY comp_id ORDER BY max(ord) DESC) - 1 AS step
       FROM tc JOIN s_comp_entries USING (entry_id) WHERE NOT starts_with(message, 'Merge branch') GROUP BY comp_id, sha),
lit AS (SELECT comp_id, entry_id, min(step) AS step FROM s_touches JOIN s_comp_entries USING (entry_id) JOIN st USING (comp_id, sha) GROUP BY ALL)
"""


@query("story_replay", with_views("s_touches s_order_commits s_comp_entries", STORY + "SELECT comp_id, entry_id, step, st.band FROM lit JOIN st USING (comp_id, step)"))
def story_replay(spark, sf):
    return tl.story_replay(touched(spark, sf), t.comp_entries(spark, sf))


def _story_edges(spark, sf):
    comp = t.comp_entries(spark, sf).select(F.col("entry_id").alias("a"), "comp_id")
    inner = t.edges(spark, sf).join(comp, "a").join(comp.withColumnRenamed("a", "b"), ["b", "comp_id"])
    return tl.story_edges(tl.story_replay(touched(spark, sf), t.comp_entries(spark, sf)), inner)


INNER = """, ie AS (SELECT x.comp_id, e.a, e.b FROM s_edges e JOIN s_comp_entries x ON x.entry_id = e.a JOIN s_comp_entries y ON y.entry_id = e.b AND x.comp_id = y.comp_id)"""


@query("story_edges", with_views("s_touches s_order_commits s_comp_entries s_edges", STORY + INNER + """
SELECT ie.comp_id, ie.a, ie.b, CASE WHEN la.step IS NOT NULL AND lb.step IS NOT NULL THEN greatest(la.step, lb.step) END AS on_step
FROM ie LEFT JOIN lit la ON la.entry_id = ie.a AND la.comp_id = ie.comp_id LEFT JOIN lit lb ON lb.entry_id = ie.b AND lb.comp_id = ie.comp_id"""))
def story_edges(spark, sf):
    return _story_edges(spark, sf).select("comp_id", "a", "b", "on_step")


@query("story_near", with_views("s_touches s_order_commits s_comp_entries s_edges", STORY + INNER + """,
nb AS (SELECT comp_id, a AS me, b AS other FROM ie UNION SELECT comp_id, b, a FROM ie),
f AS (SELECT nb.comp_id, nb.me AS entry_id, min(lo.step) AS near_from, min(lm.step) AS near_until FROM nb
      LEFT JOIN lit lo ON lo.entry_id = nb.other AND lo.comp_id = nb.comp_id LEFT JOIN lit lm ON lm.entry_id = nb.me AND lm.comp_id = nb.comp_id GROUP BY 1, 2)
SELECT * FROM f WHERE near_from IS NOT NULL AND (near_until IS NULL OR near_from < near_until)"""))
def story_near(spark, sf):
    return tl.story_near(_story_edges(spark, sf))
