"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlore.session import cut, new_path
from patchlore.sources import readers as rd, writers as wr
from patchlore.streaming import streams as st
from patchlore.workload import tables as t
from patchlore.workload.attribution_queries import lines
from patchlore.workload.diff_queries import patches
from patchlore.workload.registry import query
from patchlore.workload.review_queries import REVIEW, UNSENT, review_input, unsent
from patchlore.workload.tables import with_views
from patchlore.workload.timeline_queries import SWEEPS


@query("read_patches", """SELECT CAST(doc_id AS VARCHAR) AS pr_id, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id ELSE '' END AS sha,
  length(string_split(text, chr(10))) + 2 + CASE WHEN doc_id % 5 < 3 THEN 1 ELSE 0 END AS rows FROM documents""")
def read_patches(spark, sf):
    """Landed as a table, then read back."""
    p = patches(spark, sf).select(F.col("doc_id").alias("pr_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("sha"), "patch")
    path = new_path(spark, "patches")
    p.write.parquet(path)
    return rd.read_patches(spark, path).select("pr_id", "sha", F.size(F.split("patch", "\n", -1)).cast("long").alias("rows"))


@query("parse_commit_log", """SELECT event_id AS pr_id, k + 1 AS ord, event_id || '-' || k AS sha, CASE k WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS parents,
  CASE WHEN k < 2 THEN 'dev' || user_id ELSE '' END AS author, CASE WHEN k < 2 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS "at",
  CASE WHEN k < 2 THEN 'Mon' ELSE '' END AS day, CASE WHEN k = 0 THEN date_trunc('minute', ts) END AS ts, CASE WHEN k < 2 THEN event_type ELSE '' END AS message FROM events, range(3) r(k)""")
def parse_commit_log(spark, sf):
    """Three log rows per event: a full one, a merge without a time, and a bare sha."""
    e = t.table(spark, sf, "events")
    sha = lambda k: F.concat(F.col("event_id").cast("string"), F.lit(f"-{k}"))
    who, at = F.concat(F.lit("dev"), F.col("user_id").cast("string")), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    full = F.concat_ws("\t", sha(0), F.lit("p"), who, at, F.concat(F.lit("Mon|"), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("|x")), "event_type", F.lit("cut"))
    merge = F.concat_ws("\t", sha(1), F.lit("p q"), who, at, F.lit("Mon"), "event_type")
    log = F.concat(full, F.lit("\n\n"), merge, F.lit("\n"), sha(2), F.lit("\n"))
    d = rd.parse_commit_log(e.select(F.col("event_id").alias("pr_id"), log.alias("log")))
    return d.select("pr_id", "ord", "sha", F.size("parents").alias("parents"), "author", "at", "day", "ts", "message")


@query("read_comments", """SELECT conv_id AS pr_id, conv_id * 1000 + turn AS id, 'f.ts' AS path, CASE turn % 3 WHEN 0 THEN turn WHEN 1 THEN turn + 100 END AS line, '2024-01-01T00:00:00Z' AS created,
  CASE WHEN turn % 2 = 0 THEN role ELSE 'unknown' END AS author, CASE WHEN turn % 5 = 0 THEN '' ELSE text END AS body, CASE WHEN turn > 0 THEN conv_id * 1000 END AS in_reply_to FROM conversations""")
def read_comments(spark, sf):
    c, n = t.table(spark, sf, "conversations"), F.col("turn")
    one = F.struct((F.col("conv_id") * 1000 + n).alias("id"), F.lit("f.ts").alias("path"), F.when(n % 3 == 0, n).alias("line"), F.when(n % 3 < 2, n + 100).alias("original_line"),
                   F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.when(n % 2 == 0, F.struct(F.col("role").alias("login"))).alias("user"),
                   F.when(n % 5 != 0, F.col("text")).alias("body"), F.when(n > 0, F.col("conv_id") * 1000).alias("in_reply_to_id"))
    return rd.read_comments(c.select(F.col("conv_id").alias("pr_id"), F.to_json(F.array(one)).alias("payload")))


@query("read_check_runs", with_views("s_check_runs", "SELECT * FROM s_check_runs"))
def read_check_runs(spark, sf):
    r = t.check_runs(spark, sf)
    one = F.struct(F.col("run_id").alias("id"), F.lit("c").alias("name"), "status", "conclusion")
    d = rd.read_check_runs(r.select("pr_id", F.to_json(F.struct(F.array(one).alias("check_runs"))).alias("payload")))
    return d.drop("name")


PR_SPARK = "CASE WHEN o_orderkey % 3 > 0 THEN concat('sha', o_orderkey) END"


def pr_payloads(spark, sf):
    o = t.table(spark, sf, "orders")
    body = F.struct(F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.expr(PR_SPARK).alias("merge_commit_sha"),
                    F.struct(F.lit("main").alias("ref")).alias("base"), F.struct(F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("ref")).alias("head"))
    return o.select(F.lit("o/r").alias("repo"), F.when(F.col("o_orderkey") % 101 == 0, "not json").otherwise(F.to_json(body)).alias("payload"))


@query("read_prs", """SELECT 'o/r#' || o_orderkey AS pr_id, o_orderpriority AS title, 'main' AS base_ref, 'b' || o_custkey AS head_ref, 'sha' || o_orderkey AS merged_sha FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 101 <> 0""")
def read_prs(spark, sf):
    return rd.read_prs(pr_payloads(spark, sf))[0].select("pr_id", "title", "base_ref", "head_ref", "merged_sha")


@query("rejected_prs", """SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'unreadable payload' ELSE 'not merged (no merge commit)' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 101 = 0 GROUP BY 1""")
def rejected_prs(spark, sf):
    return rd.read_prs(pr_payloads(spark, sf))[1].groupBy("reason").agg(F.count("*").alias("n"))


SOURCE_PATH = """CASE doc_id % 5 WHEN 0 THEN concat('src/node_modules/', path) WHEN 1 THEN concat('.git/', path) WHEN 2 THEN concat(path, 'x') WHEN 3 THEN concat(path, '.md') ELSE path END"""


@query("source_files", with_views("s_files", f"SELECT doc_id, {SOURCE_PATH} AS path FROM s_files WHERE doc_id % 5 IN (2, 4)"))
def source_files(spark, sf):
    f = t.file_paths(spark, sf).select("doc_id", F.expr(SOURCE_PATH).alias("path"))
    return rd.source_files(f)


def dataset(spark, sf):
    """Ten requests of the diff lines; documents are split into parts on purpose."""
    d = lines(spark, sf).withColumn("pr_id", (F.col("path") % 10).cast("string")).withColumn("path", F.concat(F.lit("f"), F.col("path").cast("string")))
    d = d.select("pr_id", "path", "idx", "kind", "old", "new", "text", F.col("by_sha").cast("string").alias("by"))
    files = d.select("pr_id", "path").distinct().select("pr_id", "path", F.lit(None).cast("string").alias("old_path"), F.lit("d").alias("delta"))
    prs = d.select("pr_id").distinct().select("pr_id", F.lit("o/r").alias("repo"), F.col("pr_id").alias("number"), F.concat(F.lit("t"), "pr_id").alias("title"), F.lit("headsha9").alias("merged_sha"))
    o = t.table(spark, sf, "orders")
    commits = o.select((F.col("o_orderkey") % 10).cast("string").alias("pr_id"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_custkey").alias("ord"),
                       F.when(F.col("o_orderkey") % 10 == 3, 2).otherwise(F.col("o_custkey") % 4 + 1).cast("long").alias("band"))
    return {"prs": prs, "files": files, "diff_lines": d, "commits": commits}


def written(spark, sf):
    path = new_path(spark, "dataset")
    wr.write_dataset(dataset(spark, sf), path, part_rows=2000, slice_rows=100)
    return path


@query("dataset_roundtrip", with_views("s_diff_lines", """SELECT CAST(path % 10 AS VARCHAR) AS pr_id, 'f' || path AS path, idx, kind, old_no AS "old", new_no AS "new", text, CAST(by_sha AS VARCHAR) AS "by" FROM s_diff_lines"""))
def dataset_roundtrip(spark, sf):
    return rd.read_dataset(spark, written(spark, sf))["diff_lines"].drop("band", "conflict")


RECENT = """SELECT CAST(p AS VARCHAR) AS pr_id, 'o/r' AS repo, CAST(p AS VARCHAR) AS number, 't' || p AS title, count(*) AS commits,
  array_to_string(list_sort(list(DISTINCT CASE WHEN p = 3 THEN 2 ELSE o_custkey % 4 + 1 END)), ',') AS bands FROM (SELECT *, o_orderkey % 10 AS p FROM orders) GROUP BY p"""


@query("recent_datasets", RECENT)
def recent_datasets(spark, sf):
    d = rd.recent_datasets(spark, written(spark, sf))
    return d.withColumn("bands", F.array_join("bands", ",")).drop("mtime")


@query("batch_rebuild", """SELECT CAST(p AS VARCHAR) AS pr_id, CASE WHEN p = 4 THEN 't4' WHEN p < 5 THEN 'again' ELSE 't' || p END AS title, CASE WHEN p IN (0, 2) THEN 'main' END AS base_ref FROM range(10) r(p)
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey % 10 = p)""")
def batch_rebuild(spark, sf):
    """Five of ten requests are built again but one of them is not listed; odd ones disagree with upstream."""
    tables = dataset(spark, sf)
    path = new_path(spark, "rebuild")
    wr.write_dataset(tables, path, slice_rows=100)
    again = {k: v.filter("pr_id < 4") for k, v in tables.items()}
    ref = lambda c: F.lit(None).cast("string").alias(c)
    again["prs"] = again["prs"].withColumn("title", F.lit("again")).select("*", ref("base_ref"), ref("head_ref"), ref("head_label"))
    up = again["prs"].select("pr_id", F.when(F.col("pr_id") % 2 == 0, "headsha9").otherwise("othersha").alias("merge_sha"), F.lit("main").alias("base_ref"), F.lit("b").alias("head_ref"), F.lit("o:b").alias("head_label"))
    wr.batch_rebuild(again, up, path)
    return rd.read_dataset(spark, path)["prs"].select("pr_id", "title", "base_ref")


@query("export_outbox", with_views("s_comments", UNSENT + """
SELECT pr_id, 'reply' AS what, count(*) AS n FROM us WHERE is_reply GROUP BY 1
UNION ALL SELECT pr_id, 'review', (count(*) + 6) // 7 FROM us WHERE NOT is_reply GROUP BY 1"""))
def export_outbox(spark, sf):
    from patchlore.operators.review import review_payload
    items = cut(unsent(spark, sf), "unsent")
    path = new_path(spark, "outbox")
    for _ in range(2):  # a second run adds nothing
        wr.export_outbox(review_payload(items, part_rows=7), items, path)
    return spark.read.parquet(path).groupBy("pr_id", "what").agg(F.count("*").alias("n"))


def event_stream(spark, sf):
    schema = t.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("sweeps_stream", with_views("s_commits", SWEEPS + "SELECT pr_id, CAST(min(ts) AS DATE) AS day, min(ts) AS first_ts, count(*) AS commits FROM sw GROUP BY pr_id, sweep"))
def sweeps_stream(spark, sf):
    """Complete mode, so that sweeps still open at the end of the input are shown too."""
    c = event_stream(spark, sf).select(F.col("user_id").alias("pr_id"), F.col("ts"))
    out = spark.read.parquet(st.run_available(st.sweeps_stream(c), "complete", "sweeps"))
    newest = out.agg(F.max("batch").alias("m")).scalar()
    return out.filter(F.col("batch") == newest).drop("batch").withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz"))


@query("review_ageing_stream", f"WITH {REVIEW} SELECT reviewer, pr_id, id, reviewed_at, fresh FROM fr WHERE fresh > 0")
def review_ageing_stream(spark, sf):
    x = review_input(spark, sf)
    keep = x["ids"].select("pr_id", "id")
    states, seen = cut(x["states"], "states"), cut(x["seen"], "seen")
    n = F.col("event_id") % 12
    pushes = event_stream(spark, sf).select(
        F.col("user_id").alias("pr_id"), F.col("event_id").alias("by"),
        F.when(F.col("event_type") == "view", "ctx").when(F.col("event_type") == "error", "del").otherwise("add").alias("kind"),
        F.when((n == 11) & (F.col("user_id") % 3 == 0), "rest:c0").otherwise(F.concat(F.lit("e"), n.cast("string"))).alias("id"))
    out = spark.read.parquet(st.run_available(st.review_ageing_stream(pushes, states, seen), "update", "ageing"))
    now = st.latest(out, ["reviewer", "pr_id", "id", "reviewed_at"])
    return now.join(keep, ["pr_id", "id"], "left_semi")


@query("outbox_stream", "SELECT DISTINCT user_id AS pr_id, event_id % 40 AS id FROM events")
def outbox_stream(spark, sf):
    """Ids repeat often; the month of input lies within the lateness bound."""
    items = event_stream(spark, sf).select(F.col("user_id").alias("pr_id"), (F.col("event_id") % 40).alias("id"), "ts")
    return spark.read.parquet(st.run_available(st.outbox_stream(items, late="40 days"), "append", "outbox")).select("pr_id", "id")
