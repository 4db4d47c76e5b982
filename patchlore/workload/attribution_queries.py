"""Queries over line attribution, slices and threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlore.operators import attribution as at, identity as ids
from patchlore.session import cut
from patchlore.workload import tables as t
from patchlore.workload.registry import query
from patchlore.workload.symbol_queries import CLAMPED, clamped
from patchlore.workload.tables import with_views

NOKEY: list[str] = []


def lines(spark, sf):
    return cut(t.diff_lines(spark, sf).withColumnsRenamed({"old_no": "old", "new_no": "new"}), "lines")


def written(d):
    """Each commit's own lines; one commit in seventeen has lost them."""
    d = d.filter("by_sha % 17 <> 0")
    return d.select("path", F.col("by_sha").alias("sha"), (-F.col("by_sha")).alias("ord"), F.col("idx").alias("line_idx"), "kind", "text")


def blame(d):
    return d.filter("new IS NOT NULL AND idx % 3 = 0").select("path", F.col("new").alias("line"), F.col("by_sha").alias("sha"))


def commits(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sha"), (-F.col("o_orderkey")).alias("ord"), (F.col("o_orderkey") % 4 + 1).alias("band"))
    return o.withColumn("parents", F.when(F.col("sha") % 10 == 0, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p"))))


MATCH = """dl AS (SELECT path, idx, kind, text, old_no AS "old", new_no AS "new", by_sha FROM s_diff_lines),
wr AS (SELECT path, kind, text, by_sha AS sha,
   row_number() OVER (PARTITION BY path, kind, text ORDER BY by_sha DESC, idx) AS newest,
   row_number() OVER (PARTITION BY path, kind, text ORDER BY by_sha, idx DESC) AS oldest FROM dl WHERE by_sha % 17 <> 0),
ad AS (SELECT *, CASE WHEN idx % 3 = 0 THEN by_sha END AS blamed,
   row_number() OVER (PARTITION BY path, text, idx % 3 = 0 ORDER BY idx) AS nth FROM dl WHERE kind = 'add'),
de AS (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY idx) AS nth FROM dl WHERE kind = 'del'),
by_ AS (SELECT path, idx, blamed AS "by" FROM ad WHERE blamed IS NOT NULL
  UNION ALL SELECT ad.path, ad.idx, wr.sha FROM ad JOIN wr ON wr.path = ad.path AND wr.kind = 'add' AND wr.text = ad.text AND wr.newest = ad.nth WHERE blamed IS NULL
  UNION ALL SELECT de.path, de.idx, wr.sha FROM de JOIN wr ON wr.path = de.path AND wr.kind = 'del' AND wr.text = de.text AND wr.oldest = de.nth),
al AS (SELECT dl.*, CASE WHEN kind <> 'ctx' THEN coalesce(by_."by", (SELECT max(o_orderkey) FROM orders)) END AS "by" FROM dl LEFT JOIN by_ USING (path, idx))
"""


def attributed(spark, sf):
    d = lines(spark, sf)
    return at.attribute_lines(d, written(d), commits(spark, sf), blame(d), None, NOKEY)


@query("attribute_additions", with_views("s_diff_lines", MATCH + """SELECT by_.* FROM by_ JOIN dl USING (path, idx) WHERE kind = 'add'"""))
def attribute_additions(spark, sf):
    d = lines(spark, sf)
    return at.attribute_additions(d, written(d), blame(d), NOKEY)


@query("attribute_deletions", with_views("s_diff_lines", MATCH + """SELECT by_.* FROM by_ JOIN dl USING (path, idx) WHERE kind = 'del'"""))
def attribute_deletions(spark, sf):
    """Half of the commits removed lines under the file's old path."""
    d = lines(spark, sf)
    old = written(d).withColumn("path", F.when(F.col("sha") % 2 == 0, F.col("path") + 1000000).otherwise(F.col("path")))
    renames = d.select("path").distinct().withColumn("old_path", F.col("path") + 1000000)
    return at.attribute_deletions(d, old, renames, NOKEY)


@query("attribute_lines", with_views("s_diff_lines", MATCH + """SELECT path, idx, kind, "by" FROM al"""))
def attribute_lines(spark, sf):
    return attributed(spark, sf).select("path", "idx", "kind", "by")


@query("attribute_lines_by_request", with_views("s_diff_lines", MATCH + """
SELECT path % 3 AS pr_id, path, idx, kind,
  CASE WHEN kind <> 'ctx' THEN coalesce(by_."by", (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 3 = dl.path % 3)) END AS "by"
FROM dl LEFT JOIN by_ USING (path, idx)"""))
def attribute_lines_by_request(spark, sf):
    """Three requests, each with a newest commit of its own; half of the commits wrote under the files' old paths."""
    d = lines(spark, sf).withColumn("pr_id", F.col("path") % 3)
    old = F.when(F.col("sha") % 2 == 0, F.col("path") + 1000000).otherwise(F.col("path"))
    own = written(d).withColumn("pr_id", F.col("path") % 3).withColumn("path", old)
    renames = d.select("pr_id", "path").distinct().withColumn("old_path", F.col("path") + 1000000)
    made = commits(spark, sf).withColumn("pr_id", F.col("sha") % 3)
    got = at.attribute_lines(d.drop("by_sha", "old"), own, made, blame(d).withColumn("pr_id", F.col("path") % 3), renames)
    return got.select("pr_id", "path", "idx", "kind", "by")


@query("path_identity", """WITH RECURSIVE ev AS (SELECT o_custkey % 3 AS pr_id, concat('p', o_custkey % 40) AS old_path,
  CASE WHEN o_orderstatus <> 'P' THEN concat('p', o_orderkey * 7 % 40) END AS path, -o_orderkey AS ord FROM orders),
nx AS (SELECT e.*, n.ord AS next_ord FROM ev e ASOF LEFT JOIN ev n ON n.pr_id = e.pr_id AND n.old_path = e.path AND e.ord > n.ord),
wk AS (SELECT pr_id, old_path, ord, path AS head, next_ord FROM nx
  UNION ALL SELECT w.pr_id, w.old_path, w.ord, n.path, n.next_ord FROM wk w JOIN nx n ON n.pr_id = w.pr_id AND n.old_path = w.head AND n.ord = w.next_ord),
wr AS (SELECT DISTINCT l_partkey % 3 AS pr_id, concat('p', l_suppkey % 40) AS path, -l_orderkey AS ord FROM lineitem),
ws AS (SELECT wr.*, a.ord AS hit FROM wr ASOF LEFT JOIN ev a ON a.pr_id = wr.pr_id AND a.old_path = wr.path AND wr.ord > a.ord)
SELECT ws.pr_id, ws.path, ws.ord, CASE WHEN hit IS NULL THEN ws.path ELSE wk.head END AS head_path
FROM ws LEFT JOIN wk ON wk.pr_id = ws.pr_id AND wk.old_path = ws.path AND wk.ord = hit AND wk.next_ord IS NULL""")
def path_identity(spark, sf):
    """Each order renames or removes one of forty paths of a request; each line was written under a path of its time."""
    path = lambda c: F.concat(F.lit("p"), (c % 40).cast("string"))
    o = t.table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("pr_id"), path(F.col("o_custkey")).alias("old_path"),
                                            F.when(F.col("o_orderstatus") != "P", path(F.col("o_orderkey") * 7)).alias("path"), (-F.col("o_orderkey")).alias("ord"))
    li = t.table(spark, sf, "lineitem").select((F.col("l_partkey") % 3).alias("pr_id"), path(F.col("l_suppkey")).alias("path"), (-F.col("l_orderkey")).alias("ord"))
    return ids.head_paths(li, o)


@query("attribute_reused_paths", with_views("s_diff_lines", """dl AS (SELECT path, idx, kind, text, by_sha FROM s_diff_lines), hf AS (SELECT max(o_orderkey) // 2 AS h FROM orders),
dd AS (SELECT * FROM dl UNION ALL SELECT path + 1000000, idx, kind, text, by_sha FROM dl, hf WHERE by_sha >= h),
wr AS (SELECT path, text, by_sha AS sha, row_number() OVER (PARTITION BY path, text ORDER BY by_sha DESC, idx) AS nth FROM dd WHERE by_sha % 17 <> 0 AND kind = 'add'),
ad AS (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY idx) AS nth FROM dd WHERE kind = 'add')
SELECT ad.path, ad.idx, wr.sha AS "by" FROM ad JOIN wr USING (path, text, nth)"""))
def attribute_reused_paths(spark, sf):
    """Every file was renamed half-way; its old path was then used again by another file."""
    d = lines(spark, sf)
    half = t.table(spark, sf, "orders").agg(F.floor(F.max("o_orderkey") / 2).alias("h")).scalar()
    old = F.col("path") + 1000000
    reused = d.filter(F.col("by_sha") >= half).withColumn("path", old)
    first = written(d).withColumn("path", F.when(F.col("sha") < half, old).otherwise(F.col("path")))
    renames = d.select("path").distinct().select("path", old.alias("old_path"), (-half).alias("ord"))
    return at.attribute_additions(d.unionByName(reused), first.unionByName(written(reused)), None, NOKEY, renames)


STAMPED = MATCH + """,
sl AS (SELECT al.*, coalesce("by" % 10 = 0, false) AS conflict, CASE WHEN "by" % 10 <> 0 THEN "by" % 4 + 1 END AS band FROM al)
"""


def stamped(spark, sf):
    return at.stamp_lines(attributed(spark, sf), commits(spark, sf), NOKEY)


@query("stamp_bands", with_views("s_diff_lines", STAMPED + """SELECT path, idx, "by", conflict, band FROM sl"""))
def stamp_bands(spark, sf):
    return stamped(spark, sf).select("path", "idx", "by", "conflict", "band")


@query("conflict_lines", with_views("s_diff_lines", STAMPED + """SELECT path, count(*) AS conflict_lines FROM sl WHERE conflict GROUP BY path"""))
def conflict_lines(spark, sf):
    return stamped(spark, sf).filter("conflict").groupBy("path").agg(F.count("*").alias("conflict_lines"))


SLICED = CLAMPED + """,
hl AS (SELECT path, idx, kind, by_sha, text, old_no AS "old", new_no AS "new",
   coalesce(new_no, greatest(1, coalesce(max(new_no) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS head_line FROM s_diff_lines),
es AS (SELECT hl.path, hl.idx, any_value(kind) AS kind, any_value(by_sha) AS by_sha, any_value("old") AS "old", any_value("new") AS "new", arg_max(def_id, span_start * 1000000 + def_id) AS entry_id
   FROM hl JOIN c ON c.path = hl.path AND head_line BETWEEN span_start AND span_end GROUP BY 1, 2)
"""


def sliced(spark, sf, d):
    own = at.slice_by_span(d, clamped(spark, sf), ["path"])
    return cut(own.join(d, ["path", "idx"]), "slices")


@query("slice_by_span", with_views("s_diff_lines s_def_spans", SLICED + "SELECT path, idx, entry_id FROM es"))
def slice_by_span(spark, sf):
    return at.slice_by_span(lines(spark, sf), clamped(spark, sf), ["path"])


@query("touches", with_views("s_diff_lines s_def_spans", SLICED + "SELECT DISTINCT by_sha AS sha, entry_id FROM es WHERE kind <> 'ctx'"))
def touches(spark, sf):
    es = sliced(spark, sf, lines(spark, sf))
    return at.touches(es.withColumn("by", F.when(F.col("kind") != "ctx", F.col("by_sha"))), NOKEY)


def facts_input(spark, sf):
    li = t.table(spark, sf, "lineitem")
    folder = F.when(F.col("l_suppkey") % 25 == 3, "tests/f").otherwise("src/f")
    uses = li.select(F.col("l_partkey").alias("def_id"), F.concat(folder, F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("file"))
    kind = F.when(F.col("p_size") % 7 == 0, "interface").when(F.col("p_size") % 7 == 1, "typeAlias").otherwise("function")
    entries = t.table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), kind.alias("kind"), (F.col("p_partkey") % 10 == 0).alias("seed"))
    return entries, uses


FACTS = """us AS (SELECT l_partkey AS entry_id, CASE WHEN l_suppkey % 25 = 3 THEN 'tests/f' ELSE 'src/f' END || l_suppkey || '.ts' AS file FROM lineitem),
en AS (SELECT p_partkey AS entry_id, CASE p_size % 7 WHEN 0 THEN 'interface' WHEN 1 THEN 'typeAlias' ELSE 'function' END AS kind, p_partkey % 10 = 0 AS seed FROM part),
fa AS (SELECT entry_id, count(*) || ' references at head' AS relation, NULL AS file, false AS negative FROM us GROUP BY entry_id
  UNION ALL SELECT DISTINCT entry_id, 'covered by test', file, false FROM us WHERE starts_with(file, 'tests/')
  UNION ALL SELECT entry_id, 'no direct test references', NULL, true FROM en WHERE entry_id NOT IN (SELECT entry_id FROM us WHERE starts_with(file, 'tests/')))
"""


@query("trace_facts", f"WITH {FACTS} SELECT * FROM fa")
def trace_facts(spark, sf):
    return at.trace_facts(*facts_input(spark, sf), NOKEY)


@query("untested", f"WITH {FACTS} SELECT entry_id, kind FROM en WHERE seed AND kind = 'function' AND entry_id IN (SELECT entry_id FROM fa WHERE negative)")
def untested(spark, sf):
    entries, uses = facts_input(spark, sf)
    return at.untested(entries, at.trace_facts(entries, uses, NOKEY), NOKEY).select("entry_id", "kind")


@query("extra_files", f"WITH {FACTS} SELECT DISTINCT file AS path FROM fa WHERE file IS NOT NULL AND CAST(regexp_extract(file, '(\\d+)', 1) AS BIGINT) % 2 = 1")
def extra_files(spark, sf):
    entries, uses = facts_input(spark, sf)
    files = uses.select(F.col("file").alias("path")).distinct()
    owning = files.filter(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 2 == 0)
    return at.extra_files(at.trace_facts(entries, uses, NOKEY), owning, files, NOKEY)


def threads_of(spark, sf):
    return at.build_threads(t.comments(spark, sf), NOKEY, F.col("turn"))


@query("threads", with_views("s_comments", "SELECT c.id, coalesce(c.in_reply_to, c.id) AS thread_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS pos, c.author FROM s_comments c JOIN s_comments r ON r.id = c.conv_id * 1000"))
def threads(spark, sf):
    return threads_of(spark, sf).select("id", "thread_id", "pos", "author")


@query("assign_threads", with_views("s_diff_lines s_def_spans", SLICED + """,
rt AS (SELECT conv_id AS thread_id, conv_id * 7 % (SELECT count(*) FROM supplier) AS path, conv_id * 37 % 600 AS line FROM conversations WHERE turn = 0)
SELECT rt.*, es.entry_id FROM rt LEFT JOIN es ON es.path = rt.path AND es."new" = rt.line"""))
def assign_threads(spark, sf):
    return at.assign_threads(anchors(spark, sf), sliced(spark, sf, lines(spark, sf)), NOKEY).select("thread_id", "path", "line", "entry_id")


def anchors(spark, sf):
    c = t.table(spark, sf, "conversations").filter("turn = 0")
    return c.select(F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 7 % t.supplier_count(spark, sf)).alias("path"), (F.col("conv_id") * 37 % 600).alias("line"))


EV = """th AS (SELECT user_id, event_id AS thread_id, epoch_us(ts) AS created FROM events WHERE event_type = 'error'),
ve AS (SELECT user_id, epoch_us(ts) AS "at", event_id AS sha, 'v' || event_id AS text FROM events WHERE event_type = 'purchase')
"""


def thread_events(spark, sf):
    e = t.table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    threads_ = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("thread_id"), F.col("us").alias("created"))
    versions = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("at"), F.col("event_id").alias("sha"),
                                                          F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("text"))
    return threads_, versions


@query("stale_threads", f"""WITH {EV},
nw AS (SELECT user_id, max("at") AS "at", arg_max(sha, "at") AS sha, arg_max(text, "at") AS after FROM ve GROUP BY user_id)
SELECT th.user_id, th.thread_id, th.created, ve.text AS "before", nw.after, nw.sha, nw."at"
FROM th ASOF LEFT JOIN ve ON th.user_id = ve.user_id AND th.created >= ve."at" JOIN nw ON nw.user_id = th.user_id WHERE nw."at" > th.created""")
def stale_threads(spark, sf):
    return at.stale_threads(*thread_events(spark, sf), ["user_id"])


@query("thread_state", f"""WITH {EV},
nw AS (SELECT user_id, max("at") AS "at" FROM ve GROUP BY user_id)
SELECT thread_id, CASE WHEN thread_id % 11 = 0 THEN NULL WHEN thread_id % 7 = 0 THEN 'gone' WHEN nw."at" > created THEN 'stale' END AS state FROM th LEFT JOIN nw USING (user_id)""")
def thread_state(spark, sf):
    th, ve = thread_events(spark, sf)
    now = ve.groupBy("user_id").agg(F.max("at").alias("at"))
    created = F.when(F.col("thread_id") % 11 != 0, F.col("created"))
    d = th.join(now, "user_id", "left")
    return d.select("thread_id", at.thread_state(F.col("thread_id") % 7 != 0, created, F.col("at")).alias("state"))


LEFT = SLICED + """,
mb AS (SELECT p_partkey AS entry_id, p_brand AS comp_id FROM part),
cp AS (SELECT DISTINCT comp_id, path FROM es JOIN mb USING (entry_id)),
lo AS (SELECT cp.comp_id, hl.path, hl.idx, hl.kind FROM hl JOIN cp USING (path) WHERE hl.kind <> 'ctx' AND NOT EXISTS (
   SELECT 1 FROM es JOIN mb USING (entry_id) WHERE mb.comp_id = cp.comp_id AND es.path = hl.path AND es.idx = hl.idx))
"""


def leftovers(spark, sf, d):
    return at.leftover_lines(d, sliced(spark, sf, d), t.comp_entries(spark, sf), NOKEY)


@query("leftover_lines", with_views("s_diff_lines s_def_spans", LEFT + "SELECT comp_id, path, count(*) AS lines, min(idx) AS first_idx, count(*) FILTER (kind = 'add') AS \"add\" FROM lo GROUP BY ALL"))
def leftover_lines(spark, sf):
    d = leftovers(spark, sf, lines(spark, sf))
    return d.groupBy("comp_id", "path").agg(F.count("*").alias("lines"), F.min("idx").alias("first_idx"), F.count_if(F.col("kind") == "add").alias("add"))


@query("leftover_context", with_views("s_diff_lines s_def_spans", LEFT + """,
ky AS (SELECT DISTINCT comp_id, path, idx + k AS idx FROM lo, range(-2, 3) r(k))
SELECT comp_id, path, count(*) AS rows, count(*) FILTER (kind = 'add') AS "add", count(*) FILTER (kind = 'del') AS del FROM ky JOIN hl USING (path, idx) GROUP BY ALL"""))
def leftover_context(spark, sf):
    d = lines(spark, sf)
    w = at.context_window(leftovers(spark, sf, d), d, NOKEY)
    return w.groupBy("comp_id", "path").agg(F.count("*").alias("rows"), F.count_if(F.col("kind") == "add").alias("add"), F.count_if(F.col("kind") == "del").alias("del"))


def owned(spark, sf):
    d = lines(spark, sf)
    es = sliced(spark, sf, d)
    own = at.owner_of_lines(es.withColumn("entry_ord", F.col("entry_id")), NOKEY).select(
        "path", "kind", F.coalesce("old", F.lit(-1)).alias("_o"), F.coalesce("new", F.lit(-1)).alias("_n"), "owner")
    keyed = d.withColumn("_o", F.coalesce("old", F.lit(-1))).withColumn("_n", F.coalesce("new", F.lit(-1)))
    return keyed.join(own, ["path", "kind", "_o", "_n"], "left").drop("_o", "_n")


@query("owner_of_lines", with_views("s_diff_lines s_def_spans", SLICED + """SELECT hl.path, hl.idx, es.entry_id AS owner FROM hl LEFT JOIN es USING (path, idx)"""))
def owner_of_lines(spark, sf):
    return owned(spark, sf).select("path", "idx", "owner")


@query("owner_runs", with_views("s_diff_lines s_def_spans", SLICED + """,
ow AS (SELECT hl.path, hl.idx, es.entry_id AS owner FROM hl LEFT JOIN es USING (path, idx)),
gi AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx) - row_number() OVER (PARTITION BY path, owner ORDER BY idx) AS g FROM ow)
SELECT path, owner, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS rows FROM gi GROUP BY path, owner, g"""))
def owner_runs(spark, sf):
    return at.owner_runs(cut(owned(spark, sf), "owned"), ["path"]).drop("run")


STATS = SLICED + """,
st AS (SELECT p_brand AS comp_id, count(*) AS objects, coalesce(count(DISTINCT f), 0) AS folders, coalesce(CAST(sum(n) AS BIGINT), 0) AS changed_lines
  FROM part LEFT JOIN (SELECT entry_id, CAST(path % 10 AS VARCHAR) AS f, count(*) FILTER (kind <> 'ctx') AS n FROM es GROUP BY ALL) x ON entry_id = p_partkey GROUP BY p_brand)
"""


def comp_stats(spark, sf):
    es = sliced(spark, sf, lines(spark, sf))
    es = es.withColumn("path", F.concat((F.col("path") % 10).cast("string"), F.lit("/"), F.col("path").cast("string")))
    return at.component_stats(es, t.comp_entries(spark, sf), NOKEY)


@query("component_stats", with_views("s_diff_lines s_def_spans", STATS.replace("count(*) AS objects", "count(DISTINCT p_partkey) AS objects") + """
SELECT *, objects || ' object' || CASE objects WHEN 1 THEN '' ELSE 's' END || ' · ' || folders || ' folder' || CASE folders WHEN 1 THEN '' ELSE 's' END AS stats FROM st"""))
def component_stats(spark, sf):
    return comp_stats(spark, sf)


@query("initial_component", with_views("s_diff_lines s_def_spans", STATS + "SELECT comp_id FROM st ORDER BY changed_lines DESC, comp_id LIMIT 1"))
def initial_component(spark, sf):
    return at.initial_component(comp_stats(spark, sf), NOKEY)


@query("changed_files", with_views("s_files", "SELECT path FROM s_files"))
def changed_files(spark, sf):
    return at.changed_files(t.file_paths(spark, sf), NOKEY)


@query("file_stats", with_views("s_diff_lines", """
SELECT path, count(*) FILTER (kind = 'add') AS "add", count(*) FILTER (kind = 'del') AS del, array_to_string(list_sort(list(DISTINCT by_sha % 4 + 1)), ',') AS bands,
  (SELECT count(*) FROM part WHERE p_partkey % 70 = path) AS objects FROM s_diff_lines GROUP BY path"""))
def file_stats(spark, sf):
    li = t.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 4 + 1).alias("band"),
        F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "del").otherwise("ctx").alias("kind"))
    first = t.table(spark, sf, "part").select((F.col("p_partkey") % 70).alias("path"))
    return at.file_stats(li, first, NOKEY).withColumn("bands", F.array_join("bands", ","))
