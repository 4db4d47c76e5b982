"""Queries over review state, thread placement and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlore.operators import review as rv
from patchlore.session import cut
from patchlore.workload import tables as t
from patchlore.workload.attribution_queries import anchors, lines, threads_of
from patchlore.workload.registry import query
from patchlore.workload.tables import with_views

NOKEY: list[str] = []

# Review stand-in: users are change requests, events are commits that each wrote
# one line of entry e<event % 12>; e11 stands for the leftovers of every third one.
REVIEW = """ev AS (SELECT user_id AS pr_id, event_id AS sha, ts, CASE WHEN event_type = 'signup' THEN 'Merge branch main' ELSE event_type END AS message,
  CASE event_type WHEN 'view' THEN 'ctx' WHEN 'error' THEN 'del' ELSE 'add' END AS kind, event_id % 12 AS n,
  CASE WHEN event_id % 12 = 11 AND user_id % 3 = 0 THEN 'rest:c0' ELSE 'e' || (event_id % 12) END AS id FROM events),
ids AS (SELECT DISTINCT pr_id, id FROM ev WHERE n < 9 OR id = 'rest:c0'),
rk AS (SELECT DISTINCT user_id AS pr_id, 'r' || k AS reviewer, k FROM events, range(3) r(k)),
stt AS (SELECT reviewer, k, pr_id, CASE WHEN (pr_id + k) % 5 = 0 THEN 0 ELSE 1 END AS reviewed_at FROM rk WHERE (pr_id + k) % 4 <> 0),
seen AS (SELECT reviewer, ev.pr_id, CASE WHEN ev.pr_id % 6 = 0 AND sha % 5 <> 0 THEN sha + 1000000 ELSE sha END AS sha FROM ev JOIN stt USING (pr_id)
  WHERE NOT starts_with(message, 'Merge branch') AND CASE k WHEN 0 THEN ts < TIMESTAMP '2024-01-16' WHEN 1 THEN ts < TIMESTAMP '2024-01-24' ELSE sha % 4 = 0 END),
rd AS (SELECT reviewer, ids.pr_id, id FROM ids JOIN stt USING (pr_id) WHERE (length(id) + ascii(right(id, 1)) + k) % 3 <> 0),
fr AS (SELECT stt.reviewer, ids.pr_id, ids.id, reviewed_at, CASE WHEN reviewed_at = 0 THEN 0 ELSE
   (SELECT count(*) FROM ev WHERE ev.pr_id = ids.pr_id AND ev.id = ids.id AND ev.kind <> 'ctx' AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.reviewer = stt.reviewer AND seen.pr_id = ev.pr_id AND seen.sha = ev.sha)) END AS fresh
   FROM ids JOIN stt USING (pr_id)),
ir AS (SELECT fr.*, (reviewed_at = 0 OR fresh = 0) AND EXISTS (SELECT 1 FROM rd WHERE rd.reviewer = fr.reviewer AND rd.pr_id = fr.pr_id AND rd.id = fr.id) AS read FROM fr)
"""


def review_input(spark, sf):
    e = t.table(spark, sf, "events")
    n = F.col("event_id") % 12
    ev = e.select(F.col("user_id").alias("pr_id"), F.col("event_id").alias("sha"), "ts",
                  F.when(F.col("event_type") == "signup", "Merge branch main").otherwise(F.col("event_type")).alias("message"),
                  F.when(F.col("event_type") == "view", "ctx").when(F.col("event_type") == "error", "del").otherwise("add").alias("kind"), n.alias("n"),
                  F.when((n == 11) & (F.col("user_id") % 3 == 0), "rest:c0").otherwise(F.concat(F.lit("e"), n.cast("string"))).alias("id"),
                  F.col("event_id").alias("by"))
    entries = ev.filter("id not like 'rest:%'").select("pr_id", F.col("id").alias("entry_id"), (F.col("n") < 9).alias("seed")).distinct()
    left = ev.filter("id like 'rest:%'").select("pr_id", F.lit("c0").alias("comp_id")).distinct()
    ids = rv.reviewable_ids(entries, left)
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    rk = ev.select("pr_id").distinct().select("pr_id", k).withColumn("reviewer", F.concat(F.lit("r"), F.col("k").cast("string")))
    states = rk.filter("(pr_id + k) % 4 <> 0").withColumn("reviewed_at", F.when((F.col("pr_id") + F.col("k")) % 5 == 0, 0).otherwise(1))
    took = ev.filter("message not like 'Merge branch%'").join(states, "pr_id")
    took = took.filter(F.when(F.col("k") == 0, F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
                       .when(F.col("k") == 1, F.col("ts") < F.lit("2024-01-24").cast("timestamp_ntz")).otherwise(F.col("sha") % 4 == 0))
    seen = took.select("reviewer", "pr_id", F.when((F.col("pr_id") % 6 == 0) & (F.col("sha") % 5 != 0), F.col("sha") + 1000000).otherwise(F.col("sha")).alias("sha"))
    read = ids.join(states, "pr_id").filter((F.length("id") + F.ascii(F.right("id", F.lit(1))) + F.col("k")) % 3 != 0).select("reviewer", "pr_id", "id")
    counts = rv.written_counts(ev)
    return dict(ev=ev, ids=ids, reviewers=rk.select("reviewer", "pr_id"), states=states.select("reviewer", "pr_id", "reviewed_at"),
                seen=seen, read=read, counts=counts, entries=entries)


def mine(x):
    return x["counts"].join(x["ids"], ["pr_id", "id"], "left_semi")


@query("reviewable_ids", f"WITH {REVIEW} SELECT pr_id, id FROM ids")
def reviewable_ids(spark, sf):
    return review_input(spark, sf)["ids"]


@query("mark_reviewed", f"""WITH {REVIEW} SELECT 'seen' AS what, reviewer, pr_id, CAST(sha AS VARCHAR) AS id FROM ev JOIN stt USING (pr_id) WHERE NOT starts_with(message, 'Merge branch')
UNION ALL SELECT 'read', reviewer, pr_id, id FROM ids JOIN stt USING (pr_id)""")
def mark_reviewed(spark, sf):
    x = review_input(spark, sf)
    seen, read = rv.mark_reviewed(x["states"], x["ev"], x["ids"])
    a = seen.select(F.lit("seen").alias("what"), "reviewer", "pr_id", F.col("sha").cast("string").alias("id"))
    return a.unionByName(read.select(F.lit("read").alias("what"), "reviewer", "pr_id", "id"))


@query("new_since_checkpoint", f"WITH {REVIEW} SELECT reviewer, pr_id, id, fresh FROM fr")
def new_since_checkpoint(spark, sf):
    x = review_input(spark, sf)
    return rv.new_since_checkpoint(x["ids"], mine(x), x["states"], x["seen"]).drop("reviewed_at")


@query("is_read", f"WITH {REVIEW} SELECT reviewer, pr_id, id, read FROM ir")
def is_read(spark, sf):
    x = review_input(spark, sf)
    fresh = rv.new_since_checkpoint(x["ids"], mine(x), x["states"], x["seen"])
    return rv.is_read(fresh, x["read"]).select("reviewer", "pr_id", "id", "read")


@query("read_state", """WITH lg AS (SELECT user_id AS pr_id, event_id AS "at", CASE WHEN event_id % 50 = 0 THEN 'reset' WHEN event_id % 50 < 3 THEN 'mark' ELSE 'toggle' END AS action, 'e' || (event_id % 12) AS id FROM events),
la AS (SELECT pr_id, max("at") AS "at", arg_max(action, "at") AS action FROM lg WHERE action <> 'toggle' GROUP BY pr_id),
ids AS (SELECT DISTINCT pr_id, id FROM lg WHERE id < 'e5'),
tg AS (SELECT lg.pr_id, lg.id, count(*) % 2 = 1 AS odd FROM lg LEFT JOIN la USING (pr_id) WHERE lg.action = 'toggle' AND (la."at" IS NULL OR lg."at" > la."at") GROUP BY ALL),
ba AS (SELECT ids.* FROM ids JOIN la USING (pr_id) WHERE la.action = 'mark')
SELECT coalesce(tg.pr_id, ba.pr_id) AS pr_id, coalesce(tg.id, ba.id) AS id, coalesce(odd, false) <> (ba.id IS NOT NULL) AS read FROM tg FULL JOIN ba ON tg.pr_id = ba.pr_id AND tg.id = ba.id""")
def read_state(spark, sf):
    r = F.col("event_id") % 50
    log = t.table(spark, sf, "events").select(
        F.col("user_id").alias("pr_id"), F.col("event_id").alias("at"),
        F.when(r == 0, "reset").when(r < 3, "mark").otherwise("toggle").alias("action"), F.concat(F.lit("e"), (F.col("event_id") % 12).cast("string")).alias("id"))
    ids = log.filter("id < 'e5'").select("pr_id", "id").distinct()
    marked = log.filter("action = 'mark'").select("pr_id", "at").join(ids, "pr_id")
    return rv.read_state(log, marked, ["pr_id"])


@query("new_line_count", f"""WITH {REVIEW}, nl AS (SELECT reviewer, ev.pr_id, ev.id FROM ev JOIN stt USING (pr_id) WHERE kind = 'add' AND NOT EXISTS
  (SELECT 1 FROM seen WHERE seen.reviewer = stt.reviewer AND seen.pr_id = ev.pr_id AND seen.sha = ev.sha))
SELECT reviewer, pr_id, id, count(*) AS new_lines FROM nl GROUP BY ALL UNION ALL SELECT reviewer, pr_id, NULL, count(*) FROM nl GROUP BY ALL""")
def new_line_count(spark, sf):
    x = review_input(spark, sf)
    per_id = rv.new_line_count(x["counts"], x["states"], x["seen"])
    whole = rv.new_line_count(x["counts"], x["states"], x["seen"], per_id=False)
    return per_id.unionByName(whole.withColumn("id", F.lit(None).cast("string")))


REWRITTEN = REVIEW + """,
rw AS (SELECT stt.reviewer, stt.pr_id, (SELECT count(*) FROM seen s WHERE s.reviewer = stt.reviewer AND s.pr_id = stt.pr_id) AS seen,
  (SELECT count(*) FROM seen s JOIN ev ON ev.pr_id = s.pr_id AND ev.sha = s.sha WHERE s.reviewer = stt.reviewer AND s.pr_id = stt.pr_id) AS known FROM stt),
rs AS (SELECT *, seen > 0 AND known < 0.3 * seen AS rewritten FROM rw)
"""


@query("branch_rewritten", f"WITH {REWRITTEN} SELECT * FROM rs")
def branch_rewritten(spark, sf):
    x = review_input(spark, sf)
    return rv.branch_rewritten(x["states"], x["seen"], x["ev"])


@query("review_summary", f"""WITH {REWRITTEN},
a AS (SELECT pr_id, count(*) AS commits FROM ev WHERE NOT starts_with(message, 'Merge branch') GROUP BY pr_id),
b AS (SELECT pr_id, count(*) AS ids FROM ids GROUP BY pr_id),
c AS (SELECT reviewer, pr_id, count(*) FILTER (NOT read) AS unread, count(*) FILTER (fresh > 0) AS back FROM ir GROUP BY ALL),
d AS (SELECT reviewer, pr_id, count(*) FILTER (NOT starts_with(message, 'Merge branch')) AS since, count(*) FILTER (kind = 'add') AS new_lines FROM ev JOIN stt USING (pr_id)
   WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.reviewer = stt.reviewer AND seen.pr_id = ev.pr_id AND seen.sha = ev.sha) GROUP BY ALL),
j AS (SELECT rk.reviewer, rk.pr_id, commits, coalesce(ids, 0) AS ids, rs.rewritten, coalesce(unread, 0) AS unread, coalesce(back, 0) AS back, coalesce(since, 0) AS since, coalesce(new_lines, 0) AS new_lines, rs.seen
   FROM rk JOIN a USING (pr_id) LEFT JOIN b USING (pr_id) LEFT JOIN rs USING (reviewer, pr_id) LEFT JOIN c USING (reviewer, pr_id) LEFT JOIN d USING (reviewer, pr_id))
SELECT reviewer, pr_id, commits, ids, CASE WHEN seen IS NULL THEN 'none' WHEN rewritten THEN 'rewritten' WHEN since > 0 THEN 'new' WHEN unread > 0 THEN 'unread' ELSE 'read' END AS status, unread, back, since, new_lines FROM j""")
def review_summary(spark, sf):
    x = review_input(spark, sf)
    return rv.review_summary(x["reviewers"], x["states"], x["seen"], x["read"], x["ev"], x["ids"], mine(x), x["counts"])


WALK = """wt AS (SELECT l_partkey AS entry_id, count(*) AS weight FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
wk AS (SELECT comp_id, id, row_number() OVER (PARTITION BY comp_id ORDER BY r, weight DESC, pos) AS pos FROM (
  SELECT p_brand AS comp_id, CAST(p_partkey AS VARCHAR) AS id, 0 AS r, coalesce(weight, 0) AS weight, p_partkey AS pos FROM part LEFT JOIN wt ON entry_id = p_partkey WHERE p_partkey % 10 = 0
  UNION ALL SELECT DISTINCT p_brand, 'rest:' || p_brand, 1, 0, 0 FROM part WHERE p_brand LIKE '%2'))
"""


def walk(spark, sf):
    li = t.table(spark, sf, "lineitem").filter("l_returnflag <> 'N'")
    weights = li.groupBy(F.col("l_partkey").alias("entry_id")).agg(F.count("*").alias("weight"))
    members = t.comp_entries(spark, sf)
    entries = members.select("entry_id", (F.col("entry_id") % 10 == 0).alias("seed"))
    return rv.walk_order(members, entries, weights, members.filter("comp_id like '%2'").select("comp_id"), NOKEY)


@query("walk_order", f"WITH {WALK} SELECT * FROM wk")
def walk_order(spark, sf):
    return walk(spark, sf)


@query("context_entries", "SELECT p_brand AS comp_id, p_partkey AS entry_id FROM part WHERE p_partkey % 10 <> 0")
def context_entries(spark, sf):
    m = t.comp_entries(spark, sf)
    return rv.context_entries(m, m.select("entry_id", (F.col("entry_id") % 10 == 0).alias("seed")), NOKEY).select("comp_id", "entry_id")


@query("next_unread", f"""WITH {WALK},
cu AS (SELECT 'r' || k AS reviewer, k, comp_id, (k * 3) % (max(pos) + 1) AS "at", max(pos) AS n FROM wk, range(3) r(k) GROUP BY k, comp_id),
un AS (SELECT cu.reviewer, wk.comp_id, wk.id, (pos - "at" - 1 + n) % n AS ahead FROM wk JOIN cu USING (comp_id) WHERE (pos + k) % 3 = 0)
SELECT reviewer, comp_id, arg_min(id, ahead) AS next_id FROM un GROUP BY ALL""")
def next_unread(spark, sf):
    w = cut(walk(spark, sf), "walk")
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    who = F.concat(F.lit("r"), F.col("k").cast("string")).alias("reviewer")
    cur = w.groupBy("comp_id").agg(F.max("pos").alias("n")).select("comp_id", "n", k).select(who, "comp_id", ((F.col("k") * 3) % (F.col("n") + 1)).alias("at"))
    marks = w.select("comp_id", "id", "pos", k).select(who, "comp_id", "id", ((F.col("pos") + F.col("k")) % 3 != 0).alias("read"))
    return rv.next_unread(w, marks, cur, ["comp_id"])


def notes(spark, sf):
    c = t.comments(spark, sf)
    return c.select(
        F.col("id"), (F.col("conv_id") * 7 % t.supplier_count(spark, sf)).alias("path"), ((F.col("conv_id") * 37 + F.col("turn") * 5) % 400).alias("line"),
        F.when(F.col("turn") % 3 == 0, "LEFT").otherwise("RIGHT").alias("side"),
        F.when(F.col("turn") % 5 == 4, F.col("conv_id") * 1000).alias("reply_to"))


@query("drafts_at", with_views("s_diff_lines s_comments", """
nt AS (SELECT id, conv_id * 7 % (SELECT count(*) FROM supplier) AS path, (conv_id * 37 + turn * 5) % 400 AS line, CASE WHEN turn % 3 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, turn FROM s_comments)
SELECT nt.id, d.path, d.idx FROM nt JOIN s_diff_lines d ON d.path = nt.path AND CASE nt.side WHEN 'LEFT' THEN d.kind = 'del' AND d.old_no = nt.line ELSE d.kind <> 'del' AND d.new_no = nt.line END WHERE turn % 5 <> 4"""))
def drafts_at(spark, sf):
    return rv.drafts_at(lines(spark, sf), notes(spark, sf), ["path"]).select("id", "path", "idx")


ANCHORS = "an AS (SELECT conv_id AS thread_id, conv_id * 7 % (SELECT count(*) FROM supplier) AS path, conv_id * 37 % 600 AS line FROM conversations WHERE turn = 0)"


@query("place_threads", with_views("s_diff_lines", ANCHORS + """
SELECT an.*, (SELECT min(idx) FROM s_diff_lines d WHERE d.path = an.path AND coalesce(d.new_no, d.old_no) >= an.line) AS idx FROM an"""))
def place_threads(spark, sf):
    return rv.place_threads(lines(spark, sf), anchors(spark, sf), ["path"]).select("thread_id", "path", "line", "idx")


@query("place_threads_exact", with_views("s_diff_lines", ANCHORS + """
SELECT an.*, (SELECT min(idx) FROM s_diff_lines d WHERE d.path = an.path AND coalesce(d.new_no, d.old_no) = an.line) AS idx FROM an"""))
def place_threads_exact(spark, sf):
    return rv.place_threads_exact(lines(spark, sf), anchors(spark, sf), ["path"]).select("thread_id", "path", "line", "idx")


def pending(spark, sf):
    return t.comments(spark, sf).filter("turn = 2 and conv_id % 2 = 0").select((F.col("conv_id") * 1000).alias("reply_to"))


@query("thread_summary", with_views("s_comments", """
SELECT c.conv_id * 1000 AS thread_id, count(*) + (SELECT count(*) FROM s_comments p WHERE p.turn = 2 AND p.conv_id = c.conv_id AND c.conv_id % 2 = 0) AS messages, count(DISTINCT author) AS participants
FROM s_comments c GROUP BY c.conv_id"""))
def thread_summary(spark, sf):
    return rv.thread_summary(threads_of(spark, sf), pending(spark, sf), NOKEY)


@query("thread_participants", with_views("s_comments", "SELECT conv_id * 1000 AS thread_id, author, min(turn) AS first_pos FROM s_comments GROUP BY ALL"))
def thread_participants(spark, sf):
    return rv.thread_participants(threads_of(spark, sf), NOKEY)


@query("threads_per_entry", with_views("s_comments", "SELECT conv_id % 13 AS entry_id, count(*) AS threads FROM s_comments WHERE turn = 0 AND conv_id % 13 <> 0 GROUP BY 1"))
def threads_per_entry(spark, sf):
    c = t.comments(spark, sf).filter("turn = 0")
    return rv.threads_per_entry(c.select(F.when(F.col("conv_id") % 13 != 0, F.col("conv_id") % 13).alias("entry_id")), NOKEY)


def export_input(spark, sf):
    c = t.comments(spark, sf).withColumn("pr_id", F.col("conv_id") % 10)
    path = F.concat(F.lit("src/f"), F.col("conv_id").cast("string"), F.lit(".ts"))
    at = F.timestamp_seconds(F.lit(1700000000) + F.col("turn") * 60 + F.col("conv_id") % 7)
    drafts = c.filter("turn > 0").select(
        "pr_id", "id", path.alias("path"), F.col("turn").alias("line"), F.when(F.col("turn") % 3 == 0, "LEFT").otherwise("RIGHT").alias("side"), "body", "author",
        at.alias("created"), F.when(F.col("turn") % 5 == 4, F.col("in_reply_to")).alias("reply_to"),
        F.when(F.col("turn") % 5 == 4, F.lit("ann")).alias("reply_to_author"), F.when(F.col("turn") % 4 == 3, at).alias("exported_at"))
    threads = c.filter("turn = 0").select("pr_id", F.col("conv_id").alias("ord"), "id", F.when(F.col("conv_id") % 4 != 0, F.concat(path, F.lit(":"), F.col("conv_id").cast("string"))).alias("anchor"), "author", "body")
    replies = c.filter("turn > 0").select("pr_id", (F.col("conv_id") * 1000).alias("thread_id"), F.col("turn").alias("pos"), "author", "body")
    return drafts, threads, replies


EXPORT = """cm AS (SELECT *, conv_id % 10 AS pr_id FROM s_comments),
it AS (SELECT pr_id, CAST(id AS VARCHAR) AS id, 'src/f' || conv_id || '.ts' AS path, turn AS line, CASE WHEN turn % 3 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, body, author,
    CASE WHEN turn % 5 = 4 THEN 'reply to ann · f' || conv_id || '.ts:' || turn ELSE 'src/f' || conv_id || '.ts:' || turn || CASE WHEN turn % 3 = 0 THEN ' (removed)' ELSE '' END END AS anchor,
    CASE WHEN turn % 5 = 4 THEN CAST(in_reply_to AS VARCHAR) END AS reply_to, true AS mine, turn % 4 = 3 AS sent, turn * 60 + conv_id % 7 AS o, CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS sec FROM cm WHERE turn > 0
  UNION ALL SELECT pr_id, CAST(id AS VARCHAR), CASE WHEN conv_id % 4 <> 0 THEN 'src/f' || conv_id || '.ts' ELSE '' END, CASE WHEN conv_id % 4 <> 0 THEN conv_id END, 'RIGHT', body, author,
    CASE WHEN conv_id % 4 <> 0 THEN 'src/f' || conv_id || '.ts:' || conv_id ELSE '' END, NULL, false, true, conv_id, 2 FROM cm WHERE turn = 0),
ct AS (SELECT * EXCLUDE (o, sec), row_number() OVER (PARTITION BY pr_id ORDER BY sec, o, id) AS pos FROM it)
"""


@query("collect_threads", with_views("s_comments", EXPORT + "SELECT * FROM ct"))
def collect_threads(spark, sf):
    drafts, threads, _ = export_input(spark, sf)
    return rv.collect_threads(drafts, threads)


@query("export_markdown", with_views("s_comments", EXPORT + """
SELECT pr_id, pos, 0 AS part, 0 AS reply_pos, '**' || CASE anchor WHEN '' THEN '(no anchor)' ELSE anchor END || ' — ' || author || '**' AS line FROM ct
UNION ALL SELECT pr_id, pos, 1, 0, body FROM ct UNION ALL SELECT pr_id, pos, 3, 0, '' FROM ct
UNION ALL SELECT ct.pr_id, ct.pos, 2, turn, '> ' || cm.author || ': ' || cm.body FROM ct JOIN cm ON ct.id = CAST(cm.conv_id * 1000 AS VARCHAR) AND cm.turn > 0"""))
def export_markdown(spark, sf):
    drafts, threads, replies = export_input(spark, sf)
    return rv.export_markdown(cut(rv.collect_threads(drafts, threads), "items"), replies)


def stamped_bodies(spark, sf):
    c = t.comments(spark, sf).withColumn("pr_id", F.col("conv_id") % 10)
    mark = F.concat(F.lit("\n<!-- review-threads: "), F.col("id").cast("string"), F.lit(", ,"), (F.col("id") + 2).cast("string"), F.lit(" -->\nrest"))
    return c.select("pr_id", F.when(F.col("author") == "assistant", F.concat("body", mark)).otherwise(F.col("body")).alias("body"))


SENT = "ei AS (SELECT DISTINCT conv_id % 10 AS pr_id, CAST(id + k AS VARCHAR) AS id FROM s_comments, range(0, 3, 2) r(k) WHERE author = 'assistant')"


@query("exported_ids", with_views("s_comments", SENT + "SELECT * FROM ei"))
def exported_ids(spark, sf):
    return rv.exported_ids(stamped_bodies(spark, sf))


UNSENT = SENT + """,
us AS (SELECT pr_id, CAST(c.id AS VARCHAR) AS id, turn % 2 = 1 AS is_reply, conv_id, turn FROM (SELECT *, conv_id % 10 AS pr_id FROM s_comments) c
  WHERE NOT EXISTS (SELECT 1 FROM ei WHERE ei.pr_id = c.pr_id AND ei.id = CAST(c.id AS VARCHAR)))
"""


def unsent(spark, sf):
    c = t.comments(spark, sf).withColumn("pr_id", F.col("conv_id") % 10)
    items = c.select("pr_id", "id", F.col("id").alias("pos"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("line"),
                     F.when(F.col("turn") % 4 == 0, "LEFT").alias("side"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("body"), F.when(F.col("turn") % 2 == 1, F.col("in_reply_to")).alias("reply_to"))
    return rv.unsent_items(items, rv.exported_ids(stamped_bodies(spark, sf)))


@query("unsent_items", with_views("s_comments", UNSENT + "SELECT pr_id, id, is_reply FROM us"))
def unsent_items(spark, sf):
    return unsent(spark, sf).select("pr_id", "id", "is_reply")


@query("review_payload", with_views("s_comments", UNSENT + """,
fp AS (SELECT pr_id, (count(*) + 6) // 7 AS parts FROM us WHERE NOT is_reply GROUP BY pr_id),
nm AS (SELECT *, row_number() OVER (PARTITION BY pr_id, is_reply ORDER BY CAST(id AS BIGINT)) AS n FROM us JOIN fp USING (pr_id))
SELECT pr_id, CASE WHEN is_reply THEN (n - 1) % parts ELSE (n - 1) // 7 END AS part, count(*) FILTER (NOT is_reply) AS n,
  'Review notes — ' || count(*) FILTER (NOT is_reply) || ' comment' || CASE count(*) FILTER (NOT is_reply) WHEN 1 THEN '' ELSE 's' END || chr(10) || '<!-- review-threads: ' || string_agg(id, ',' ORDER BY CAST(id AS BIGINT)) || ' -->' AS body,
  coalesce(string_agg('f' || conv_id || ':' || turn || ':' || CASE WHEN turn % 4 = 0 THEN 'LEFT' ELSE 'RIGHT' END || ':b' || id, ' ' ORDER BY n) FILTER (NOT is_reply), '') AS comments
FROM nm GROUP BY 1, 2"""))
def review_payload(spark, sf):
    d = rv.review_payload(cut(unsent(spark, sf), "unsent"), part_rows=7)
    one = F.transform("comments", lambda c: F.concat_ws(":", c["path"], c["line"].cast("string"), c["side"], c["body"]))
    return d.withColumn("comments", F.array_join(one, " "))


@query("posted_counts", with_views("s_comments", UNSENT + "SELECT pr_id, count(*) FILTER (is_reply) AS replies, count(*) FILTER (NOT is_reply) AS fresh FROM us GROUP BY pr_id"))
def posted_counts(spark, sf):
    return rv.posted_counts(unsent(spark, sf))


@query("mark_exported", with_views("s_comments", """
SELECT id, CASE WHEN turn % 4 = 3 THEN 'earlier' WHEN turn % 3 = 0 THEN 'now' END AS exported_at FROM s_comments"""))
def mark_exported(spark, sf):
    c = t.comments(spark, sf)
    drafts = c.select("id", F.when(F.col("turn") % 4 == 3, "earlier").alias("exported_at"))
    return rv.mark_exported(drafts, c.filter("turn % 3 = 0").select("id"), F.lit("now"), NOKEY)
