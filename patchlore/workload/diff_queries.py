"""Queries over patch text, diff lines and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlore.functions import text as tx
from patchlore.operators import diff
from patchlore.workload import tables as t
from patchlore.workload.registry import query
from patchlore.workload.tables import with_views


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as one patch: sign by line number, one file, one hunk from 1."""
    d = t.table(spark, sf, "documents").select("doc_id", "text")
    signed = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(
        F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "), x))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    kind = F.when(F.col("doc_id") % 5 == 0, "new file mode 100644\n").when(F.col("doc_id") % 5 == 1, "deleted file mode 100644\n") \
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("rename from was/"), name, F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"), kind, F.lit("@@ -1 +1 @@\n"))
    return d.select("doc_id", F.concat(head, F.array_join(signed, "\n")).alias("patch"))


# Refs built from the documents table, in both engines.
REF_SPARK = """CASE doc_id % 3 WHEN 0 THEN concat('https://github.com/', source, '/', lang, '.git/pull/', CAST(doc_id AS STRING))
 WHEN 1 THEN concat(' ', source, '/', lang, '#', CAST(doc_id AS STRING)) ELSE text END"""
REF_DUCK = REF_SPARK.replace("STRING", "VARCHAR")

SPLIT = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""
NUMBERED = f"""WITH {SPLIT},
k AS (SELECT doc_id, i AS idx, line AS text, CASE (i - 1) % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'del' ELSE 'ctx' END AS kind,
      i - (i + 2) // 3 AS old_n, i - (i + 1) // 3 AS new_n FROM l)"""


@query("parse_unified_diff", f"""{NUMBERED}
SELECT doc_id, concat('doc', doc_id) AS path, idx, kind, text,
       CASE WHEN kind <> 'add' THEN old_n END AS "old", CASE WHEN kind <> 'del' THEN new_n END AS "new" FROM k""")
def parse_unified_diff(spark, sf):
    return diff.parse_unified_diff(patches(spark, sf), ["doc_id"]).drop("file_seq")


@query("file_delta", f"""{NUMBERED}
SELECT doc_id, concat('doc', doc_id) AS path, count(*) FILTER (kind = 'add') AS "add", count(*) FILTER (kind = 'del') AS del,
       CASE WHEN doc_id % 5 = 1 THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'new'
            ELSE '+' || count(*) FILTER (kind = 'add') || ' −' || count(*) FILTER (kind = 'del') END AS delta
FROM k GROUP BY doc_id""")
def file_delta(spark, sf):
    return diff.diff_files(diff.patch_rows(patches(spark, sf), ["doc_id"]), ["doc_id"]).select("doc_id", "path", "add", "del", "delta")


@query("rename_map", "SELECT doc_id, concat('doc', doc_id) AS path, concat('was/doc', doc_id) AS old_path FROM documents WHERE doc_id % 5 = 2")
def rename_map(spark, sf):
    return diff.rename_map(diff.diff_files(diff.patch_rows(patches(spark, sf), ["doc_id"]), ["doc_id"]), ["doc_id"])


@query("changed_paths", "SELECT doc_id, concat('doc', doc_id) AS path FROM documents")
def changed_paths(spark, sf):
    return diff.changed_paths(diff.diff_files(diff.patch_rows(patches(spark, sf), ["doc_id"]), ["doc_id"]), ["doc_id"])


@query("base_paths", """SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN concat('was/doc', doc_id) ELSE concat('doc', doc_id) END AS path
FROM documents WHERE doc_id % 5 > 1""")
def base_paths(spark, sf):
    return diff.base_paths(diff.diff_files(diff.patch_rows(patches(spark, sf), ["doc_id"]), ["doc_id"]), ["doc_id"])


@query("delta_counts", with_views("s_diff_lines", """
SELECT path, count(*) FILTER (kind = 'add') AS "add", count(*) FILTER (kind = 'del') AS del FROM s_diff_lines GROUP BY path"""))
def delta_counts(spark, sf):
    li = t.table(spark, sf, "lineitem")
    lines = li.select(F.col("l_suppkey").alias("path"),
                      F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "del").otherwise("ctx").alias("kind"))
    return diff.delta_counts(lines, ["path"])


@query("insignificant_lines", f"""WITH {SPLIT},
m AS (SELECT CASE WHEN i % 7 = 0 THEN '  // ----' WHEN i % 11 = 0 THEN chr(9) || '***  ' ELSE line END AS line FROM l)
SELECT count(*) AS lines, count(*) FILTER (regexp_full_match(regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '[/*\\-=#~_ ]*')) AS insignificant FROM m""")
def insignificant_lines(spark, sf):
    d = t.table(spark, sf, "documents").select(F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    n = F.col("i") + 1
    line = F.when(n % 7 == 0, "  // ----").when(n % 11 == 0, "\t***  ").otherwise(F.col("line"))
    return d.select(line.alias("line")).agg(F.count("*").alias("lines"), F.count_if(tx.insignificant(F.col("line"))).alias("insignificant"))


@query("changed_head_lines", with_views("s_diff_lines", """
h AS (SELECT path, idx, kind, text, new_no,
             (SELECT max(b.new_no) FROM s_diff_lines b WHERE b.path = a.path AND b.idx < a.idx) AS above FROM s_diff_lines a)
SELECT DISTINCT path, coalesce(new_no, greatest(1, coalesce(above, 0))) AS head_line
FROM h WHERE kind <> 'ctx' AND text <> '//////'"""))
def changed_head_lines(spark, sf):
    return diff.changed_head_lines(t.diff_lines(spark, sf), ["path"], new="new_no")


@query("line_keys", with_views("s_diff_lines", """
SELECT path, idx, kind || '|' || coalesce(CAST(old_no AS VARCHAR), '') || '|' || coalesce(CAST(new_no AS VARCHAR), '') AS line_key
FROM s_diff_lines"""))
def line_keys(spark, sf):
    d = t.diff_lines(spark, sf)
    return d.select("path", "idx", tx.line_key(F.col("kind"), F.col("old_no"), F.col("new_no")).alias("line_key"))


@query("merge_commits", with_views("s_commits", "SELECT pr_id, count(*) AS merges FROM s_commits WHERE starts_with(message, 'Merge branch') GROUP BY pr_id"))
def merge_commits(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("user_id").alias("pr_id"),
                                            F.when(F.col("event_type") == "signup", "Merge branch main").otherwise(F.col("event_type")).alias("message"))
    return e.filter(tx.is_merge_message(F.col("message"))).groupBy("pr_id").agg(F.count("*").alias("merges"))


@query("extract_pr_refs", f"""WITH r AS (SELECT {REF_DUCK} AS s FROM documents),
x AS (SELECT CASE WHEN regexp_matches(s, '(?i)github\\.com/[^/\\s]+/[^/\\s#]+/pull/\\d+') THEN regexp_extract(s, '(?i)github\\.com/([^/\\s]+)/([^/\\s#]+)/pull/(\\d+)', ['o', 'r', 'n'])
     WHEN regexp_matches(s, '^\\s*[^/\\s]+/[^/\\s#]+#\\d+\\s*$') THEN regexp_extract(s, '^\\s*([^/\\s]+)/([^/\\s#]+)#(\\d+)\\s*$', ['o', 'r', 'n']) END AS m FROM r)
SELECT m.o AS owner, regexp_replace(m.r, '\\.git$', '') AS repo, count(*) AS refs, min(CAST(m.n AS BIGINT)) AS first_number
FROM x GROUP BY ALL""")
def extract_pr_refs(spark, sf):
    d = t.table(spark, sf, "documents").select(tx.pr_ref(F.expr(REF_SPARK)).alias("r"))
    return d.groupBy(F.col("r.owner").alias("owner"), F.col("r.repo").alias("repo")).agg(
        F.count("*").alias("refs"), F.min(F.col("r.number").cast("long")).alias("first_number"))


@query("normalize_for_hash", """SELECT doc_id, md5('import x from "./' || lang || '"; ' || text || ' import(''../' || source || ''') from "pkg.ts"') AS h FROM documents""")
def normalize_for_hash(spark, sf):
    d = t.table(spark, sf, "documents")
    body = F.concat(F.lit('import x from "./'), "lang", F.lit('.ts"; '), "text", F.lit(" import('../"), "source", F.lit(""".tsx') from "pkg.ts\""""))
    return d.select("doc_id", F.md5(tx.normalize_for_hash(body).cast("binary")).alias("h"))


@query("content_hash", "SELECT count(*) AS files, count(DISTINCT sha1(text)) AS contents, min(sha1(text)) AS first_hash FROM documents")
def content_hash(spark, sf):
    h = t.table(spark, sf, "documents").select(tx.content_hash(F.col("text")).alias("h"))
    per = h.groupBy("h").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("files"), F.count("*").alias("contents"), F.min("h").alias("first_hash"))


@query("node_file", with_views("s_files", """
SELECT path AS file, count(*) AS n FROM s_files GROUP BY path"""))
def node_file(spark, sf):
    f = t.file_paths(spark, sf)
    node = F.concat("path", F.lit("#"), "lang", F.lit("#const#"), F.col("doc_id").cast("string"))
    return f.select(tx.node_file(node).alias("file")).groupBy("file").agg(F.count("*").alias("n"))


@query("source_line", """SELECT doc_id, i AS line, left(regexp_replace(line, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), 160) AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def source_line(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return d.select("doc_id", (F.col("i").cast("long") + 1).alias("line"), tx.source_line(F.col("line")).alias("text"))
