"""Given tables reshaped into the engine's inputs, in Spark and as plain SQL views.

The SQL text is used by the checks only; the Spark side builds the same rows
with the skew-safe numbering of ``plans.scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlore.plans.scan import by_width, number_rows, row_before, running_sum, scan
from patchlore.plans.skew import skew_join
from patchlore.session import cut

HOUR = 3600
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_shipdate", "l_returnflag"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hour_of(ts: str) -> Column:
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / F.lit(HOUR))


def supplier_count(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "supplier").agg(F.count("*").alias("n")).scalar()


def commits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("pr_id"), F.col("event_id").alias("sha"), "ts",
        F.concat(F.lit("dev"), (F.col("event_id") % 7).cast("string")).alias("author"),
        F.when(F.col("event_type") == "signup", "Merge branch main").otherwise(F.col("event_type")).alias("message"))
    return number_rows(e, ["pr_id"], ["ts", "sha"], hour_of("ts"), "ord", reverse=True, split_hot_only=True)


def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("path"), *LINE_ORDER)
    kind = F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "del").otherwise("ctx")
    is_old = (kind != "add").cast("long")
    is_new = (kind != "del").cast("long")
    x = scan(li, ["path"], LINE_ORDER,
             {"idx": running_sum(F.lit(1).cast("long")), "o": running_sum(is_old), "n": running_sum(is_new)},
             by_width("l_orderkey"))
    return x.select(
        "path", "idx", kind.alias("kind"), F.col("l_orderkey").alias("by_sha"),
        F.when(F.col("l_quantity") <= 2, "//////").otherwise(
            F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("text"),
        F.when(kind != "add", F.col("o")).alias("old_no"),
        F.when(kind != "del", F.col("n")).alias("new_no"))


def def_spans(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(
        (F.col("p_partkey") % supplier_count(spark, sf)).alias("path"), F.col("p_partkey").alias("def_id"),
        F.col("p_brand").alias("component"), F.col("p_size").cast("long").alias("size"))
    p = number_rows(p, ["path"], ["def_id"], by_width("def_id"), "k")
    start = 1 + (F.col("k") - 1) * 30
    return p.select("path", "def_id", "component", start.alias("start_line"),
                    F.greatest(F.lit(1).cast("long"), start - F.col("size") % 7).alias("full_line"),
                    ((F.col("k") - 1) * 30 + F.col("size")).alias("end_line"))


def next_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, sha): each order line's part and the part of the line after it in the same order, null at the end.

    Lines of one number and part differ in neither, so their order need not be known.
    """
    order = ["l_linenumber", "l_partkey"]
    li = table(spark, sf, "lineitem").select("l_orderkey", *order)
    nxt = scan(li, ["l_orderkey"], order, {"b": row_before(F.col("l_partkey"))}, by_width("l_linenumber"), reverse=True)
    return nxt.select(F.col("l_partkey").alias("a"), "b", F.col("l_orderkey").alias("sha"))


def next_flagged_parts(spark: SparkSession, sf: str) -> DataFrame:
    """``next_parts`` with the flag of the line itself (a, b, sha, flag)."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag"]
    li = table(spark, sf, "lineitem").select("l_orderkey", *order)
    nxt = scan(li, ["l_orderkey"], order, {"b": row_before(F.col("l_partkey"))}, by_width("l_linenumber"), reverse=True)
    return nxt.select(F.col("l_partkey").alias("a"), "b", F.col("l_orderkey").alias("sha"), F.col("l_returnflag").alias("flag"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each part points to every other part that follows it directly in some order."""
    return cut(next_parts(spark, sf).filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter(F.col("p_partkey") % 10 == 0)
    return p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seed_ord"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    head = (F.when(F.col("doc_id") % 3 == 0, "lib/gen/").when(F.col("doc_id") % 3 == 1, "src/").otherwise(""))
    path = F.concat(head, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".ts"))
    return d.join(lab, "doc_id", "left").select(
        "doc_id", path.alias("path"), "text", F.coalesce("quality", F.lit(0)).alias("preferred"))


def file_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with their text length only (the text stays in the scan)."""
    d = table(spark, sf, "documents")
    head = (F.when(F.col("doc_id") % 3 == 0, "lib/gen/").when(F.col("doc_id") % 3 == 1, "src/").otherwise(""))
    path = F.concat(head, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".ts"))
    return d.select("doc_id", "source", "lang", path.alias("path"), "n_chars")


def touches(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("entry_id")).distinct()


def order_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the commits behind ``touches``: band by order key, author by customer."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("dev"), (F.col("o_custkey") % 5).cast("string")).alias("author"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Merge branch main").otherwise(F.col("o_orderpriority")).alias("message"),
        (F.col("o_orderkey") % 4 + 1).cast("long").alias("band"), (-F.col("o_orderkey")).alias("ord"))


def comp_entries(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("comp_id"), F.col("p_partkey").alias("entry_id"), F.col("p_partkey").alias("pos"))


def comments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn",
        F.when(F.col("turn") != 0, F.col("conv_id") * 1000).alias("in_reply_to"),
        F.col("role").alias("author"), F.col("text").alias("body"))


def check_runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    s = F.col("o_orderstatus")
    return o.select(
        F.col("o_custkey").alias("pr_id"), F.col("o_orderkey").alias("run_id"),
        F.when(s == "P", "in_progress").otherwise("completed").alias("status"),
        F.when(s == "F", F.when(F.col("o_orderkey") % 2 == 0, "failure").otherwise("skipped"))
        .when(s == "O", "success").alias("conclusion"))


def lines_by_order(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    j = skew_join(li, o, ["l_orderkey"])
    return j.select(
        F.col("l_partkey").alias("entry_id"), F.col("l_orderkey").alias("by_sha"),
        F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "del").otherwise("ctx").alias("kind"),
        F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), 1).otherwise(0).alias("seen"))


def uses(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 1499).alias("name"),
                     (F.col("l_linenumber") % 2).alias("is_prop"), "l_orderkey", "l_linenumber")


def defs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select((F.col("p_partkey") % supplier_count(spark, sf)).alias("file"), (F.col("p_partkey") % 1499).alias("name"),
                    F.col("p_partkey").alias("def_id"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(1).alias("top_level"))


def imports(spark: SparkSession, sf: str) -> DataFrame:
    n = supplier_count(spark, sf)
    file = F.col("o_custkey") % n
    li = table(spark, sf, "orders").select(
        file.alias("file"), (F.col("o_orderkey") % 1499).alias("name"),
        F.when(F.col("o_orderkey") % 8 == 0, F.col("o_orderkey") % n).otherwise((file * 7 + 3) % n).alias("module"))
    kind = F.when(F.col("name") % 7 == 0, "namespace").when(F.col("name") % 7 == 1, "default").otherwise("named")
    return (li.groupBy("file", "name").agg(F.min("module").alias("module"))
            .select("file", F.col("name").alias("local_name"), F.col("name").alias("imported"), "module", kind.alias("kind")))


def reexports(spark: SparkSession, sf: str) -> DataFrame:
    n = supplier_count(spark, sf)
    s = table(spark, sf, "supplier").filter(F.col("s_nationkey") % 2 == 0)
    return s.select(F.col("s_suppkey").alias("file"), ((F.col("s_suppkey") * 7 + 3) % n).alias("module"),
                    F.lit("*").alias("exported"))


NEXT_PARTS = """
SELECT l_partkey AS a,
       lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag) AS b,
       l_orderkey AS sha, l_returnflag AS flag
FROM lineitem"""

VIEWS = {
    "s_commits": """
SELECT user_id AS pr_id, event_id AS sha, ts,
       concat('dev', CAST(event_id % 7 AS VARCHAR)) AS author,
       CASE WHEN event_type = 'signup' THEN 'Merge branch main' ELSE event_type END AS message,
       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS ord
FROM events""",
    "s_diff_lines": """
SELECT path, idx, kind, by_sha, text,
       CASE WHEN kind <> 'add' THEN CAST(sum(CASE WHEN kind <> 'add' THEN 1 ELSE 0 END)
            OVER (PARTITION BY path ORDER BY idx) AS BIGINT) END AS old_no,
       CASE WHEN kind <> 'del' THEN CAST(sum(CASE WHEN kind <> 'del' THEN 1 ELSE 0 END)
            OVER (PARTITION BY path ORDER BY idx) AS BIGINT) END AS new_no
FROM (SELECT l_suppkey AS path, l_orderkey AS by_sha,
             row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
               l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) AS idx,
             CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'R' THEN 'del' ELSE 'ctx' END AS kind,
             CASE WHEN l_quantity <= 2 THEN '//////' ELSE concat('part ', CAST(l_partkey AS VARCHAR)) END AS text
      FROM lineitem)""",
    "s_def_spans": """
SELECT path, def_id, p_brand AS component, 1 + (k - 1) * 30 AS start_line,
       greatest(1, 1 + (k - 1) * 30 - p_size % 7) AS full_line,
       (k - 1) * 30 + p_size AS end_line
FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY def_id) AS k
      FROM (SELECT p_partkey % (SELECT count(*) FROM supplier) AS path, p_partkey AS def_id, p_brand, p_size FROM part))""",
    "s_next_parts": NEXT_PARTS,
    "s_edges": f"SELECT DISTINCT a, b FROM ({NEXT_PARTS}) t WHERE a <> b",
    "s_seeds": "SELECT p_partkey AS id, p_partkey AS seed_ord FROM part WHERE p_partkey % 10 = 0",
    "s_files": """
SELECT d.doc_id, concat(CASE d.doc_id % 3 WHEN 0 THEN 'lib/gen/' WHEN 1 THEN 'src/' ELSE '' END,
         d.source, '/', d.lang, '/', CAST(d.doc_id AS VARCHAR), '.ts') AS path,
       d.text, coalesce(l.quality, 0) AS preferred, d.n_chars, d.source, d.lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "s_touches": "SELECT DISTINCT l_orderkey AS sha, l_partkey AS entry_id FROM lineitem",
    "s_order_commits": """
SELECT o_orderkey AS sha, o_orderdate AS ts, concat('dev', CAST(o_custkey % 5 AS VARCHAR)) AS author,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Merge branch main' ELSE o_orderpriority END AS message,
       o_orderkey % 4 + 1 AS band, -o_orderkey AS ord
FROM orders""",
    "s_comp_entries": "SELECT p_brand AS comp_id, p_partkey AS entry_id, p_partkey AS pos FROM part",
    "s_comments": """
SELECT conv_id * 1000 + turn AS id, conv_id, turn,
       CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 END AS in_reply_to, role AS author, text AS body
FROM conversations""",
    "s_check_runs": """
SELECT o_custkey AS pr_id, o_orderkey AS run_id,
       CASE WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'completed' END AS status,
       CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failure' ELSE 'skipped' END
                          WHEN 'O' THEN 'success' END AS conclusion
FROM orders""",
    "s_lines_by_order": """
SELECT l_partkey AS entry_id, l_orderkey AS by_sha,
       CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'R' THEN 'del' ELSE 'ctx' END AS kind,
       CASE WHEN o_orderdate < TIMESTAMP '1999-01-01 00:00:00' THEN 1 ELSE 0 END AS seen
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "s_uses": """
SELECT l_suppkey AS file, l_partkey % 1499 AS name, l_linenumber % 2 AS is_prop,
       l_orderkey, l_linenumber FROM lineitem""",
    "s_defs": """
SELECT p_partkey % (SELECT count(*) FROM supplier) AS file, p_partkey % 1499 AS name,
       p_partkey AS def_id, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS top_level FROM part""",
    "s_imports": """
SELECT file, name AS local_name, name AS imported, min(module) AS module,
       CASE name % 7 WHEN 0 THEN 'namespace' WHEN 1 THEN 'default' ELSE 'named' END AS kind
FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS file, o_orderkey % 1499 AS name,
             CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % (SELECT count(*) FROM supplier)
                  ELSE (o_custkey % (SELECT count(*) FROM supplier) * 7 + 3) % (SELECT count(*) FROM supplier) END AS module
      FROM orders) t
GROUP BY file, name""",
    "s_reexports": """
SELECT s_suppkey AS file, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS module, '*' AS exported
FROM supplier WHERE s_nationkey % 2 = 0""",
}


def with_views(views: str, body: str) -> str:
    """``body`` preceded by the named views (blank separated) as common table expressions.

    ``body`` may begin with further CTEs written as ``name AS (...), ... SELECT``.
    """
    ctes = [f"{v} AS ({VIEWS[v]})" for v in views.split()]
    body = body.strip()
    lead = body.upper().startswith(("SELECT", "("))
    return "WITH RECURSIVE " + ",\n".join(ctes + ([] if lead else [""])) + f"\n{body}" if ctes else f"WITH RECURSIVE {body}"
