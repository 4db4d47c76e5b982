"""Queries over symbol tables, spans and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlore.operators import symbols as sy
from patchlore.workload import tables as t
from patchlore.workload.registry import query
from patchlore.workload.tables import with_views


@query("collapse_mirrors", with_views("s_files", """
SELECT path, first_value(path) OVER (PARTITION BY md5(text) ORDER BY preferred DESC, length(path) - length(replace(path, '/', '')), path) AS canonical_path FROM s_files"""))
def collapse_mirrors(spark, sf):
    return sy.collapse_mirrors(t.files(spark, sf), [])


def raw_defs(spark, sf):
    p = t.table(spark, sf, "part")
    name = F.when(F.col("p_size") % 9 == 0, "x").when(F.col("p_size") % 9 == 1, "undefined").otherwise(F.col("p_brand"))
    return p.select((F.col("p_partkey") % 50).cast("string").alias("file"), name.alias("name"), F.col("p_type").alias("kind"),
                    (F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + 5).alias("end"), "p_partkey")


@query("def_ids", """WITH d AS (SELECT *, CASE p_size % 9 WHEN 0 THEN 'x' WHEN 1 THEN 'undefined' ELSE p_brand END AS name FROM part)
SELECT p_partkey, concat_ws('#', p_partkey % 50, name, p_type, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1) AS def_id
FROM d WHERE length(name) > 1 AND name <> 'undefined'""")
def def_ids(spark, sf):
    return sy.with_def_ids(raw_defs(spark, sf), []).select("p_partkey", "def_id")


@query("attached_start", """WITH c AS (SELECT l_partkey AS def_id, l_orderkey * 10 + l_linenumber AS pos,
  (l_returnflag = 'A' AND l_quantity < 10) OR (l_linestatus = 'O' AND l_quantity > 45) AS stops FROM lineitem)
SELECT p_partkey AS def_id, coalesce((SELECT min(pos) FROM c WHERE c.def_id = p_partkey AND pos > coalesce((SELECT max(pos) FROM c d WHERE d.def_id = p_partkey AND d.stops), -1)), 10000000) AS "full"
FROM part""")
def attached_start(spark, sf):
    li = t.table(spark, sf, "lineitem")
    banner = (F.col("l_returnflag") == "A") & (F.col("l_quantity") < 10)
    blank = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)
    notes = li.select(F.col("l_partkey").alias("def_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
                      F.when(banner, "// ---- //").otherwise("/* says why */").alias("text"), F.when(blank, "\n \t\n").otherwise("\n").alias("gap"))
    defs = t.table(spark, sf, "part").select(F.col("p_partkey").alias("def_id"), F.lit(10000000).cast("long").alias("start"))
    return sy.attached_start(defs, notes, []).select("def_id", "full")


@query("offset_to_line", """WITH o AS (SELECT doc_id, j, n_chars * j // 7 AS "offset", left(text, n_chars * j // 7) AS head FROM documents, range(7) r(j))
SELECT doc_id, "offset", count(*) AS n, length(any_value(head)) - length(replace(any_value(head), chr(10), '')) + 1 AS line FROM o GROUP BY doc_id, "offset\"""")
def offset_to_line(spark, sf):
    d = t.table(spark, sf, "documents")
    offs = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j"), "n_chars")
    offs = offs.select("doc_id", F.floor(F.col("n_chars") * F.col("j") / 7).alias("offset"))
    lines = sy.offset_to_line(offs, sy.line_starts(d, ["doc_id"]), ["doc_id"])
    return lines.groupBy("doc_id", "offset", "line").agg(F.count("*").alias("n"))


CLAMPED = """c AS (SELECT path, def_id, component, least(greatest(full_line, coalesce(max(end_line) OVER (PARTITION BY path ORDER BY start_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1), end_line) AS span_start,
  end_line AS span_end FROM s_def_spans)
"""


def clamped(spark, sf):
    return sy.clamp_spans(t.def_spans(spark, sf), ["path"]).select("path", "def_id", "component", "span_start", "span_end")


@query("clamp_spans", with_views("s_def_spans", CLAMPED + "SELECT * FROM c"))
def clamp_spans(spark, sf):
    return clamped(spark, sf)


def specs(spark, sf):
    """Each file imports the file three documents on, by several spellings."""
    f = t.file_paths(spark, sf)
    nxt = f.select((F.col("doc_id") - 3).alias("doc_id"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("tail"))
    spec = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("pkg/"), "tail"))
            .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("./x/../../../"), "tail", F.lit(".ts")))
            .otherwise(F.concat(F.lit("../.././"), "tail")))
    return f.join(nxt, "doc_id").select("doc_id", F.col("path").alias("file"), spec.alias("spec"))


def known_files(spark, sf):
    f = t.file_paths(spark, sf)
    mirror = F.col("doc_id") % 10 == 9
    to = f.select((F.col("doc_id") + 9).alias("doc_id"), F.col("path").alias("canonical_path"))
    canonical = f.filter(mirror).join(to, "doc_id").select("path", "canonical_path")
    return f.filter(~mirror).select("path"), canonical


RESOLVED = """r AS (SELECT a.doc_id, a.path AS file, CASE WHEN a.doc_id % 4 <> 0 THEN m.path END AS module FROM s_files a JOIN s_files b ON b.doc_id = a.doc_id + 3
  LEFT JOIN s_files m ON m.doc_id = CASE WHEN b.doc_id % 10 = 9 THEN b.doc_id - 9 ELSE b.doc_id END)
"""


@query("resolve_spec", with_views("s_files", RESOLVED + "SELECT * FROM r"))
def resolve_spec(spark, sf):
    known, canonical = known_files(spark, sf)
    return sy.resolve_spec(specs(spark, sf), known, canonical, []).select("doc_id", "file", "module")


@query("module_graph", with_views("s_files", RESOLVED + """SELECT file, module, CASE WHEN doc_id % 2 = 0 THEN 'import' ELSE 'reexport' END AS what FROM r WHERE module IS NOT NULL"""))
def module_graph(spark, sf):
    known, canonical = known_files(spark, sf)
    s = specs(spark, sf)
    imp, rex = sy.module_graph(s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1"), known, canonical, [])
    pick = lambda d, w: d.select("file", "module", F.lit(w).alias("what"))
    return pick(imp, "import").unionByName(pick(rex, "reexport"))


CHAINS = """tops AS (SELECT file, name, min(def_id) AS def_id FROM s_defs WHERE top_level = 1 GROUP BY file, name),
walk AS (SELECT DISTINCT {module} AS module, {name} AS name, {module} AS at, 0 AS depth FROM {source}
         UNION ALL SELECT w.module, w.name, r.module, depth + 1 FROM walk w JOIN s_reexports r ON r.file = w.at
         WHERE depth < 120 AND NOT EXISTS (SELECT 1 FROM tops t WHERE t.file = w.at AND t.name = w.name)),
ex AS (SELECT w.module, w.name, arg_min(t.def_id, w.depth) AS def_id FROM walk w JOIN tops t ON t.file = w.at AND t.name = w.name GROUP BY 1, 2)
"""


def reexports_in_order(spark, sf):
    return t.reexports(spark, sf).select("file", F.lit(0).alias("pos"), "exported", F.lit(None).cast("long").alias("imported"), "module")


@query("export_chains", with_views("s_uses s_defs s_reexports", CHAINS.format(module="file", name="name", source="s_uses") + "SELECT * FROM ex"))
def export_chains(spark, sf):
    wanted = t.uses(spark, sf).select(F.col("file").alias("module"), "name")
    tops = sy.first_defs(t.defs(spark, sf).filter("top_level = 1"), [])
    return sy.resolve_export(wanted, tops, reexports_in_order(spark, sf), [])


NAMED = """r AS (SELECT 0 AS pr_id, concat('f', s_suppkey) AS file, 0 AS pos, '*' AS exported, NULL AS imported, concat('f', (s_suppkey * 7 + 3) % n) AS module FROM supplier, nn WHERE s_nationkey % 2 = 0
  UNION ALL SELECT 0, concat('f', s_suppkey), 1, concat('n', s_suppkey % 97), concat('n', (s_suppkey * 5 + 1) % 97), concat('f', (s_suppkey * 3 + 1) % n) FROM supplier, nn WHERE s_nationkey % 3 <> 1
  UNION ALL SELECT 0, concat('f', s_suppkey), 2, '*', NULL, concat('f', s_suppkey * 11 % n) FROM supplier, nn WHERE s_nationkey % 4 = 0),
rx AS (SELECT * FROM r UNION ALL SELECT 1, file, pos, exported, imported, module FROM r WHERE pos < 2),
tp AS (SELECT q.pr_id, concat('f', p_partkey % n) AS file, concat('n', p_partkey % 97) AS name, min(concat('p', p_partkey)) AS def_id FROM part, nn, (VALUES (0), (1)) q(pr_id) GROUP BY ALL),
wa AS (SELECT DISTINCT q.pr_id, concat('f', l_suppkey) AS module, concat('n', l_partkey % 97) AS name FROM lineitem, (VALUES (0), (1)) q(pr_id)),
wk AS (SELECT pr_id, module, name, module AS file, name AS nm, CAST([] AS INTEGER[]) AS way, [concat(module, ' ', name)] AS met FROM wa
  UNION ALL SELECT w.pr_id, w.module, w.name, rx.module, CASE WHEN exported = '*' THEN w.nm ELSE imported END, list_append(way, pos),
      list_append(met, concat(rx.module, ' ', CASE WHEN exported = '*' THEN w.nm ELSE imported END))
    FROM wk w JOIN rx ON rx.pr_id = w.pr_id AND rx.file = w.file AND (exported = '*' OR exported = w.nm)
    WHERE NOT list_contains(met, concat(rx.module, ' ', CASE WHEN exported = '*' THEN w.nm ELSE imported END))
      AND NOT EXISTS (SELECT 1 FROM tp WHERE tp.pr_id = w.pr_id AND tp.file = w.file AND tp.name = w.nm))
"""


def named_exports(spark, sf):
    """Modules with string ids, several re-exports each, renames and cycles, as two requests; the second lacks the last re-export."""
    n = t.supplier_count(spark, sf)
    s = t.table(spark, sf, "supplier")
    file = lambda c: F.concat(F.lit("f"), c.cast("string"))
    name = lambda c: F.concat(F.lit("n"), (c % 97).cast("string"))
    key, none = F.col("s_suppkey"), F.lit(None).cast("string")
    kinds = [(F.col("s_nationkey") % 2 == 0, F.lit("*"), none, (key * 7 + 3) % n),
             (F.col("s_nationkey") % 3 != 1, name(key), name(key * 5 + 1), (key * 3 + 1) % n),
             (F.col("s_nationkey") % 4 == 0, F.lit("*"), none, key * 11 % n)]
    cells = F.array(*[F.when(keep, F.struct(F.lit(pos).alias("pos"), ex.alias("exported"), im.alias("imported"), file(to).alias("module"))) for pos, (keep, ex, im, to) in enumerate(kinds)])
    rex = s.select(file(key).alias("file"), F.explode(cells).alias("c")).filter("c IS NOT NULL").select("file", "c.*")
    requests = lambda d: d.withColumn("pr_id", F.explode(F.array(F.lit(0), F.lit(1))))
    part = t.table(spark, sf, "part").select(file(F.col("p_partkey") % n).alias("file"), name(F.col("p_partkey")).alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("def_id"))
    wanted = t.table(spark, sf, "lineitem").select(file(F.col("l_suppkey")).alias("module"), name(F.col("l_partkey")).alias("name")).distinct()
    return requests(wanted), requests(sy.first_defs(part, [])), requests(rex).filter("pr_id = 0 OR pos < 2")


@query("export_names", with_views("", "nn AS (SELECT count(*) AS n FROM supplier),\n" + NAMED + "SELECT wk.pr_id, wk.module, wk.name, arg_min(tp.def_id, way) AS def_id FROM wk JOIN tp ON tp.pr_id = wk.pr_id AND tp.file = wk.file AND tp.name = wk.nm GROUP BY 1, 2, 3"))
def export_names(spark, sf):
    return sy.resolve_export(*named_exports(spark, sf))


USES = """u AS (SELECT file, name, is_prop, count(*) AS uses FROM s_uses GROUP BY ALL),
ns AS (SELECT file, module, local_name FROM s_imports WHERE kind = 'namespace'),
w0 AS (SELECT module, imported AS name FROM s_imports WHERE kind = 'named' UNION SELECT ns.module, u.name FROM u JOIN ns USING (file)),
""" + CHAINS.format(module="module", name="name", source="w0") + """,
lc AS (SELECT file, name, min(def_id) AS d FROM s_defs GROUP BY file, name),
un AS (SELECT name, min(def_id) AS d FROM s_defs GROUP BY name HAVING count(*) = 1),
fns AS (SELECT DISTINCT file FROM ns),
nb AS (SELECT u.file, u.name, arg_min(ex.def_id, ns.local_name) AS d FROM u JOIN ns USING (file) JOIN ex ON ex.module = ns.module AND ex.name = u.name GROUP BY 1, 2),
x AS (SELECT u.*, lc.d AS d1, i.kind, CASE i.kind WHEN 'named' THEN en.def_id WHEN 'default' THEN tm.def_id END AS d2,
        fns.file IS NOT NULL AND is_prop = 1 AS sp, nb.d AS d3, un.d AS d4
      FROM u LEFT JOIN lc USING (file, name) LEFT JOIN s_imports i ON i.file = u.file AND i.local_name = u.name
      LEFT JOIN ex en ON en.module = i.module AND en.name = i.imported LEFT JOIN tops tm ON tm.file = i.module AND tm.name = u.name
      LEFT JOIN fns ON fns.file = u.file LEFT JOIN nb ON nb.file = u.file AND nb.name = u.name LEFT JOIN un ON un.name = u.name),
res AS (SELECT file, name, is_prop, uses, CASE WHEN d1 IS NOT NULL THEN d1 WHEN kind IS NOT NULL THEN d2 WHEN sp THEN d3 ELSE d4 END AS def_id,
   CASE WHEN d1 IS NOT NULL THEN 'local' WHEN kind IS NOT NULL THEN CASE WHEN d2 IS NOT NULL THEN 'import' END
        WHEN sp THEN CASE WHEN d3 IS NOT NULL THEN 'namespace' END WHEN d4 IS NOT NULL THEN 'unique' END AS rule FROM x)
"""
USE_VIEWS = "s_uses s_defs s_imports s_reexports"


def resolved(spark, sf):
    uses = t.uses(spark, sf).withColumn("is_prop", F.col("is_prop") == 1)
    imports = t.imports(spark, sf).withColumn("pos", F.col("local_name"))
    defs = t.defs(spark, sf).withColumn("top_level", F.col("top_level") == 1)
    return sy.resolve_uses(uses, defs, imports, reexports_in_order(spark, sf), [], default_name=F.lit(-1).cast("long"))


@query("resolve_uses", with_views(USE_VIEWS, USES + "SELECT file, name, is_prop, uses, def_id, rule FROM res"))
def resolve_uses(spark, sf):
    return resolved(spark, sf).groupBy("file", "name", F.col("is_prop").cast("int").alias("is_prop"), "def_id", "rule").agg(F.count("*").alias("uses"))


@query("ref_counts", with_views(USE_VIEWS, USES + "SELECT def_id, CAST(sum(uses) AS BIGINT) AS refs FROM res WHERE def_id IS NOT NULL GROUP BY def_id"))
def ref_counts(spark, sf):
    return sy.ref_counts(resolved(spark, sf), [])
