"""Queries over seeds, reach, components and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlore.operators import diff, graph as g
from patchlore.workload import tables as t
from patchlore.workload.registry import query
from patchlore.workload.symbol_queries import CLAMPED, clamped
from patchlore.workload.tables import with_views

NOKEY: list[str] = []

TOUCHED_LINES = """tl AS (SELECT DISTINCT path, coalesce(new_no, greatest(1, coalesce((SELECT max(b.new_no) FROM s_diff_lines b WHERE b.path = a.path AND b.idx < a.idx), 0))) AS head_line
  FROM s_diff_lines a WHERE kind <> 'ctx' AND text <> '//////')
"""


@query("find_seeds", with_views("s_def_spans s_diff_lines", CLAMPED + "," + TOUCHED_LINES + """
SELECT * FROM c WHERE EXISTS (SELECT 1 FROM tl WHERE tl.path = c.path AND tl.head_line BETWEEN span_start AND span_end)"""))
def find_seeds(spark, sf):
    touched = diff.changed_head_lines(t.diff_lines(spark, sf), ["path"], new="new_no")
    return g.find_seeds(touched, clamped(spark, sf), ["path"])


@query("enclosing_def", with_views("s_def_spans", CLAMPED + """
SELECT def_id AS caller, count(*) AS uses, count(DISTINCT pos) AS places FROM (
  SELECT l_suppkey AS path, l_orderkey % 700 AS pos, rowid_ AS r, arg_max(def_id, span_start) AS def_id
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM lineitem) l JOIN c ON c.path = l.l_suppkey AND l.l_orderkey % 700 BETWEEN span_start AND span_end GROUP BY 1, 2, 3)
GROUP BY def_id"""))
def enclosing_def(spark, sf):
    uses = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 700).alias("start"))
    spans = clamped(spark, sf).withColumnRenamed("def_id", "caller")
    d = g.enclosing_def(uses, spans, ["path"])
    return d.groupBy("caller").agg(F.count("*").alias("uses"), F.countDistinct("start").alias("places"))


@query("adjacency", with_views("s_edges", "SELECT a AS src, b AS dst FROM s_edges UNION SELECT b, a FROM s_edges"))
def adjacency(spark, sf):
    return g.adjacency(t.edges(spark, sf), NOKEY)


REACH = """adj AS (SELECT a, b FROM s_edges UNION SELECT b, a FROM s_edges),
fill AS (SELECT id AS seed, id AS node, 0 AS hop FROM s_seeds UNION SELECT f.seed, adj.b, f.hop + 1 FROM fill f JOIN adj ON adj.a = f.node WHERE f.hop < 3),
near AS (SELECT seed, node, min(hop) AS hop FROM fill GROUP BY 1, 2)
"""
STARTERS = REACH + """,
earlier AS (SELECT n.node AS id, list(n.seed) AS who FROM near n JOIN s_seeds s ON s.id = n.node WHERE n.seed < n.node GROUP BY 1),
line AS MATERIALIZED (SELECT s.id, row_number() OVER (ORDER BY s.seed_ord) AS i, coalesce(e.who, []) AS who FROM s_seeds s LEFT JOIN earlier e ON e.id = s.id),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS chosen
         UNION ALL SELECT l.i, CASE WHEN list_has_any(w.chosen, l.who) THEN w.chosen ELSE list_append(w.chosen, l.id) END FROM walk w JOIN line l ON l.i = w.i + 1),
st AS (SELECT unnest(chosen) AS id FROM (SELECT chosen FROM walk ORDER BY i DESC LIMIT 1))
"""
COMPONENTS = STARTERS + """,
ball AS (SELECT n.seed, n.node FROM near n JOIN st ON st.id = n.seed),
lap AS (SELECT DISTINCT x.seed AS s1, y.seed AS s2 FROM ball x JOIN ball y USING (node)),
clo AS (SELECT id AS s1, id AS s2 FROM st UNION SELECT c.s1, lap.s2 FROM clo c JOIN lap ON lap.s1 = c.s2),
comp AS (SELECT b.node, min(b2.node) AS comp FROM ball b JOIN clo ON clo.s1 = b.seed JOIN ball b2 ON b2.seed = clo.s2 GROUP BY b.node)
"""


@query("flood_fill", with_views("s_edges s_seeds", REACH + "SELECT seed, node, hop FROM near"))
def flood_fill(spark, sf):
    return g.flood_fill(t.seeds(spark, sf), g.adjacency(t.edges(spark, sf), NOKEY), NOKEY)


REQUEST_REACH = """lk AS (SELECT DISTINCT o_custkey AS pr_id, a, b FROM s_next_parts JOIN orders ON o_orderkey = sha WHERE a <> b),
adj AS (SELECT pr_id, a, b FROM lk UNION SELECT pr_id, b, a FROM lk),
sd AS (SELECT DISTINCT pr_id, a AS id FROM adj WHERE a % 10 = 0),
fill AS (SELECT pr_id, id AS seed, id AS node, 0 AS hop FROM sd UNION SELECT f.pr_id, f.seed, adj.b, f.hop + 1 FROM fill f JOIN adj ON adj.pr_id = f.pr_id AND adj.a = f.node WHERE f.hop < 3)
"""


def request_graph(spark, sf):
    """Seeds and neighbour pairs by customer: the same parts lie in many requests, linked in other ways."""
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("pr_id"))
    links = t.next_parts(spark, sf).filter(F.col("a") != F.col("b")).join(orders, "sha").select("pr_id", "a", "b")
    pairs = g.adjacency(links)
    seeds = pairs.filter(F.col("src") % 10 == 0).select("pr_id", F.col("src").alias("id")).distinct()
    return seeds.withColumn("seed_ord", F.col("id")), pairs


@query("flood_fill_by_request", with_views("s_next_parts", REQUEST_REACH + "SELECT pr_id, seed, node, min(hop) AS hop FROM fill GROUP BY ALL"))
def flood_fill_by_request(spark, sf):
    return g.flood_fill(*request_graph(spark, sf))


@query("fill_starters", with_views("s_edges s_seeds", STARTERS + "SELECT id FROM st"))
def fill_starters(spark, sf):
    return g.fill_starters(t.seeds(spark, sf), g.adjacency(t.edges(spark, sf), NOKEY), NOKEY).select("id")


def merged(spark, sf):
    """Seeds, neighbour pairs and components of the stand-in graph."""
    pairs = g.adjacency(t.edges(spark, sf), NOKEY)
    seeds = t.seeds(spark, sf)
    starters = g.fill_starters(seeds, pairs, NOKEY)
    return seeds, pairs, g.merge_fills(starters, pairs, NOKEY)


@query("components", with_views("s_edges s_seeds", COMPONENTS + "SELECT node, comp FROM comp"))
def components(spark, sf):
    return merged(spark, sf)[2]


@query("components_by_request", with_views("s_next_parts", REQUEST_REACH + """,
near AS (SELECT DISTINCT pr_id, seed, node FROM fill),
earlier AS (SELECT n.pr_id, n.node AS id, list(n.seed) AS who FROM near n JOIN sd ON sd.pr_id = n.pr_id AND sd.id = n.node WHERE n.seed < n.node GROUP BY 1, 2),
line AS MATERIALIZED (SELECT sd.pr_id, sd.id, row_number() OVER (PARTITION BY sd.pr_id ORDER BY sd.id) AS i, coalesce(e.who, []) AS who FROM sd LEFT JOIN earlier e USING (pr_id, id)),
walk AS (SELECT DISTINCT pr_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS chosen FROM sd
         UNION ALL SELECT w.pr_id, l.i, CASE WHEN list_has_any(w.chosen, l.who) THEN w.chosen ELSE list_append(w.chosen, l.id) END FROM walk w JOIN line l ON l.pr_id = w.pr_id AND l.i = w.i + 1),
st AS (SELECT pr_id, unnest(arg_max(chosen, i)) AS seed FROM walk GROUP BY pr_id),
ball AS (SELECT pr_id, seed, node FROM near JOIN st USING (pr_id, seed)),
lap AS (SELECT DISTINCT x.pr_id, x.seed AS s1, y.seed AS s2 FROM ball x JOIN ball y USING (pr_id, node)),
clo AS (SELECT pr_id, seed AS s1, seed AS s2 FROM st UNION SELECT c.pr_id, c.s1, lap.s2 FROM clo c JOIN lap ON lap.pr_id = c.pr_id AND lap.s1 = c.s2)
SELECT b.pr_id, b.node, min(o.node) AS comp FROM ball b JOIN clo ON clo.pr_id = b.pr_id AND clo.s1 = b.seed JOIN ball o ON o.pr_id = clo.pr_id AND o.seed = clo.s2 GROUP BY 1, 2"""))
def components_by_request(spark, sf):
    seeds, pairs = request_graph(spark, sf)
    return g.merge_fills(g.fill_starters(seeds, pairs), pairs)


@query("seed_map", with_views("s_edges s_seeds", COMPONENTS + "SELECT s.id, s.seed_ord, comp.comp FROM s_seeds s JOIN comp ON comp.node = s.id"))
def seed_map(spark, sf):
    seeds, _, nodes = merged(spark, sf)
    return g.seed_map(seeds, nodes, NOKEY)


def refs(spark, sf):
    return t.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("refs"))


def named_seeds(spark, sf, nodes, seeds):
    names = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    d = g.seed_map(seeds, nodes, NOKEY).join(names, "id").join(refs(spark, sf), "id", "left")
    return d.withColumn("refs", F.coalesce("refs", F.lit(0).cast("long")))


SEEDS = COMPONENTS + """,
rf AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS refs FROM part),
sd AS (SELECT s.id, s.seed_ord, comp.comp, rf.name, rf.refs FROM s_seeds s JOIN comp ON comp.node = s.id JOIN rf ON rf.id = s.id)
"""


@query("component_name", with_views("s_edges s_seeds", SEEDS + "SELECT comp, name FROM sd QUALIFY row_number() OVER (PARTITION BY comp ORDER BY refs DESC, seed_ord) = 1"))
def component_name(spark, sf):
    seeds, _, nodes = merged(spark, sf)
    return g.component_name(named_seeds(spark, sf, nodes, seeds), NOKEY)


@query("component_origin", with_views("s_edges s_seeds", SEEDS + """
SELECT comp, 'derived from changed symbols ' || array_to_string(list_slice(list(name ORDER BY seed_ord), 1, 6), ', ')
  || CASE WHEN count(*) > 6 THEN ' and ' || (count(*) - 6) || ' more' ELSE '' END || ' · def−use edges · 3-hop reach' AS origin FROM sd GROUP BY comp"""))
def component_origin(spark, sf):
    seeds, _, nodes = merged(spark, sf)
    return g.component_origin(named_seeds(spark, sf, nodes, seeds), NOKEY)


SURFACE = """rf AS (SELECT p_partkey AS id, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS refs FROM part),
sd AS (SELECT p.p_brand AS comp, s.id, s.seed_ord, rf.refs, row_number() OVER (PARTITION BY p.p_brand ORDER BY rf.refs DESC, s.seed_ord) AS rk
       FROM s_seeds s JOIN part p ON p.p_partkey = s.id JOIN rf ON rf.id = s.id),
adj AS (SELECT a, b FROM s_edges UNION SELECT b, a FROM s_edges),
nb AS (SELECT sd.comp, adj.b AS id, min(sd.seed_ord) AS so FROM sd JOIN adj ON adj.a = sd.id GROUP BY 1, 2),
nr AS (SELECT nb.comp, nb.id, rf.refs, row_number() OVER (PARTITION BY nb.comp ORDER BY rf.refs DESC, so, nb.id) AS rk FROM nb JOIN rf USING (id)
       WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.comp = nb.comp AND sd.id = nb.id AND sd.rk <= 14)),
un AS (SELECT comp, id, refs, 0 AS tier, rk FROM sd WHERE rk <= 14
       UNION ALL SELECT comp, id, refs, 1, rk FROM nr WHERE rk <= 16 - (SELECT count(*) FROM sd WHERE sd.comp = nr.comp AND sd.rk <= 14)),
ds AS (SELECT comp, id, CAST(row_number() OVER (PARTITION BY comp ORDER BY refs DESC, tier, rk) AS INTEGER) AS pos FROM un)
"""


def brand_seeds(spark, sf):
    brand = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("comp"))
    return t.seeds(spark, sf).join(brand, "id").join(refs(spark, sf), "id", "left").withColumn("refs", F.coalesce("refs", F.lit(0).cast("long")))


def surface(spark, sf):
    every = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(refs(spark, sf), "id", "left")
    every = every.withColumn("refs", F.coalesce("refs", F.lit(0).cast("long")))
    return g.display_surface(brand_seeds(spark, sf), g.adjacency(t.edges(spark, sf), NOKEY), every, NOKEY)


@query("display_surface", with_views("s_edges s_seeds", SURFACE + "SELECT * FROM ds"))
def display_surface(spark, sf):
    return surface(spark, sf)


@query("display_entries", with_views("s_edges s_seeds", SURFACE + """
SELECT DISTINCT ds.id AS entry_id, p_type AS kind, p_name AS name, p_type || ' in f' || (p_partkey % 100) AS summary, rf.refs, ds.id % 10 = 0 AS seed
FROM ds JOIN part ON p_partkey = ds.id AND p_brand = ds.comp JOIN rf ON rf.id = ds.id"""))
def display_entries(spark, sf):
    """A node counts as reached by the component of its own brand."""
    part = t.table(spark, sf, "part")
    nodes = part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("comp"))
    defs = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"),
                       F.concat(F.lit("f"), (F.col("p_partkey") % 100).cast("string")).alias("file"))
    defs = defs.join(refs(spark, sf), "id", "left").withColumn("refs", F.coalesce("refs", F.lit(0).cast("long")))
    return g.entries(surface(spark, sf), nodes, defs, t.seeds(spark, sf), NOKEY)


@query("collect_edges", """WITH s AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_orderkey AS f, l_linenumber AS ln FROM lineitem)
SELECT a, b, count(*) AS refs, array_to_string(list_slice(list(f || ':' || ln ORDER BY f, ln), 1, 3), ' ') AS sites FROM s WHERE a <> b GROUP BY a, b""")
def collect_edges(spark, sf):
    """Parts refer to their suppliers, each order line is a site; equal ids are a reference to oneself."""
    s = t.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    d = g.collect_edges(s, NOKEY)
    site = F.transform("sites", lambda x: F.concat(x["file"].cast("string"), F.lit(":"), x["line"].cast("string")))
    return d.select("a", "b", "refs", F.array_join(site, " ").alias("sites"))


@query("site_context", """WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT file, line, left(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), 160) AS text, greatest(1, line - 3) AS ctx_start,
  (SELECT string_agg(left(regexp_replace(b.text, '[\\s\\p{Z}]+$', ''), 200), chr(10) ORDER BY b.line) FROM l b WHERE b.file = a.file AND b.line BETWEEN a.line - 3 AND a.line + 3) AS ctx
FROM l a""")
def site_context(spark, sf):
    d = t.table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    source = d.select("file", (F.col("i").cast("long") + 1).alias("line"), "text")
    out = g.site_context(source.select("file", "line"), source, ["file"])
    return out.withColumn("ctx", F.array_join("ctx", "\n"))


ENTRY_SQL = "en AS (SELECT p_partkey AS entry_id, p_name AS name, p_brand AS comp_id, p_partkey % 10 = 0 AS seed FROM part)"
KIND = ENTRY_SQL + """,
ek AS (SELECT e.a, e.b, CASE WHEN x.seed AND y.seed THEN 'co' WHEN y.seed THEN 'risk' WHEN x.seed THEN 'out' ELSE 'quiet' END AS kind
       FROM s_edges e JOIN en x ON x.entry_id = e.a JOIN en y ON y.entry_id = e.b)
"""
INNER = ENTRY_SQL + """,
ie AS (SELECT x.comp_id, e.a, e.b FROM s_edges e JOIN en x ON x.entry_id = e.a JOIN en y ON y.entry_id = e.b AND y.comp_id = x.comp_id)
"""


def entry_rows(spark, sf):
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 10 == 0).alias("seed"))


def inner(spark, sf):
    return g.internal_edges(t.edges(spark, sf), t.comp_entries(spark, sf), NOKEY)


@query("edge_kinds", with_views("s_edges", KIND + "SELECT * FROM ek"))
def edge_kinds(spark, sf):
    return g.edge_kinds(t.edges(spark, sf), entry_rows(spark, sf), NOKEY)


@query("edges_of", with_views("s_edges", "SELECT a AS entry_id, 'out' AS direction, b AS other FROM s_edges UNION ALL SELECT b, 'in', a FROM s_edges"))
def edges_of(spark, sf):
    return g.edges_of(t.edges(spark, sf), entry_rows(spark, sf), NOKEY).select("entry_id", "direction", "other")


@query("internal_edges", with_views("s_edges", INNER + "SELECT * FROM ie"))
def internal_edges(spark, sf):
    return inner(spark, sf).select("comp_id", "a", "b")


def traces(spark, sf):
    """Each order line calls the next one's part, under the component of its own part's brand."""
    li = t.next_flagged_parts(spark, sf).select(F.col("a").alias("entry_id"), F.col("sha").alias("pos"),
                                        F.concat(F.lit("calls "), "flag").alias("relation"), F.col("b").alias("object"))
    brand = t.comp_entries(spark, sf).select("entry_id", F.col("comp_id").alias("component"))
    return li.join(brand, "entry_id")


TRACES = """tr AS (SELECT a AS entry_id, sha AS pos, 'calls ' || flag AS relation, b AS object, p_brand AS comp_id
  FROM s_next_parts JOIN part ON p_partkey = a)
"""


@query("trace_edges", with_views("s_next_parts", TRACES + """
SELECT comp_id, entry_id AS a, object AS b, relation AS rel FROM tr JOIN part o ON o.p_partkey = object AND o.p_brand = comp_id
QUALIFY row_number() OVER (PARTITION BY comp_id, least(entry_id, object), greatest(entry_id, object) ORDER BY entry_id, pos, object, relation) = 1"""))
def trace_edges(spark, sf):
    return g.trace_edges(traces(spark, sf), t.comp_entries(spark, sf), NOKEY)


def loose_members(spark, sf):
    """Entries listed by their brand and, every third one, by the next brand in order too."""
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("n"))
    both = F.when(F.col("entry_id") % 3 == 0, F.array(F.col("n"), F.col("n") + 1)).otherwise(F.array("n"))
    return p.select("entry_id", F.explode(both).alias("comp_ord")).withColumn("comp_id", F.concat(F.lit("c"), F.col("comp_ord").cast("string")))


MEMBERS = """mb AS (SELECT entry_id, n + k AS comp_ord, 'c' || (n + k) AS comp_id FROM (SELECT p_partkey AS entry_id, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS n FROM part), range(2) r(k) WHERE k = 0 OR entry_id % 3 = 0),
co AS (SELECT entry_id, arg_min(comp_id, comp_ord) AS comp_id FROM mb GROUP BY entry_id)
"""


@query("component_of", "WITH " + MEMBERS + "SELECT entry_id, comp_id FROM co")
def component_of(spark, sf):
    return g.component_of(loose_members(spark, sf), NOKEY)


CROSS = MEMBERS + """,
x AS (SELECT m.comp_id, co.comp_id AS target, m.entry_id, false AS into_ FROM s_edges e JOIN mb m ON m.entry_id = e.a JOIN co ON co.entry_id = e.b
      WHERE e.b NOT IN (SELECT entry_id FROM mb k WHERE k.comp_id = m.comp_id)
      UNION ALL SELECT m.comp_id, co.comp_id, m.entry_id, true FROM s_edges e JOIN mb m ON m.entry_id = e.b JOIN co ON co.entry_id = e.a
      WHERE e.a NOT IN (SELECT entry_id FROM mb k WHERE k.comp_id = m.comp_id)),
cl AS (SELECT comp_id, target, entry_id, bool_and(into_) AS "into" FROM x GROUP BY ALL)
"""


@query("cross_links", with_views("s_edges", CROSS + "SELECT * FROM cl"))
def cross_links(spark, sf):
    return g.cross_component_links(t.edges(spark, sf), loose_members(spark, sf), keys=NOKEY)


@query("cross_counts", with_views("s_edges", CROSS + """SELECT comp_id, target, count(*) AS entries, count(*) FILTER ("into") AS into_only FROM cl GROUP BY ALL"""))
def cross_counts(spark, sf):
    return g.cross_counts(g.cross_component_links(t.edges(spark, sf), loose_members(spark, sf), keys=NOKEY), NOKEY)


@query("layer_ranks", with_views("s_edges", INNER + """,
up AS (SELECT DISTINCT comp_id, least(a, b) AS a, greatest(a, b) AS b FROM ie),
lp AS (SELECT comp_id, entry_id, CAST(0 AS BIGINT) AS d FROM en UNION SELECT up.comp_id, up.b, lp.d + 1 FROM lp JOIN up ON up.comp_id = lp.comp_id AND up.a = lp.entry_id)
SELECT comp_id, entry_id, max(d) AS "rank" FROM lp GROUP BY ALL"""))
def layer_ranks(spark, sf):
    """The edges inside each brand, turned so that they lead to the later part."""
    up = inner(spark, sf).select("comp_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return g.layer_ranks(t.comp_entries(spark, sf).select("comp_id", "entry_id"), up, NOKEY)


DEGREES = INNER + """, dg AS (SELECT comp_id, e AS entry_id, count(*) AS degree FROM (SELECT comp_id, unnest([a, b]) AS e FROM ie) GROUP BY ALL)"""


@query("degrees", with_views("s_edges", DEGREES + "SELECT * FROM dg"))
def degrees(spark, sf):
    return g.degrees(inner(spark, sf), NOKEY)


@query("hubs", with_views("s_edges", DEGREES + """
SELECT en.comp_id, en.entry_id AS hub, coalesce(degree, 0) AS degree FROM en LEFT JOIN dg ON dg.entry_id = en.entry_id
QUALIFY row_number() OVER (PARTITION BY en.comp_id ORDER BY coalesce(degree, 0) DESC, en.entry_id) = 1"""))
def hubs(spark, sf):
    return g.hubs(t.comp_entries(spark, sf), inner(spark, sf), NOKEY)


@query("risk_report", with_views("s_def_spans s_diff_lines s_edges", CLAMPED + "," + TOUCHED_LINES + """,
ch AS (SELECT def_id FROM c WHERE EXISTS (SELECT 1 FROM tl WHERE tl.path = c.path AND tl.head_line BETWEEN span_start AND span_end))
SELECT p.p_brand AS comp_id, count(*) AS risky_edges, count(DISTINCT e.a) AS callers, count(DISTINCT e.b) AS changed
FROM s_edges e JOIN part p ON p.p_partkey = e.b WHERE e.b IN (SELECT def_id FROM ch) AND e.a NOT IN (SELECT def_id FROM ch) GROUP BY p.p_brand"""))
def risk_report(spark, sf):
    """Diff lines to touched lines to changed symbols to their unchanged callers."""
    touched = diff.changed_head_lines(t.diff_lines(spark, sf), ["path"], new="new_no")
    changed = g.find_seeds(touched, clamped(spark, sf), ["path"]).select(F.col("def_id").alias("entry_id"), F.lit(True).alias("seed"))
    part = t.comp_entries(spark, sf)
    known = part.select("entry_id").join(changed, "entry_id", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    edges = t.edges(spark, sf).join(part.select(F.col("entry_id").alias("b"), "comp_id"), "b")
    return g.risk_report(edges, known, NOKEY)


CALLERS = KIND + """,
un AS (SELECT ek.b AS entry_id, ek.a, en.name, ek.kind FROM ek JOIN en ON en.entry_id = ek.a)
"""


def ordered_edges(spark, sf):
    return t.edges(spark, sf).withColumn("edge_ord", F.col("a") * 100000 + F.col("b"))


@query("untouched_callers", with_views("s_edges", CALLERS + """
SELECT entry_id, count(*) AS total, array_to_string(list_slice(list(name ORDER BY a), 1, 5), ', ') AS names FROM un WHERE kind = 'risk' GROUP BY entry_id"""))
def untouched_callers(spark, sf):
    d = g.untouched_callers(ordered_edges(spark, sf), entry_rows(spark, sf), NOKEY)
    return d.select("entry_id", "total", F.array_join("names", ", ").alias("names"))


@query("connection_order", with_views("s_edges", KIND + """,
al AS (SELECT a AS entry_id, 'out' AS direction, b AS other, kind, a * 100000 + b AS o FROM ek UNION ALL SELECT b, 'in', a, kind, a * 100000 + b FROM ek)
SELECT entry_id, direction, other, kind, row_number() OVER (PARTITION BY entry_id, direction ORDER BY CASE kind WHEN 'risk' THEN 0 WHEN 'co' THEN 1 ELSE 2 END, o) AS pos FROM al"""))
def connection_order(spark, sf):
    d = g.connection_order(ordered_edges(spark, sf), entry_rows(spark, sf), NOKEY)
    return d.select("entry_id", "direction", "other", "kind", "pos")


@query("reach_reason", with_views("s_edges", CALLERS + """,
rs AS (SELECT entry_id, list(name ORDER BY a) AS ns FROM un WHERE kind = 'out' GROUP BY entry_id)
SELECT en.entry_id, CASE WHEN ns IS NULL THEN 'Unchanged. Pulled in from changed code nearby.'
  WHEN len(ns) > 2 THEN 'Unchanged. Reached by ' || ns[1] || ', ' || ns[2] || ' and ' || (len(ns) - 2) || ' more.'
  ELSE 'Unchanged. Reached by ' || array_to_string(ns, ' and ') || '.' END AS reason
FROM en LEFT JOIN rs USING (entry_id) WHERE NOT seed"""))
def reach_reason(spark, sf):
    return g.reach_reason(ordered_edges(spark, sf), entry_rows(spark, sf), NOKEY)
