"""Seeds, reach, components and edges of the definition-use graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlore.functions.text import context_line, source_line
from patchlore.plans import loops
from patchlore.plans.intervals import CHAR_BIN, LINE_BIN, points_in_spans, spans_hit
from patchlore.plans.scan import by_width, number_rows
from patchlore.plans.skew import skew_join
from patchlore.session import cut

# Limits and sentences that define the results.
MAX_HOPS = 3
SITE_CAP = 3
CONTEXT_LINES = 3
SHOWN_SEEDS = 14
SHOWN_ENTRIES = 16
NAMED_SEEDS = 6
NAMED_CALLERS = 5
NAMED_REASONS = 2
ORIGIN_HEAD = "derived from changed symbols "
ORIGIN_TAIL = " · def−use edges · 3-hop reach"
REACHED_BY = "Unchanged. Reached by "
PULLED_IN = "Unchanged. Pulled in from changed code nearby."

PR = ("pr_id",)


def find_seeds(touched: DataFrame, spans: DataFrame, keys: Sequence[str] = ("pr_id", "path"), line: str = "head_line",
               start: str = "span_start", end: str = "span_end", width: int = LINE_BIN) -> DataFrame:
    """Spans that contain at least one touched head line."""
    return spans_hit(touched, spans, keys, line, start, end, width)


def enclosing_def(uses: DataFrame, spans: DataFrame, keys: Sequence[str] = ("pr_id", "file"), at: str = "start",
                  start: str = "span_start", end: str = "span_end", def_id: str = "caller", width: int = CHAR_BIN) -> DataFrame:
    """Add the innermost top-level definition holding each use; uses outside any are dropped.

    Distinct positions are located once, then joined back to the uses.
    """
    keys = list(keys)
    spots = uses.select(*keys, at).distinct()
    inside = points_in_spans(spots, spans.select(*keys, start, end, def_id), keys, at, start, end, width)
    owner = inside.groupBy(*keys, at).agg(F.max_by(def_id, F.struct(F.col(start), -F.col(end))).alias(def_id))
    return skew_join(uses, owner, keys + [at])


def adjacency(references: DataFrame, keys: Sequence[str] = PR, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected distinct neighbour pairs (src, dst)."""
    return loops.by_source(loops.turned(cut(loops.one_way(references, keys, a, b), "adjacency"), keys), keys)


def flood_fill(seeds: DataFrame, pairs: DataFrame, keys: Sequence[str] = PR, hops: int = MAX_HOPS) -> DataFrame:
    """(keys, seed, node, hop) for the nodes within ``hops`` of each seed.

    The result itself grows with seeds times reach. To group fills use
    ``merge_fills``, which never lists these pairs.
    """
    return loops.reach(seeds.select(*keys, F.col("id").alias("src")), loops.prepare(pairs, keys, ready=True), hops)


def fill_starters(seeds: DataFrame, pairs: DataFrame, keys: Sequence[str] = PR, hops: int = MAX_HOPS) -> DataFrame:
    """Seeds that start a fill: taken by ``seed_ord``, skipping those an earlier fill reached."""
    links = loops.prepare(pairs, keys, ready=True)
    got = loops.first_independent(seeds.select(*keys, F.col("id").alias("src"), "seed_ord"), links, hops, "seed_ord")
    return got.withColumnRenamed("src", "id")


def merge_fills(starters: DataFrame, pairs: DataFrame, keys: Sequence[str] = PR, hops: int = MAX_HOPS) -> DataFrame:
    """(keys, node, comp): fills sharing a node are one component, named by its smallest node.

    Each node takes the name of its nearest starter, which reaches it inside the
    fill. Nodes less than ``hops`` from theirs pass the name on once more: the names
    that meet on a node belong to one component. So one pass over the edges leaves a
    graph of starters only, without a row per (fill, node) pair.
    """
    keys = list(keys)
    links = loops.prepare(pairs, keys, ready=True)
    starts = starters.select(*keys, F.col("id").alias("src")).distinct()
    met = starts.select(*keys, F.col("src").alias("node"), F.col("src").alias("label"))
    if hops > 0:
        inner = loops.send(loops.nearest(starts, links, hops - 1), links)
        met = met.unionByName(inner.select(*keys, F.col("dst").alias("node"), "label")).distinct()
    met = cut(met, "met")
    low = cut(met.groupBy(*keys, "node").agg(F.min("label").alias("low")), "low")
    ties = skew_join(met, low, keys + ["node"]).filter(F.col("label") != F.col("low"))
    linked = loops.prepare(loops.both_ways(ties, keys, "label", "low"), keys)
    groups = loops.components(linked).select(*keys, F.col("src").alias("low"), F.col("label").alias("group"))
    first = low.groupBy(*keys, "low").agg(F.min("node").alias("comp")).join(groups, keys + ["low"], "left")
    first = first.withColumn("group", F.coalesce("group", "low"))
    name = skew_join(first.select(*keys, "low", "group"), first.groupBy(*keys, "group").agg(F.min("comp").alias("comp")), keys + ["group"])
    return skew_join(low, name.select(*keys, "low", "comp"), keys + ["low"]).select(*keys, "node", "comp")


def seed_map(seeds: DataFrame, nodes: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Seeds with their component."""
    return seeds.join(nodes.withColumnRenamed("node", "id"), list(keys) + ["id"])


def component_name(seeds: DataFrame, keys: Sequence[str] = PR, comp: str = "comp") -> DataFrame:
    """Name of the seed with most references, the earliest of those, else ``group-<comp>``."""
    best = F.min(F.struct((-F.col("refs")).alias("r"), "seed_ord", "name")).alias("p")
    named = seeds.groupBy(*keys, comp).agg(best)
    fallback = F.concat(F.lit("group-"), F.col(comp).cast("string"))
    return named.select(*keys, comp, F.coalesce("p.name", fallback).alias("name"))


def first_of(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark keeps only n per group and task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def names_and_rest(rows: DataFrame, group: Sequence[str], order: Sequence[str], n: int, name: str = "name") -> DataFrame:
    """(group, names, total): first ``n`` names as an array and the number of rows."""
    total = rows.groupBy(*group).agg(F.count("*").alias("total"))
    top = first_of(rows, group, [F.col(c) for c in order], n, "_r")
    few = top.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(name).alias("n")))).alias("_top"))
    named = few.select(*group, F.transform("_top", lambda x: x["n"]).alias("names"))
    return total.join(named, list(group))


def component_origin(seeds: DataFrame, keys: Sequence[str] = PR, comp: str = "comp") -> DataFrame:
    """How a component was formed: the first six seed names and the number of others."""
    d = names_and_rest(seeds, list(keys) + [comp], ["seed_ord"], NAMED_SEEDS)
    more = F.when(F.col("total") > NAMED_SEEDS, F.concat(F.lit(" and "), (F.col("total") - NAMED_SEEDS).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(F.lit(ORIGIN_HEAD), F.array_join("names", ", "), more, F.lit(ORIGIN_TAIL))
    return d.select(*keys, comp, text.alias("origin"))


def display_surface(seeds: DataFrame, pairs: DataFrame, refs: DataFrame, keys: Sequence[str] = PR, comp: str = "comp") -> DataFrame:
    """(keys, comp, id, pos): up to 14 seeds by references, then direct neighbours up to 16 in all.

    ``seeds`` has (keys, comp, id, seed_ord, refs), ``refs`` has (keys, id, refs)
    of the indexed top-level definitions. The list is ordered by references.
    """
    keys = list(keys)
    group = keys + [comp]
    top = first_of(seeds.select(*group, "id", "seed_ord", "refs"), group, [F.desc("refs"), F.asc("seed_ord"), F.asc("id")], SHOWN_SEEDS)
    shown = top.select(*group, "id", "refs", F.lit(0).alias("tier"), "rank")
    counts = shown.groupBy(*group).agg(F.count("*").alias("_have"))
    owned = seeds.select(*group, F.col("id").alias("src"), "seed_ord")
    near = skew_join(pairs, owned, keys + ["src"]).groupBy(*group, "dst").agg(F.min("seed_ord").alias("seed_ord"))
    near = near.withColumnRenamed("dst", "id").join(shown.select(*group, "id"), group + ["id"], "left_anti")
    near = near.join(refs, keys + ["id"])
    near = first_of(near, group, [F.desc("refs"), F.asc("seed_ord"), F.asc("id")], SHOWN_ENTRIES)
    near = near.join(counts, group).filter(F.col("rank") <= SHOWN_ENTRIES - F.col("_have"))
    both = shown.unionByName(near.select(*group, "id", "refs", F.lit(1).alias("tier"), "rank"))
    w = Window.partitionBy(*group).orderBy(F.desc("refs"), "tier", "rank")  # at most 16 rows per group
    return both.select(*group, "id", F.row_number().over(w).alias("pos"))


def entries(display: DataFrame, nodes: DataFrame, defs: DataFrame, seeds: DataFrame, keys: Sequence[str] = PR, comp: str = "comp") -> DataFrame:
    """One row per displayed node that the fill reached."""
    keys = list(keys)
    reached = display.join(nodes.withColumnRenamed("node", "id"), keys + [comp, "id"], "left_semi")
    d = reached.select(*keys, "id").distinct().join(defs.select(*keys, "id", "kind", "name", "file", "refs"), keys + ["id"])
    changed = seeds.select(*keys, "id").distinct().withColumn("seed", F.lit(True))
    d = d.join(changed, keys + ["id"], "left")
    summary = F.concat("kind", F.lit(" in "), "file").alias("summary")
    return d.select(*keys, F.col("id").alias("entry_id"), "kind", "name", summary, "refs", F.coalesce("seed", F.lit(False)).alias("seed"))


def collect_edges(sites: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, a, b, refs, sites): distinct (file, line) references and the first three of them."""
    group = list(keys) + ["a", "b"]
    spots = sites.filter(F.col("a") != F.col("b")).select(*group, "file", "line").distinct()
    spots = cut(spots, "sites")
    total = spots.groupBy(*group).agg(F.count("*").alias("refs"))
    top = first_of(spots, group, [F.col("file"), F.col("line")], SITE_CAP)
    few = top.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("sites"))
    return total.join(few, group)


def site_context(sites: DataFrame, source: DataFrame, keys: Sequence[str] = ("pr_id", "file"), line: str = "line", text: str = "text") -> DataFrame:
    """(keys, line, text, ctx, ctx_start): each distinct site with the source lines around it.

    A site asks for its seven lines by an equi join, so no range scan is needed.
    A site whose file or line is not there keeps an empty text.
    """
    keys = list(keys)
    near = F.explode(F.sequence(F.col(line) - CONTEXT_LINES, F.col(line) + CONTEXT_LINES))
    asked = sites.select(*keys, line).distinct().select(*keys, F.col(line).alias("_at"), near.alias(line))
    got = asked.join(source.select(*keys, line, text, F.lit(True).alias("_there")), keys + [line], "left")
    own = F.max(F.when(F.col(line) == F.col("_at"), source_line(F.col(text))))
    rows = F.array_sort(F.collect_list(F.when(F.col("_there"), F.struct(F.col(line).alias("l"), context_line(F.col(text)).alias("t")))))
    d = got.groupBy(*keys, "_at").agg(F.coalesce(own, F.lit("")).alias("text"), rows.alias("_rows"), F.coalesce(F.min(F.when(F.col("_there"), F.col(line))), F.greatest(F.min(line), F.lit(1))).alias("ctx_start"))
    return d.select(*keys, F.col("_at").alias(line), "text", F.transform("_rows", lambda x: x["t"]).alias("ctx"), "ctx_start")


def _end(entries_: DataFrame, keys: Sequence[str], end: str) -> DataFrame:
    return entries_.select(*keys, F.col("entry_id").alias(end), F.col("seed").alias(f"seed_{end}"))


def edge_kinds(edges: DataFrame, entries_: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Add ``kind``: co, risk, out or quiet by which ends changed (an unknown end did not).

    An end may be a hub; its single entry row is then copied over the salts.
    """
    d = skew_join(edges, _end(entries_, keys, "a"), list(keys) + ["a"], "left")
    d = skew_join(d, _end(entries_, keys, "b"), list(keys) + ["b"], "left")
    a, b = F.coalesce("seed_a", F.lit(False)), F.coalesce("seed_b", F.lit(False))
    kind = F.when(a & b, "co").when(b, "risk").when(a, "out").otherwise("quiet")
    return d.withColumn("kind", kind).drop("seed_a", "seed_b")


def edges_of(edges: DataFrame, entries_: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Each known entry with its edges: (keys, entry_id, direction, other, edge columns)."""
    keys = list(keys)
    known = entries_.select(*keys, F.col("entry_id").alias("a"), F.lit(True).alias("_ka"))
    d = skew_join(edges, known, keys + ["a"], "left")
    d = skew_join(d, known.withColumnsRenamed({"a": "b", "_ka": "_kb"}), keys + ["b"], "left")
    ends = F.array(F.struct(F.col("a").alias("entry_id"), F.lit("out").alias("direction"), F.col("b").alias("other")),
                   F.struct(F.col("b").alias("entry_id"), F.lit("in").alias("direction"), F.col("a").alias("other")))
    d = d.filter(F.col("_ka") & F.col("_kb")).drop("_ka", "_kb").withColumn("_e", F.explode(ends))
    return d.select("*", "_e.*").drop("_e")


def internal_edges(edges: DataFrame, members: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Edges with both ends in a component, once per such component."""
    keys = list(keys)
    m = members.select(*keys, "comp_id", "entry_id")
    d = skew_join(edges, m.withColumnRenamed("entry_id", "a"), keys + ["a"])
    return skew_join(d, m.withColumnRenamed("entry_id", "b"), keys + ["comp_id", "b"])


def trace_edges(traces: DataFrame, members: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Undirected distinct pairs from trace links inside a component; the first relation names the pair.

    ``traces`` has (keys, entry_id, pos, relation, component, object), ``members``
    also ``pos``: links are taken in entry order, then link order.
    """
    keys = list(keys)
    m = members.select(*keys, "comp_id", "entry_id", F.col("pos").alias("_mp"))
    t = traces.filter(F.col("object").isNotNull()).withColumnRenamed("component", "comp_id")
    d = skew_join(t, m, keys + ["comp_id", "entry_id"])
    d = skew_join(d, m.select(*keys, "comp_id", F.col("entry_id").alias("object")), keys + ["comp_id", "object"])
    pair = keys + ["comp_id", F.least("entry_id", "object").alias("lo"), F.greatest("entry_id", "object").alias("hi")]
    best = F.min(F.struct("_mp", "pos", F.col("entry_id").alias("a"), F.col("object").alias("b"), "relation")).alias("p")
    return d.groupBy(*pair).agg(best).select(*keys, "comp_id", "p.a", "p.b", F.col("p.relation").alias("rel"))


def component_of(members: DataFrame, keys: Sequence[str] = PR, order: str = "comp_ord") -> DataFrame:
    """First component, in page order, that lists an entry."""
    return members.groupBy(*keys, "entry_id").agg(F.min_by("comp_id", order).alias("comp_id"))


def cross_component_links(edges: DataFrame, members: DataFrame, traces: DataFrame | None = None, keys: Sequence[str] = PR,
                          order: str = "comp_ord") -> DataFrame:
    """(keys, comp_id, target, entry_id, into): links from a component's entries to other components.

    ``into`` is true when the only links point into the entry; an outgoing link
    or a trace link to the other component makes it false.
    """
    keys = list(keys)
    m = cut(members, "members")
    home = component_of(m, keys, order)
    sides = []
    for mine, other, into in (("a", "b", False), ("b", "a", True)):
        inside = skew_join(edges.select(*keys, "a", "b"), m.select(*keys, "comp_id", F.col("entry_id").alias(mine)), keys + [mine])
        gone = m.select(*keys, "comp_id", F.col("entry_id").alias(other))
        gone = skew_join(inside, gone, keys + ["comp_id", other], "left_anti")
        there = home.select(*keys, F.col("entry_id").alias(other), F.col("comp_id").alias("target"))
        d = skew_join(gone, there, keys + [other])
        sides.append(d.select(*keys, "comp_id", "target", F.col(mine).alias("entry_id"), F.lit(into).alias("into")))
    links = sides[0].unionByName(sides[1])
    if traces is not None:
        t = traces.filter(F.col("component").isNotNull()).select(*keys, "entry_id", F.col("component").alias("target"))
        t = skew_join(t, m.select(*keys, "comp_id", "entry_id"), keys + ["entry_id"]).filter(F.col("target") != F.col("comp_id"))
        links = links.unionByName(t.select(*keys, "comp_id", "target", "entry_id", F.lit(False).alias("into")))
    return links.groupBy(*keys, "comp_id", "target", "entry_id").agg(F.min("into").alias("into"))


def cross_counts(links: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    return links.groupBy(*keys, "comp_id", "target").agg(F.count("*").alias("entries"), F.count_if("into").alias("into_only"))


def layer_ranks(members: DataFrame, inner: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """(keys, comp_id, entry_id, rank): longest path from a component's top callers.

    A component with a cycle stops after as many passes as it has entries.
    """
    keys = list(keys) + ["comp_id"]
    size = members.groupBy(*keys).agg(F.count("*").alias("passes"))
    nodes = skew_join(members.select(*keys, F.col("entry_id").alias("src")), size, keys)
    pairs = inner.filter(F.col("a") != F.col("b")).select(*keys, F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return loops.longest_path(nodes, loops.prepare(pairs, keys)).withColumnRenamed("src", "entry_id")


def degrees(inner: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    ends = inner.select(*keys, "comp_id", F.explode(F.array("a", "b")).alias("entry_id"))
    return ends.groupBy(*keys, "comp_id", "entry_id").agg(F.count("*").alias("degree"))


def hubs(members: DataFrame, inner: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Entry of highest degree per component, the first of equals."""
    keys = list(keys)
    d = members.join(degrees(inner, keys), keys + ["comp_id", "entry_id"], "left")
    deg = F.coalesce("degree", F.lit(0)).alias("degree")
    best = F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "pos", "entry_id")).alias("p")
    top = d.select(*keys, "comp_id", "entry_id", "pos", deg).groupBy(*keys, "comp_id").agg(best)
    return top.select(*keys, "comp_id", F.col("p.entry_id").alias("hub"), (-F.col("p.d")).alias("degree"))


def risk_edges(inner: DataFrame, entries_: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Edges from an unchanged caller into changed code."""
    return edge_kinds(inner, entries_, keys).filter(F.col("kind") == "risk")


def risk_report(inner: DataFrame, entries_: DataFrame, keys: Sequence[str] = PR) -> DataFrame:
    """Number of risky edges per component that has any, and how many callers and callees they join."""
    r = risk_edges(inner, entries_, keys)
    return r.groupBy(*keys, "comp_id").agg(F.count("*").alias("risky_edges"), F.countDistinct("a").alias("callers"),
                                           F.countDistinct("b").alias("changed"))


def _callers(edges: DataFrame, entries_: DataFrame, keys: list[str], callee_changed: bool, caller_changed: bool) -> DataFrame:
    caller = entries_.select(*keys, F.col("entry_id").alias("a"), F.col("name").alias("name"), F.col("seed").alias("_sa"))
    d = skew_join(edges, caller, keys + ["a"]).filter(F.col("_sa") == caller_changed)
    callee = entries_.select(*keys, F.col("entry_id").alias("b"), F.col("seed").alias("_sb"))
    return skew_join(d, callee, keys + ["b"]).filter(F.col("_sb") == callee_changed).withColumnRenamed("b", "entry_id")


def untouched_callers(edges: DataFrame, entries_: DataFrame, keys: Sequence[str] = PR, order: str = "edge_ord") -> DataFrame:
    """Per changed entry with any: number and first five names of its unchanged callers."""
    keys = list(keys)
    return names_and_rest(_callers(edges, entries_, keys, True, False), keys + ["entry_id"], [order], NAMED_CALLERS)


def connection_order(edges: DataFrame, entries_: DataFrame, keys: Sequence[str] = PR, order: str = "edge_ord",
                     width: int | None = None) -> DataFrame:
    """Edges of an entry per direction: risk first, then co, then the rest, each in edge order."""
    d = cut(edges_of(cut(edge_kinds(edges, entries_, keys), "kinds"), entries_, keys), "ends")
    d = d.withColumn("_w", F.when(F.col("kind") == "risk", 0).when(F.col("kind") == "co", 1).otherwise(2))
    block = F.col("_w") * F.lit(1 << 45) + by_width(order, width)
    return number_rows(d, list(keys) + ["entry_id", "direction"], ["_w", order], block, "pos").drop("_w")


def reach_reason(edges: DataFrame, entries_: DataFrame, keys: Sequence[str] = PR, order: str = "edge_ord") -> DataFrame:
    """Why an unchanged entry is shown: its changed callers by name, else nearby code."""
    keys = list(keys)
    d = names_and_rest(_callers(edges, entries_, keys, False, True), keys + ["entry_id"], [order], NAMED_REASONS)
    rest = F.col("total") - F.size("names")
    joined = (F.when(rest > 0, F.concat(F.array_join("names", ", "), F.lit(" and "), rest.cast("string"), F.lit(" more.")))
              .otherwise(F.concat(F.array_join("names", " and "), F.lit("."))))
    plain = entries_.filter(~F.col("seed")).select(*keys, "entry_id")
    out = plain.join(d.withColumn("_why", F.concat(F.lit(REACHED_BY), joined)), keys + ["entry_id"], "left")
    return out.select(*keys, "entry_id", F.coalesce("_why", F.lit(PULLED_IN)).alias("reason"))
