import random
from collections import deque

from pyspark.sql import functions as F

from patchlore.operators import graph as g
from tests.conftest import rows


def ball(adj, start, hops=3):
    seen, todo = {start: 0}, deque([start])
    while todo:
        n = todo.popleft()
        if seen[n] < hops:
            for m in adj.get(n, ()):
                if m not in seen:
                    seen[m] = seen[n] + 1
                    todo.append(m)
    return seen


def random_graph(seed, nodes=60, edges=70):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(edges)}
    pairs |= {(0, i) for i in range(1, 12)}  # a hub
    order = rnd.sample(range(nodes), 25)
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    return pairs, order, adj


def test_fills_starters_and_components_match_a_sequential_walk(spark, plans):
    pairs, order, adj = random_graph(5 if plans == "small" else 6)
    near = g.adjacency(spark.createDataFrame(list(pairs), "a long, b long"), [])
    seeds = spark.createDataFrame([(s, i) for i, s in enumerate(order)], "id long, seed_ord long")

    fills = {(s, n, h) for s in order for n, h in ball(adj, s).items()}
    assert set(rows(g.flood_fill(seeds, near, []), "seed", "node", "hop")) == fills

    starters, covered = [], set()
    for s in order:
        if s not in covered:
            starters.append(s)
            covered |= set(ball(adj, s))
    got = g.fill_starters(seeds, near, [])
    assert sorted(r[0] for r in rows(got, "id")) == sorted(starters)

    groups = []
    for s in starters:
        mine = set(ball(adj, s))
        groups, merged = [x for x in groups if not x & mine], mine.union(*[x for x in groups if x & mine])
        groups.append(merged)
    want = sorted((n, min(x)) for x in groups for n in x)
    assert sorted(rows(g.merge_fills(got, near, []), "node", "comp")) == want


def test_seeds_in_a_row_take_turns(spark):
    """Seeds five apart in a path: only each second one is free, whatever the partitioning."""
    path = [(i, i + 1) for i in range(40)]
    near = g.adjacency(spark.createDataFrame(path, "a long, b long").repartition(7), [])
    seeds = spark.createDataFrame([(i, i) for i in range(0, 41, 2)], "id long, seed_ord long").repartition(5)
    assert [r[0] for r in sorted(rows(g.fill_starters(seeds, near, []), "id"))] == list(range(0, 41, 4))


def test_components_of_a_long_path(spark):
    from patchlore.plans import loops
    order = list(range(200))
    random.Random(1).shuffle(order)
    d = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    links = loops.prepare(loops.both_ways(d, []), [])
    assert {r[1] for r in rows(loops.components(links), "src", "label")} == {0}


def test_layer_ranks_with_a_cycle_end(spark, plans):
    members = spark.createDataFrame([("c", i) for i in range(5)] + [("k", i) for i in (7, 8)], "comp_id string, entry_id long")
    inner = spark.createDataFrame([("c", 0, 1), ("c", 1, 2), ("c", 0, 2), ("c", 2, 3), ("k", 7, 8), ("k", 8, 7)], "comp_id string, a long, b long")
    got = dict(((c, e), r) for c, e, r in rows(g.layer_ranks(members, inner, []), "comp_id", "entry_id", "rank"))
    assert [got["c", i] for i in range(5)] == [0, 1, 2, 3, 0]
    assert got["k", 7] == got["k", 8] == 2


def test_edges_keep_three_sites_and_count_all(spark, plans):
    data = [("a", "b", "f.ts", n) for n in (9, 2, 2, 5, 7)] + [("a", "a", "f.ts", 1), ("b", "a", "f.ts", 3)]
    e = g.collect_edges(spark.createDataFrame(data, "a string, b string, file string, line long"), [])
    got = {(a, b): (n, [(s.file, s.line) for s in sites]) for a, b, n, sites in rows(e, "a", "b", "refs", "sites")}
    assert got == {("a", "b"): (4, [("f.ts", 2), ("f.ts", 5), ("f.ts", 7)]), ("b", "a"): (1, [("f.ts", 3)])}


def test_site_context_is_clipped_and_holds_the_line(spark):
    src = spark.createDataFrame([("f", i, f"  line {i}  ") for i in range(1, 7)], "file string, line long, text string")
    got = rows(g.site_context(spark.createDataFrame([("f", 2), ("f", 6)], "file string, line long"), src, ["file"]), "line", "text", "ctx", "ctx_start")
    assert got[0] == (2, "line 2", [f"  line {i}" for i in range(1, 6)], 1)
    assert got[1] == (6, "line 6", [f"  line {i}" for i in range(3, 7)], 3)


def test_display_prefers_seeds_then_neighbours(spark, plans):
    seeds = spark.createDataFrame([("c", i, i, 100 - i) for i in range(15)], "comp string, id long, seed_ord long, refs long")
    refs = spark.createDataFrame([(i, 100 - i) for i in range(15)] + [(i, i) for i in range(50, 60)], "id long, refs long")
    pairs = spark.createDataFrame([(0, i) for i in range(50, 60)] + [(1, 14)], "src long, dst long")
    got = rows(g.display_surface(seeds, pairs, refs, []), "pos", "id")
    assert len(got) == 16 and {r[1] for r in got} == set(range(14)) | {14, 59}
    assert [r[1] for r in sorted(got)][:14] == list(range(14))


def test_edge_kind_of_unknown_ends(spark, plans):
    edges = spark.createDataFrame([("x", "y"), ("x", "u"), ("u", "x"), ("y", "x"), ("y", "u")], "a string, b string")
    entries = spark.createDataFrame([("x", True), ("y", False)], "entry_id string, seed boolean")
    assert rows(g.edge_kinds(edges, entries, []), "a", "b", "kind") == [("u", "x", "risk"), ("x", "u", "out"), ("x", "y", "out"), ("y", "u", "quiet"), ("y", "x", "risk")]


def test_outgoing_cross_link_overrides_incoming(spark, plans):
    edges = spark.createDataFrame([("a", "z"), ("z", "a"), ("z", "b"), ("a", "b")], "a string, b string")
    members = spark.createDataFrame([("c1", "a", 1), ("c1", "b", 1), ("c2", "z", 2)], "comp_id string, entry_id string, comp_ord int")
    got = rows(g.cross_component_links(edges, members, keys=[]), "comp_id", "target", "entry_id", "into")
    assert got == [("c1", "c2", "a", False), ("c1", "c2", "b", True), ("c2", "c1", "z", False)]


def test_a_long_cycle_needs_no_round_per_entry(spark):
    n = 300
    members = spark.createDataFrame([("k", i) for i in range(n)], "comp_id string, entry_id long")
    inner = spark.createDataFrame([("k", i, (i + 1) % 290) for i in range(290)] + [("k", 289, 290), ("k", 290, 291), ("k", 295, 296), ("k", 296, 297)], "comp_id string, a long, b long")
    got = {e: r for e, r in rows(g.layer_ranks(members, inner, []), "entry_id", "rank")}
    assert {got[i] for i in range(292)} == {n} and [got[i] for i in (295, 296, 297, 299)] == [0, 1, 2, 0]


def test_neighbours_are_not_shuffled_again(spark):
    """F7, F12 to F16, F22: what every loop round joins with is stored by its source."""
    near = g.adjacency(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long"), [])
    assert rows(near, "src", "dst") == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    plan = near.groupBy("src").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hot_keys_are_told_apart_from_keys_that_share_a_hash(spark, monkeypatch):
    from patchlore.plans import skew
    monkeypatch.setattr(skew, "HOT_SLOTS", 1)
    d = spark.createDataFrame([(i // 4,) for i in range(40)] + [(77,)] * 30 + [(None,)] * 12, "src long")
    spark.conf.set("patchlore.hot.rows", "10")
    try:
        assert rows(skew.written_hot_keys(d, ["src"]), "src", "_fan") == [(77, 3), (None, 2)]
        assert skew.written_hot_keys(d.filter("src < 77"), ["src"]) is None
    finally:
        spark.conf.unset("patchlore.hot.rows")


def test_components_are_sought_among_starters_that_meet(spark, monkeypatch):
    """F7, F12 to F15: not among all nodes of all fills."""
    from patchlore.plans import loops
    asked, real = [], loops.components
    monkeypatch.setattr(loops, "components", lambda links: asked.append(links.rows.count()) or real(links))
    path = [(i, i + 1) for i in range(100, 116)]  # starters 100, 104, ... share nodes; 200 and 300 stand alone
    near = g.adjacency(spark.createDataFrame(path + [(200, 201), (300, 290)], "a long, b long"), [])
    starters = spark.createDataFrame([(i,) for i in (100, 104, 108, 112, 116, 200, 300, 400)], "id long")
    got = dict(rows(g.merge_fills(starters, near, []), "node", "comp"))
    assert got == {**{i: 100 for i in range(100, 117)}, 200: 200, 201: 200, 290: 290, 300: 290, 400: 400}
    assert asked == [8]  # four pairs of neighbouring starters, both ways


def test_starters_for_any_number_of_hops(spark, plans):
    pairs, order, adj = random_graph(7, nodes=90, edges=80)
    near = g.adjacency(spark.createDataFrame(list(pairs), "a long, b long"), [])
    seeds = spark.createDataFrame([(s, i) for i, s in enumerate(order)], "id long, seed_ord long")
    for hops in (0, 2, 4) if plans == "small" else (1, 5):
        starters, covered = [], set()
        for s in order:
            if s not in covered:
                starters.append(s)
                covered |= set(ball(adj, s, hops))
        assert sorted(r[0] for r in rows(g.fill_starters(seeds, near, [], hops), "id")) == sorted(starters)


def test_flood_fill_passes_on_blocks_of_seeds(spark, monkeypatch):
    """a round writes a row per node and block of seeds, not per node and seed; blocks beyond the first count too."""
    from patchlore.plans import loops
    written, real = [], loops.cut
    monkeypatch.setattr(loops, "cut", lambda d, name="cut": (lambda out: written.append((name, out.count())) or out)(real(d, name)))
    n = 1300
    near = g.adjacency(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(0, i) for i in range(2, n, 9)], "a long, b long"), [])
    adj = {}
    for a, b in rows(near, "src", "dst"):
        adj.setdefault(a, set()).add(b)
    seeds = spark.createDataFrame([(i, i) for i in range(n + 1)], "id long, seed_ord long")
    got = g.flood_fill(seeds, near, [])
    assert set(got.groupBy("seed").agg(F.count("*").alias("n"), F.sum("hop").alias("h"), F.sum("node").alias("s")).collect()) == {
        (s, len(b), sum(b.values()), sum(b)) for s in range(n + 1) for b in [ball(adj, s)]}
    assert sum(c for name, c in written if name == "front") <= 3 * (n + 1) * 8  # 3 rounds; 1301 seeds fill 3 to 8 blocks


def test_flood_fill_sends_lists_of_neighbours(spark, plans, monkeypatch):
    """a round shuffled a row per node, block of seeds and neighbour; now a row of a node takes the list of its neighbours along."""
    from patchlore.plans import loops
    limits = {"NEAR_MOST": 2, "PART_TOLD": 3, "SENT_SEEDS": 0} if plans == "large" else {"BLOCK_WORDS": 1}
    for name, value in limits.items():
        monkeypatch.setattr(loops, name, value)
    pairs, order, adj = random_graph(11, nodes=90, edges=130)
    near = g.adjacency(spark.createDataFrame([(k, a, b) for a, b in pairs for k in ("p", "q")], "pr_id string, a long, b long"))
    seeds = spark.createDataFrame([("p", s) for s in range(90)] + [("q", s) for s in order] + [("q", None), (None, 1)], "pr_id string, id long")
    rounds, real = [], loops.cut
    monkeypatch.setattr(loops, "cut", lambda d, name="cut": (rounds.append(d) if name == "front" else None) or real(d, name))
    got = g.flood_fill(seeds, near)
    want = {(k, s, n, h) for k, some in (("p", range(90)), ("q", order)) for s in some for n, h in ball(adj, s).items()} | {("q", None, None, 0), (None, 1, 1, 0)}
    found = rows(got, "pr_id", "seed", "node", "hop")
    assert set(found) == want and len(found) == len(want)
    for d in rounds:
        above = d._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
        assert "explode(_near" in above  # neighbours become rows after the last shuffle of the round


def test_seeds_with_nulls_start_nothing(spark):
    """They stayed undecided for ever: ``components_by_request`` did not end on requests that are null."""
    near = g.adjacency(spark.createDataFrame([(1, 1, 2), (None, 5, 6)], "pr_id long, a long, b long"))
    seeds = spark.createDataFrame([(1, 1, 1), (None, 5, 5), (1, None, 9)], "pr_id long, id long, seed_ord long")
    got = g.fill_starters(seeds, near)
    assert rows(got, "pr_id", "id") == [(1, 1)]
    assert rows(g.merge_fills(got, near), "pr_id", "node", "comp") == [(1, 1, 1), (1, 2, 1)]
