import random

from pyspark.sql import functions as F

from patchlore.operators import symbols as sy
from tests.conftest import rows


def export(spark, wanted, tops, rex):
    w = spark.createDataFrame(wanted, "module string, name string")
    t = spark.createDataFrame(tops, "file string, name string, def_id string")
    r = spark.createDataFrame(rex, "file string, pos int, exported string, imported string, module string")
    return {(a, b): c for a, b, c in rows(sy.resolve_export(w, t, r, []))}


def test_export_chains_follow_order_renames_and_survive_cycles(spark, plans):
    tops = [("x", "A", "x#A"), ("y", "A", "y#A"), ("y", "B", "y#B"), ("deep", "C", "deep#C")]
    rex = [("bar", 0, "*", None, "mid"), ("bar", 1, "*", None, "y"), ("mid", 0, "*", None, "bar"), ("mid", 1, "*", None, "x"),
           ("ren", 0, "Z", "B", "y"), ("ren", 1, "*", None, "ren2"), ("ren2", 0, "*", None, "deep")]
    got = export(spark, [("bar", "A"), ("bar", "B"), ("ren", "Z"), ("ren", "C"), ("ren", "B"), ("x", "A"), ("mid", "none")], tops, rex)
    # bar tries mid first (whose own first re-export only leads back), then x below it, before y
    assert got == {("bar", "A"): "x#A", ("bar", "B"): "y#B", ("ren", "Z"): "y#B", ("ren", "C"): "deep#C", ("x", "A"): "x#A"}


def test_a_longer_chain_earlier_in_order_wins(spark, plans):
    tops = [("shared", "A", "shared#A"), ("other", "A", "other#A")]
    rex = [("top", 0, "*", None, "hop"), ("top", 1, "*", None, "shared"), ("hop", 0, "*", None, "shared"), ("hop", 1, "*", None, "other")]
    assert export(spark, [("top", "A")], tops, rex) == {("top", "A"): "shared#A"}


def test_use_rules(spark, plans):
    defs = spark.createDataFrame([("a", "loc", "a#loc", False), ("m", "named", "m#named", True), ("m", "thing", "m#thing", True), ("n", "uni", "n#uni", True),
                                  ("n", "dup", "n#dup", True), ("o", "dup", "o#dup", True), ("m", "hidden", "m#hidden", False)],
                                 "file string, name string, def_id string, top_level boolean")
    imports = spark.createDataFrame([("a", 0, "loc", "named", "m", "named"), ("a", 1, "alias", "named", "m", "named"), ("a", 2, "thing", None, "m", "default"),
                                     ("a", 3, "uni", "absent", "m", "named"), ("b", 0, "ns", None, "m", "namespace")],
                                    "file string, pos int, local_name string, imported string, module string, kind string")
    rex = spark.createDataFrame([], "file string, pos int, exported string, imported string, module string")
    uses = spark.createDataFrame([("a", "loc", False), ("a", "alias", False), ("a", "thing", False), ("a", "uni", False), ("a", "dup", False), ("c", "uni", True),
                                  ("b", "named", True), ("b", "uni", True), ("b", "uni", False), ("b", "hidden", True)], "file string, name string, is_prop boolean")
    got = {(f, n, p): (d, r) for f, n, p, d, r in rows(sy.resolve_uses(uses, defs, imports, rex, []), "file", "name", "is_prop", "def_id", "rule")}
    assert got == {
        ("a", "loc", False): ("a#loc", "local"), ("a", "alias", False): ("m#named", "import"), ("a", "thing", False): ("m#thing", "import"),
        ("a", "uni", False): (None, None),      # the import names nothing and stops the search
        ("a", "dup", False): (None, None), ("c", "uni", True): ("n#uni", "unique"), ("b", "named", True): ("m#named", "namespace"),
        ("b", "uni", True): (None, None),       # a member access stops at the namespaces
        ("b", "uni", False): ("n#uni", "unique"), ("b", "hidden", True): (None, None)}


def test_attached_comment_stops_at_blank_line_and_banner(spark, plans):
    defs = spark.createDataFrame([("d1", 100), ("d2", 100), ("d3", 100), ("d4", 100)], "def_id string, start long")
    notes = spark.createDataFrame([("d1", 10, "// far", "\n\n"), ("d1", 50, "// near", "\n"), ("d2", 10, "// doc", "\n"), ("d2", 50, "// ======", "\n"),
                                   ("d3", 10, "// one", "\n"), ("d3", 50, "// two", "\n  ")], "def_id string, pos long, text string, gap string")
    assert rows(sy.attached_start(defs, notes, []), "def_id", "full") == [("d1", 50), ("d2", 100), ("d3", 10), ("d4", 100)]


def test_mirrors_collapse_onto_preferred_then_shallow(spark, plans):
    data = [("deno/lib/a.ts", "import x from './y.ts'", False), ("src/a.ts", "import x from './y'", False), ("b/c/d.ts", "same", True), ("b.ts", "same", False), ("z.ts", "own", False)]
    d = spark.createDataFrame(data, "path string, text string, preferred boolean")
    assert rows(sy.collapse_mirrors(d, [])) == [("b.ts", "b/c/d.ts"), ("b/c/d.ts", "b/c/d.ts"), ("deno/lib/a.ts", "src/a.ts"), ("src/a.ts", "src/a.ts"), ("z.ts", "z.ts")]


def test_spans_never_overlap_earlier_ones(spark, plans):
    d = spark.createDataFrame([("f", i, s, u, e) for i, (s, u, e) in enumerate([(3, 1, 10), (12, 8, 12), (12, 11, 20), (30, 25, 29)])],
                              "path string, def_id int, start_line long, full_line long, end_line long")
    got = rows(sy.clamp_spans(d, ["path"], ["start_line", "def_id"]), "def_id", "span_start", "span_end")
    assert got == [(0, 1, 10), (1, 11, 12), (2, 13, 20), (3, 25, 29)]


def test_lines_of_offsets(spark, plans):
    src = spark.createDataFrame([("f", "ab\n\ncd"), ("g", "")], "file string, text string")
    offs = spark.createDataFrame([("f", o) for o in (0, 2, 3, 4, 6, 99)] + [("g", 0)], "file string, offset long")
    got = sy.offset_to_line(offs, sy.line_starts(src, ["file"]), ["file"])
    assert rows(got, "file", "offset", "line") == [("f", 0, 1), ("f", 2, 1), ("f", 3, 2), ("f", 4, 3), ("f", 6, 3), ("f", 99, 3), ("g", 0, 1)]


def test_def_ids_drop_unusable_names(spark):
    d = spark.createDataFrame([("f", "x", "const", 0, 1), ("f", "undefined", "const", 2, 3), ("f", "ok", "class", 9, 12), ("f", "fn", "function", 4, 8)],
                              "file string, name string, kind string, start long, end long")
    assert rows(sy.with_def_ids(d, []), "def_id") == [("f#fn#function#0",), ("f#ok#class#1",)]


def test_first_definition_is_the_one_that_starts_first(spark):
    d = spark.createDataFrame([("p", "f.ts", "foo", "f.ts#foo#const#10", 100), ("p", "f.ts", "foo", "f.ts#foo#const#2", 20)], "pr_id string, file string, name string, def_id string, start long")
    assert rows(sy.first_defs(d), "def_id") == [("f.ts#foo#const#2",)]


def depth_first(wanted, tops, rex):
    """Plain search: the own definition, else the matching re-exports in order; a file and name met before give nothing."""
    own = {(f, n): d for f, n, d in tops}

    def look(file, name, met):
        if (file, name) in met:
            return None
        met.add((file, name))
        if (file, name) in own:
            return own[file, name]
        for f, _, exported, imported, module in sorted(rex, key=lambda r: r[1]):
            if f == file and exported in ("*", name):
                got = look(module, name if exported == "*" else imported or name, met)
                if got:
                    return got
        return None
    return {w: d for w in wanted if (d := look(*w, set()))}


def test_random_modules_equal_a_depth_first_search(spark, plans):
    """Forty repositories at once, each a request of its own."""
    all_tops, all_rex, all_wanted, want = [], [], [], {}
    for seed in range(40):
        r = random.Random(seed)
        files, names = [f"f{i}" for i in range(9)], ["a", "b", "c", "default"]
        tops = sorted({(f, n): (f, n, f"{f}#{n}") for f, n in [(r.choice(files), r.choice(names)) for _ in range(7)]}.values())
        rex = []
        for f in files:
            for pos in range(r.choice([0, 1, 1, 1, 2, 3])):
                star = r.random() < .6
                rex.append((f, pos, "*" if star else r.choice(names), None if star or r.random() < .3 else r.choice(names), r.choice(files)))
        wanted = [(f, n) for f in files for n in names]
        want |= {(seed, *w): d for w, d in depth_first(wanted, tops, rex).items()}
        for rows_, into in ((tops, all_tops), (rex, all_rex), (wanted, all_wanted)):
            into += [(seed, *x) for x in rows_]
    got = sy.resolve_export(spark.createDataFrame(all_wanted, "pr_id int, module string, name string"),
                            spark.createDataFrame(all_tops, "pr_id int, file string, name string, def_id string"),
                            spark.createDataFrame(all_rex, "pr_id int, file string, pos int, exported string, imported string, module string"))
    assert {(x.pr_id, x.module, x.name): x.def_id for x in got.collect()} == want and len(want) > len(all_tops) + 100


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    from patchlore.operators import exports
    from patchlore.plans import pointers
    rounds = []
    for module, name in ((exports, "front"), (pointers, "pointers")):
        real = module.cut
        monkeypatch.setattr(module, "cut", lambda df, label="cut", real=real, name=name: (rounds.append(label) if label == name else None, real(df, label))[1])
    n = 300
    order = [f"m{(i * 7919) % n:03d}" for i in range(n)]  # no two neighbours in name order
    rex = [(a, 0, "*", None, b) for a, b in zip(order, order[1:], strict=False)]
    rex += [(f"r{i}", 0, f"x{i}", f"x{i + 1}", f"r{i + 1}") for i in range(n)]        # renamed at every step
    rex += [(f"c{i}", 0, "*", None, f"c{(i + 1) % 40}") for i in range(40)]             # a cycle
    tops = [(order[-1], "far", "far#def"), (order[150], "mid", "mid#def"), (f"r{n}", f"x{n}", "renamed#def"), ("c7", "C", "c7#C")]
    wanted = [(order[0], "far"), (order[0], "mid"), (order[200], "mid"), ("r0", "x0"), ("r5", "x5"), ("r5", "x4"), ("c30", "C"), ("c8", "C"), ("c3", "none")]
    assert export(spark, wanted, tops, rex) == {(order[0], "far"): "far#def", (order[0], "mid"): "mid#def", ("r0", "x0"): "renamed#def", ("r5", "x5"): "renamed#def",
                                                ("c30", "C"): "c7#C", ("c8", "C"): "c7#C"}
    assert rounds.count("front") <= 4 and rounds.count("pointers") <= 40
