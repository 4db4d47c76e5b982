import random

from patchlore.operators import attribution as at, identity as ids
from tests.conftest import rows

RENAMES = "pr_id string, old_path string, path string, ord long"
WRITTEN = "pr_id string, path string, ord long"


def follow(path, ord_, events):
    """Head path of (path, ord) by walking commits from old to new; events: {ord: {old: new}}."""
    for at_ in sorted((o for o in events if o < ord_), reverse=True):
        if path in events[at_]:
            path = events[at_][path]
            if path is None:
                return None
    return path


def heads(spark, renames, asked):
    got = ids.head_paths(spark.createDataFrame([("p", *a) for a in asked], WRITTEN), spark.createDataFrame([("p", *r) for r in renames], RENAMES))
    return {(r.path, r.ord): r.head_path for r in got.collect()}


def test_chain_swap_reuse_and_removal(spark, plans):
    renames = [("a", "b", 9), ("b", "c", 6), ("x", "y", 5), ("y", "x", 5), ("gone", None, 4), ("old", "new", 3), ("new", "old", 2)]
    asked = [("a", 10), ("a", 9), ("a", 1), ("b", 7), ("b", 6), ("x", 8), ("y", 8), ("x", 2), ("gone", 5), ("gone", 3), ("old", 4), ("new", 4), ("c", 9)]
    assert heads(spark, renames, asked) == {
        ("a", 10): "c", ("a", 9): "a", ("a", 1): "a", ("b", 7): "c", ("b", 6): "b", ("x", 8): "y", ("y", 8): "x", ("x", 2): "x",
        ("gone", 5): None, ("gone", 3): "gone", ("old", 4): "old", ("new", 4): "old", ("c", 9): "c"}


def test_random_histories_equal_a_walk(spark, plans):
    r = random.Random(4)
    renames, asked, want = [], [], {}
    for request in range(12):
        events = {}
        for _ in range(25):
            events.setdefault(r.randrange(1, 30), {})[r.choice("abcde")] = r.choice(["a", "b", "c", "d", "e", None])
        renames += [(f"r{request}", old, new, o) for o, m in events.items() for old, new in m.items()]
        for path in "abcdef":
            for o in range(1, 32):
                asked.append((f"r{request}", path, o))
                want[f"r{request}", path, o] = follow(path, o, events)
    got = ids.head_paths(spark.createDataFrame(asked, WRITTEN), spark.createDataFrame(renames, RENAMES))
    assert {(x.pr_id, x.path, x.ord): x.head_path for x in got.collect()} == want


def test_long_chain_of_renames(spark):
    n = 500
    assert heads(spark, [(f"v{i}", f"v{i + 1}", n - i) for i in range(n)], [("v0", n + 1), ("v250", 251), ("v250", 249)]) == {
        ("v0", n + 1): f"v{n}", ("v250", 251): f"v{n}", ("v250", 249): "v250"}


def test_no_renames(spark):
    assert heads(spark, [], [("a", 1)]) == {("a", 1): "a"}


def test_lines_of_a_reused_path_stay_with_their_file(spark, plans):
    """c1 writes x in a, c2 renames a to b, c3 writes x in a new a: b's line is by c1, a's by c3."""
    lines = spark.createDataFrame([("p", "b", 1, "add", None, 1, "x"), ("p", "a", 1, "add", None, 1, "x"), ("p", "b", 2, "del", 4, None, "y")],
                                  "pr_id string, path string, idx long, kind string, old long, new long, text string")
    written = spark.createDataFrame([("p", "a", "c1", 3, 1, "add", "x"), ("p", "a", "c3", 1, 1, "add", "x"), ("p", "a", "c1", 3, 2, "del", "y"), ("p", "a", "c3", 1, 2, "del", "y")],
                                    "pr_id string, path string, sha string, ord long, line_idx long, kind string, text string")
    commits = spark.createDataFrame([("p", "c1", 3), ("p", "c2", 2), ("p", "c3", 1)], "pr_id string, sha string, ord long")
    renames = spark.createDataFrame([("p", "a", "b", 2)], RENAMES)
    got = at.attribute_lines(lines, written, commits, renames=renames)
    assert rows(got, "path", "idx", "by") == [("a", 1, "c3"), ("b", 1, "c1"), ("b", 2, "c1")]
