import random

from patchlore.operators import attribution as at, history as hi
from tests.conftest import rows

CHANGES = "pr_id string, path string, ord long, kind string, line long"
ASKED = "pr_id string, path string, ord long, line long"
BASE = 30


def replay(commits, base=BASE):
    """Versions of a file, oldest first, as lists of (ord, line) origins; commits: [(ord, removed, added)]."""
    versions = [[(None, i + 1) for i in range(base)]]
    for ord_, out, put in commits:
        left = [x for i, x in enumerate(versions[-1], 1) if i not in out]
        for n in sorted(put):
            left.insert(n - 1, (ord_, n))
        versions.append(left)
    return versions


def fates(commits, base=BASE):
    """{(ord, line): (end_ord, end_line)} of every line ever, by looking it up in each version."""
    versions, ended = replay(commits, base), {}
    for (ord_, out, _), before in zip(commits, versions):
        for n in out:
            ended[before[n - 1]] = (ord_, n)
    for n, origin in enumerate(versions[-1], 1):
        ended[origin] = (None, n)
    return ended


def random_history(r, n_commits):
    size, commits = BASE, []
    for ord_ in sorted(r.sample(range(1, 400), n_commits), reverse=True):
        out = set(r.sample(range(1, size + 1), min(size, r.randrange(0, 4))))
        added = r.randrange(0 if out else 1, 5)
        size = size - len(out) + added
        commits.append((ord_, out, set(r.sample(range(1, size + 1), added))))
    return commits


def change_rows(pr, path, commits):
    return [(pr, path, o, k, n) for o, out, put in commits for k, ns in (("del", out), ("add", put)) for n in ns]


def test_random_histories_equal_a_replay(spark, plans):
    r = random.Random(7)
    files = {(f"r{i % 2}", f"f{i}"): random_history(r, n) for i, n in enumerate([1, 2, 3, 6, 9])}
    changes = spark.createDataFrame([x for f, c in files.items() for x in change_rows(*f, c)], CHANGES)
    want = {(*f, *origin): end for f, c in files.items() for origin, end in fates(c).items()}
    asked = spark.createDataFrame(list(want), ASKED)
    ended = hi.follow_lines(asked, changes)
    got = {(x.pr_id, x.path, x.ord, x.line): (x.end_ord, x.end_line) for x in ended.collect()}
    assert got == want
    tracked = ended.filter("ord IS NOT NULL")  # the rows that track_lines gives
    assert rows(hi.head_blame(tracked)) == sorted(((*f, n, o) for f, c in files.items() for n, (o, _) in enumerate(replay(c)[-1], 1) if o), key=str)
    origins = {(x.pr_id, x.path, x.ord, x.line): (x.from_ord, x.from_line if x.from_ord else None) for x in hi.removed_origins(tracked, changes).collect()}
    assert origins == {(*f, *end): (o, n if o else None) for f, c in files.items() for (o, n), end in fates(c).items() if end[0]}


def test_commits_that_leave_the_file_alone(spark):
    changes = spark.createDataFrame([("p", "a", 5, "add", 1), ("p", "a", 3, "del", 2), ("p", "a", 3, "del", 2)], CHANGES)
    asked = [("p", "a", 9, 1), ("p", "a", 4, 2), ("p", "a", 4, 3), ("p", "a", 2, 2), ("p", "other", 4, 8), ("p", None, 4, 8), ("p", "a", 4, None), ("p", "a", 4, 0)]
    got = hi.follow_lines(spark.createDataFrame(asked, ASKED), changes)
    assert rows(got) == [("p", "a", 2, 2, None, 2), ("p", "a", 4, 2, 3, 2), ("p", "a", 4, 3, None, 2), ("p", "a", 9, 1, 3, 2), ("p", "other", 4, 8, None, 8)]


def test_empty(spark):
    none = spark.createDataFrame([], CHANGES)
    assert rows(hi.track_lines(none)) == []
    assert rows(hi.follow_lines(spark.createDataFrame([("p", "a", None, 4)], ASKED), none)) == [("p", "a", None, 4, None, 4)]


def test_equal_texts_go_to_the_commit_that_wrote_that_line(spark):
    """c1 and c3 both write "x", c3 above c1's; text alone would give each line to the wrong commit. c2 removes a base line."""
    written = spark.createDataFrame([("p", "a", "c1", 3, "add", None, 5, "x"), ("p", "a", "c2", 2, "del", 1, None, "y"), ("p", "a", "c3", 1, "add", None, 2, "x"),
                                     ("p", "a", "c3", 1, "ctx", 1, 1, "z")],
                                    "pr_id string, path string, sha string, ord long, kind string, old long, new long, text string")
    lines = spark.createDataFrame([("p", "a", 1, "del", 1, None, "y"), ("p", "a", 2, "add", None, 2, "x"), ("p", "a", 3, "add", None, 5, "x"), ("p", "a", 4, "add", None, 9, "new")],
                                  "pr_id string, path string, idx long, kind string, old long, new long, text string")
    commits = spark.createDataFrame([("p", "c1", 3), ("p", "c2", 2), ("p", "c3", 1)], "pr_id string, sha string, ord long")
    assert rows(hi.attribute_tracked(lines, written, commits), "idx", "by") == [(1, "c2"), (2, "c3"), (3, "c1")]
    assert rows(at.attribute_lines(lines, written, commits, tracked=True), "idx", "by") == [(1, "c2"), (2, "c3"), (3, "c1"), (4, "c3")]


def test_lines_follow_their_file_through_a_rename(spark):
    written = spark.createDataFrame([("p", "a", "c1", 3, "add", None, 2), ("p", "b", "c2", 2, "add", None, 1), ("p", "a", "c3", 1, "add", None, 1)],
                                    "pr_id string, path string, sha string, ord long, kind string, old long, new long")
    lines = spark.createDataFrame([("p", "b", 1, "add", None, 1), ("p", "b", 2, "add", None, 3), ("p", "a", 1, "add", None, 1)],
                                  "pr_id string, path string, idx long, kind string, old long, new long")
    commits = spark.createDataFrame([("p", f"c{i}", 4 - i) for i in (1, 2, 3)], "pr_id string, sha string, ord long")
    renames = spark.createDataFrame([("p", "a", "b", 2)], "pr_id string, old_path string, path string, ord long")
    assert rows(hi.attribute_tracked(lines, written, commits, renames=renames)) == [("p", "a", 1, "c3"), ("p", "b", 1, "c2"), ("p", "b", 2, "c1")]


def test_short_and_long_files_equal_a_replay(spark):
    """Files are replayed in a task, followed by doubling, or both in one call, by their number of rows; repeated rows count once."""
    r = random.Random(11)
    files = {("p", f"f{i}"): random_history(r, n) for i, n in enumerate([1, 4, 8])}
    made = [x for f, c in files.items() for x in change_rows(*f, c)]
    changes = spark.createDataFrame(made + made[::2], CHANGES)
    want = {(*f, *origin): end for f, c in files.items() for origin, end in fates(c).items()}
    asked = spark.createDataFrame([*want, *list(want)[::3]], ASKED)
    for most in (0, 60, 20_000):
        spark.conf.set("patchlore.replay.rows", str(most))
        got = [((x.pr_id, x.path, x.ord, x.line), (x.end_ord, x.end_line)) for x in hi.follow_lines(asked, changes).collect()]
        spark.conf.unset("patchlore.replay.rows")
        assert len(got) == len(want) and dict(got) == want


def test_short_files_take_no_rounds(spark, monkeypatch):
    """Each round writes a table; a short history is followed without them."""
    names, cut = [], hi.cut
    monkeypatch.setattr(hi, "cut", lambda df, name: names.append(name) or cut(df, name))
    changes = spark.createDataFrame(change_rows("p", "a", random_history(random.Random(3), 9)), CHANGES)
    assert hi.track_lines(changes).count() > 0
    assert "line-maps" not in names and "followed" not in names
