from pyspark.sql import functions as F

from patchlore.operators import attribution as at, reports as rp, review as rv
from tests.conftest import rows


def test_read_marks_follow_the_log(spark, plans):
    log = spark.createDataFrame([("p", 1, "toggle", "a"), ("p", 2, "toggle", "a"), ("p", 3, "toggle", "b"), ("q", 1, "toggle", "a"), ("q", 2, "mark", None), ("q", 3, "toggle", "a"),
                                 ("r", 1, "mark", None), ("r", 2, "reset", None), ("r", 3, "toggle", "c")], "pr_id string, at int, action string, id string")
    marked = spark.createDataFrame([("q", "a", 2), ("q", "b", 2), ("r", "a", 1)], "pr_id string, id string, at int")
    assert rows(rv.read_state(log, marked, ["pr_id"]), "pr_id", "id", "read") == [("p", "a", False), ("p", "b", True), ("q", "a", False), ("q", "b", True), ("r", "c", True)]


def ageing(spark, reviewed_at, seen):
    lines = spark.createDataFrame([("p", "a", "s1", "add"), ("p", "a", "s2", "del"), ("p", "b", "s1", "add"), ("p", "b", "s2", "ctx"), ("p", "b", None, "add")],
                                  "pr_id string, id string, by string, kind string")
    ids = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "rest:c")], "pr_id string, id string")
    states = spark.createDataFrame([("ann", "p", reviewed_at)], "reviewer string, pr_id string, reviewed_at long")
    seen = spark.createDataFrame([("ann", "p", s) for s in seen], "reviewer string, pr_id string, sha string")
    counts = rv.written_counts(lines)
    fresh = rv.new_since_checkpoint(ids, counts, states, seen)
    read = ids.withColumn("reviewer", F.lit("ann"))
    whole = rv.new_line_count(counts, states, seen, per_id=False)
    return rows(rv.is_read(fresh, read), "id", "fresh", "read"), [r[0] for r in rows(whole, "new_lines")]


def test_a_push_unreads_only_what_it_touched(spark, plans):
    assert ageing(spark, 5, ["s1"]) == ([("a", 1, False), ("b", 0, True), ("rest:c", 0, True)], [])
    # ticked by hand, never checkpointed: ticks hold, yet every added line counts as new
    assert ageing(spark, 0, []) == ([("a", 0, True), ("b", 0, True), ("rest:c", 0, True)], [2])
    # a checkpoint none of whose commits survived brings everything back
    assert ageing(spark, 5, [])[0] == [("a", 2, False), ("b", 1, False), ("rest:c", 0, True)]


def test_rewritten_branch(spark, plans):
    commits = spark.createDataFrame([("p", f"s{i}", "m") for i in range(4)], "pr_id string, sha string, message string")
    seen = spark.createDataFrame([("ann", "p", f"s{i}") for i in range(2, 12)] + [("bob", "p", f"s{i}") for i in range(1, 11)], "reviewer string, pr_id string, sha string")
    states = spark.createDataFrame([("ann", "p"), ("bob", "p"), ("cat", "p")], "reviewer string, pr_id string")
    got = rows(rv.branch_rewritten(states, seen, commits), "reviewer", "seen", "known", "rewritten")
    assert got == [("ann", 10, 2, True), ("bob", 10, 3, False), ("cat", 0, 0, False)]


def test_threads_land_on_the_first_row_that_reaches_them(spark, plans):
    r = spark.createDataFrame([("f", 1, None, 5), ("f", 2, 40, None), ("f", 3, None, 6), ("f", 4, None, 50)], "path string, idx long, old long, new long")
    th = spark.createDataFrame([("f", i, n) for i, n in enumerate([3, 5, 6, 40, 41, 51])], "path string, thread_id int, line long")
    assert rows(rv.place_threads(r, th, ["path"]), "line", "idx") == [(3, 1), (40, 2), (41, 4), (5, 1), (51, None), (6, 2)]
    assert rows(rv.place_threads_exact(r, th, ["path"]), "line", "idx") == [(3, None), (40, 2), (41, None), (5, 1), (51, None), (6, 3)]


def test_payload_parts_lose_nothing(spark, plans):
    items = spark.createDataFrame([("p", f"n{i}", i, "f", "LEFT" if i == 0 else None, i, "b", "t" if i % 4 == 3 else None) for i in range(11)] + [("q", "only", 1, "f", None, 1, "b", "t")],
                                  "pr_id string, id string, pos long, path string, side string, line long, body string, reply_to string")
    sent = rv.exported_ids(spark.createDataFrame([("p", "note\n<!-- review-threads: n1, ,n2 -->\nmore")], "pr_id string, body string"))
    assert rows(sent, "id") == [("n1",), ("n2",)]
    un = rv.unsent_items(items, sent)
    pay = rv.review_payload(un, part_rows=4).collect()
    assert {r.pr_id for r in pay} == {"p"}                       # replies alone post no review
    assert sorted(c.line for r in pay for c in r.comments) == [0, 4, 5, 6, 8, 9, 10]
    ids = [i for r in pay for i in r.body.split("review-threads: ")[1].removesuffix(" -->").split(",")]
    assert sorted(ids) == sorted(f"n{i}" for i in range(11) if i not in (1, 2))
    assert all(len(r.comments) <= 4 for r in pay) and pay[0].body.startswith("Review notes — ")


def test_every_changed_line_gets_a_commit_and_no_line_two_owners(spark, plans):
    lines = spark.createDataFrame([("p", "f", i, k, o, n, t) for i, (k, o, n, t) in enumerate([
        ("ctx", 1, 1, "a"), ("del", 2, None, "x"), ("add", None, 2, "y"), ("add", None, 3, "y"), ("add", None, 4, "lost"), ("ctx", 3, 5, "b")], 1)],
        "pr_id string, path string, idx long, kind string, old long, new long, text string")
    wrote = spark.createDataFrame([("p", "f", "c1", 3, 1, "add", "y"), ("p", "f", "c2", 2, 1, "del", "x"), ("p", "f", "c3", 1, 1, "add", "y"), ("p", "f", "c1", 3, 2, "del", "x")],
                                  "pr_id string, path string, sha string, ord long, line_idx long, kind string, text string")
    commits = spark.createDataFrame([("p", "c1", 3, 1, ["a"]), ("p", "c2", 2, 2, ["a"]), ("p", "c3", 1, 4, ["a", "b"])], "pr_id string, sha string, ord long, band long, parents array<string>")
    d = at.attribute_lines(lines, wrote, commits)
    assert [r[1] for r in rows(d, "idx", "by")] == [None, "c1", "c3", "c1", "c3", None]
    s = at.stamp_lines(d, commits)
    assert rows(s.filter("conflict"), "idx", "band") == [(3, None), (5, None)]
    spans = spark.createDataFrame([("p", "f", "d1", 1, 3), ("p", "f", "d2", 3, 3), ("p", "f", "d3", 4, 9)], "pr_id string, path string, def_id string, span_start long, span_end long")
    own = at.slice_by_span(lines, spans)
    assert rows(own, "idx", "entry_id") == [(1, "d1"), (2, "d1"), (3, "d1"), (4, "d2"), (5, "d3"), (6, "d3")]


def test_stale_thread_shows_before_and_after(spark, plans):
    th = spark.createDataFrame([("f", 1, 10), ("f", 2, 5), ("f", 3, 30)], "k string, thread_id long, created long")
    ve = spark.createDataFrame([("f", 7, "s7", "old"), ("f", 10, "s10", "mid"), ("f", 20, "s20", "new")], "k string, at long, sha string, text string")
    assert rows(at.stale_threads(th, ve, ["k"]), "thread_id", "before", "after", "sha") == [(1, "mid", "new", "s20"), (2, None, "new", "s20")]


def test_threads_keep_replies_in_order(spark, plans):
    c = spark.createDataFrame([("p", 1, None, "2024-01-01T00:00:00Z"), ("p", 3, 1, "2024-01-03T00:00:00Z"), ("p", 2, 1, "2024-01-02T00:00:00Z"), ("p", 9, 8, "2024-01-02T00:00:00Z")],
                              "pr_id string, id long, in_reply_to long, created string")
    assert rows(at.build_threads(c), "id", "thread_id", "pos") == [(1, 1, 0), (2, 1, 1), (3, 1, 2)]


def test_checks_without_conclusion_fail(spark, plans):
    r = spark.createDataFrame([("p", 1, "a", "completed", None), ("p", 2, "b", "completed", "skipped"), ("p", 3, "c", "queued", None), ("q", 1, "d", "queued", None), ("s", 1, "e", "completed", "neutral")],
                              "pr_id string, run_id long, name string, status string, conclusion string")
    got = rows(rp.check_snapshot(r), "pr_id", "total", "failing", "running", "state", "names")
    assert got == [("p", 3, 1, 1, "failing", ["a"]), ("q", 1, 0, 1, "running", []), ("s", 1, 0, 0, "passing", [])]


def test_additions_before_a_rename_keep_their_commit(spark):
    lines = spark.createDataFrame([("p", "new.c", 1, "add", 1, "kept line"), ("p", "new.c", 2, "add", 2, "late line")], "pr_id string, path string, idx long, kind string, new long, text string")
    written = spark.createDataFrame([("p", "old.c", "c1", 2, 1, "add", "kept line"), ("p", "new.c", "c2", 1, 1, "add", "late line")], "pr_id string, path string, sha string, ord long, line_idx long, kind string, text string")
    commits = spark.createDataFrame([("p", "c2", 1), ("p", "c1", 2)], "pr_id string, sha string, ord long")
    renames = spark.createDataFrame([("p", "new.c", "old.c")], "pr_id string, path string, old_path string")
    assert rows(at.attribute_lines(lines, written, commits, renames=renames), "idx", "by") == [(1, "c1"), (2, "c2")]


def test_lines_meet_their_commits_in_one_shuffle(spark, plans, monkeypatch):
    """each side was numbered, counted and joined in shuffles of its own; now both go once to where their file and text are."""
    import random
    rnd = random.Random(3)
    texts = ["}", "", None, "fifteen bytes..", "sixteen bytes...", "a line much longer than its hash would be"]
    wrote = [("p", f, f"c{o}", o, i, k, rnd.choice(texts)) for f in ("f", "g", None) for o in range(1, 6) for i in range(4) for k in ("add", "del")]
    lines = [("p", f, i, rnd.choice(["add", "del"]), i, rnd.choice(texts)) for f in ("f", "g", "h", None) for i in range(40)]
    written = spark.createDataFrame(wrote, "pr_id string, path string, sha string, ord long, line_idx long, kind string, text string")
    asked = spark.createDataFrame(lines, "pr_id string, path string, idx long, kind string, new long, text string")
    want, took = [], {}
    for _, f, i, kind, _, text in lines:
        mine = sorted((w for w in wrote if w[1] == f and w[5] == kind and w[6] == text), key=lambda w: (w[3], w[4]), reverse=kind == "del")
        n = took[f, kind, text] = took.get((f, kind, text), 0) + 1
        if f is not None and text is not None and n <= len(mine):
            want.append((f, i, mine[n - 1][2]))
    got = at.attribute_additions(asked, written).unionByName(at.attribute_deletions(asked, written))
    assert rows(got, "path", "idx", "by") == sorted(want, key=str)
    adds = rows(at.attribute_additions(asked, written), "path", "idx", "by")
    old = written.withColumn("path", F.concat(F.lit("old/"), "path"))
    renames = spark.createDataFrame([("p", f, f"old/{f}") for f in "fgx"], "pr_id string, path string, old_path string")
    for most in (0, 10):  # shuffled, broadcast
        monkeypatch.setattr(at, "SENT_RENAMES", most)
        assert rows(at.attribute_additions(asked, old, renames=renames), "path", "idx", "by") == adds
    d = at._match_nth(at._hashed(asked, "add").drop("text"), at._hashed(written, "add").drop("text"), ["pr_id"], True)
    d.collect()
    if plans == "small":  # no file is hot: the files counted and the lines met, nothing else
        assert d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_unreadable_and_missing_times(spark, plans):
    c = spark.createDataFrame([("p", 1, None, "2020-01-01T00:00:00Z"), ("p", 2, 1, "soon"), ("p", 3, 1, None), ("p", 4, 1, "2020-01-02T00:00:00Z")], "pr_id string, id long, in_reply_to long, created string")
    assert rows(at.build_threads(c), "pos", "id") == [(0, 1), (1, 2), (2, 3), (3, 4)]
    d = spark.createDataFrame([("p", i, "f", 1, "RIGHT", "b", "a", t, None, None, x) for i, t, x in ((1, "soon", None), (2, "2020-01-01T00:00:00Z", None), (3, None, "sent"), (4, "2020-01-01T00:00:00Z", "sent"))],
                              "pr_id string, id long, path string, line long, side string, body string, author string, created string, reply_to string, reply_to_author string, exported_at string")
    none = spark.createDataFrame([], "pr_id string, ord long, id long, anchor string, author string, body string")
    assert rows(rv.collect_threads(d, none), "pos", "id") == [(1, "1"), (2, "2"), (3, "3"), (4, "4")]


def test_replies_open_no_review_of_their_own(spark, plans):
    items = [("p", str(i), i, f"f{i}", i, None, "b", None if i <= 3 else "1") for i in range(1, 10)] + [("q", "20", 20, "f", 1, None, "b", "7")]
    d = spark.createDataFrame(items, "pr_id string, id string, pos long, path string, line long, side string, body string, reply_to string").withColumn("is_reply", F.col("reply_to").isNotNull())
    got = rv.review_payload(d, part_rows=2).collect()
    assert sorted((r.pr_id, r.part, len(r.comments)) for r in got) == [("p", 0, 2), ("p", 1, 1)]
    stamped = [r.body.split(": ")[1].split(" --")[0].split(",") for r in got]
    assert sorted(x for ids in stamped for x in ids) == [str(i) for i in range(1, 10)]


def test_sites_without_source_stay(spark):
    from patchlore.operators import graph as g
    sites = spark.createDataFrame([("p", "f", 2), ("p", "gone", 5)], "pr_id string, file string, line long")
    source = spark.createDataFrame([("p", "f", i, f"  line {i}") for i in range(1, 4)], "pr_id string, file string, line long, text string")
    got = {(r.file, r.line): (r.text, r.ctx) for r in g.site_context(sites, source).collect()}
    assert got == {("f", 2): ("line 2", ["  line 1", "  line 2", "  line 3"]), ("gone", 5): ("", [])}


def test_rows_without_a_commit_stay_out_of_the_joins(spark, monkeypatch):
    """Half of all lines are often context; they would meet in one partition."""
    left, join = [], at.skew_join
    monkeypatch.setattr(at, "skew_join", lambda a, b, on, how="inner": left.append(a) or join(a, b, on, how))
    lines = spark.createDataFrame([("p", "a", 1, "ctx", None), ("p", "a", 2, "add", "c1"), ("p", "a", 3, "add", "c9"), ("p", "a", 4, "del", "m")],
                                  "pr_id string, path string, idx long, kind string, by string")
    commits = spark.createDataFrame([("p", "c1", 2, ["x"]), ("p", "m", 3, ["x", "y"])], "pr_id string, sha string, band long, parents array<string>")
    got = at.stamp_lines(lines, commits)
    assert rows(got, "idx", "band", "conflict") == [(1, None, False), (2, 2, False), (3, None, False), (4, None, True)]
    assert all(d.filter("by IS NULL").isEmpty() for d in left)


def test_attribution_shuffles_short_hashes_and_changed_lines_only(spark):
    lines = spark.createDataFrame([("p", "a", 1, "ctx", 1, 1, "x"), ("p", "a", 2, "add", None, 2, "x"), ("p", "a", 3, None, None, 3, "x")],
                                  "pr_id string, path string, idx long, kind string, old long, new long, text string")
    written = spark.createDataFrame([("p", "a", "c1", 1, 1, "add", "x")], "pr_id string, path string, sha string, ord long, line_idx long, kind string, text string")
    commits = spark.createDataFrame([("p", "c1", 1)], "pr_id string, sha string, ord long")
    assert dict(at._hashed(lines, "add").dtypes)["_h"] == "binary"
    assert rows(at.attribute_lines(lines, written, commits), "idx", "by") == [(1, None), (2, "c1"), (3, None)]


def test_leftovers_of_many_components_are_not_shuffled(spark):
    """Lines are matched with their claims before they meet every component of the file: no join has the component among its keys."""
    lines = spark.createDataFrame([("p", "a", i, "add" if i % 2 else "ctx", None, i) for i in range(1, 9)], "pr_id string, path string, idx long, kind string, old long, new long")
    own = [("p", "a", "add", None, 1, "e1"), ("p", "a", "add", None, 3, "e2"), ("p", "a", "add", None, 3, "e3"), ("p", "a", "add", None, 5, "e4")]
    entry_lines = spark.createDataFrame(own, "pr_id string, path string, kind string, old long, new long, entry_id string")
    members = spark.createDataFrame([("p", "c1", "e1"), ("p", "c1", "e2"), ("p", "c2", "e3"), ("p", None, "e4")], "pr_id string, comp_id string, entry_id string")
    got = at.leftover_lines(lines, entry_lines, members)
    want = [("c1", 5), ("c1", 7), ("c2", 1), ("c2", 5), ("c2", 7), (None, 1), (None, 3), (None, 5), (None, 7)]
    assert rows(got, "comp_id", "idx") == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
