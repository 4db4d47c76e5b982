import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from patchlore.session import cut, new_path, remove_cuts, work_dir
from patchlore.sources import readers as rd, writers as wr
from tests.conftest import rows


def test_patch_files(spark, tmp_path):
    for sha, text in (("abc", "one\npatch"), ("__HIVE_DEFAULT_PARTITION__", "whole")):
        os.makedirs(tmp_path / "pr_id=7" / f"sha={sha}")
        (tmp_path / "pr_id=7" / f"sha={sha}" / "a.diff").write_text(text)
    assert rows(rd.read_patches(spark, str(tmp_path), "text")) == [("7", "", "whole"), ("7", "abc", "one\npatch")]


def test_log_rows(spark):
    log = "h2\tp1 p2\tann\t1700000000\tMon|2023-11-14 22:13|22:13\tMerge\n\nh1\t\tbob\n"
    got = rows(rd.parse_commit_log(spark.createDataFrame([("p", log)], "pr_id string, log string")), "sha", "parents", "author", "at", "day", "message", "ord")
    assert got == [("h1", [], "bob", None, "", "", 2), ("h2", ["p1", "p2"], "ann", 1700000000, "Mon", "Merge", 1)]


def test_source_listing(spark, tmp_path):
    for p in ("src/a.ts", "src/b.tsx", "src/c.md", "node_modules/d.ts", "x/.git/e.ts", "x/my.gitty/f.ts"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("text " + p)
    assert rows(rd.list_source_files(spark, str(tmp_path))) == [(p, "text " + p) for p in ("src/a.ts", "src/b.tsx", "x/my.gitty/f.ts")]


def test_unmerged_requests_are_rejected(spark):
    ok, bad = json.dumps({"number": 3, "title": "t", "merge_commit_sha": "s", "base": {"ref": "main"}}), json.dumps({"number": 4})
    good, rejected = rd.read_prs(spark.createDataFrame([("o/r", ok), ("o/r", bad), ("o/r", "{")], "repo string, payload string"))
    assert rows(good, "pr_id", "base_ref", "author") == [("o/r#3", "main", None)]
    assert sorted(r[0] for r in rows(rejected, "reason")) == ["not merged (no merge commit)", "unreadable payload"]


@pytest.mark.parametrize("part_rows,parts", [(1000, 1), (3, 3)])
def test_documents_come_back_whole(spark, plans, part_rows, parts):
    s = spark.createDataFrame
    lines = s([("p", "f", i, "add", None, i, f"t{i}") for i in range(1, 9)], "pr_id string, path string, idx long, kind string, old long, new long, text string")
    tables = {"prs": s([("p", "o/r", "1", "title")], "pr_id string, repo string, number string, title string"), "diff_lines": lines,
              "files": s([("p", "f", "+8 −0")], "pr_id string, path string, delta string").withColumn("old_path", F.lit(None).cast("string")),
              "commits": s([("p", f"c{i}", i, i % 3) for i in range(5)], "pr_id string, sha string, ord long, band long"),
              "edges": s([("p", "a", "b", 2, [("f.ts", 4)])], "pr_id string, a string, b string, refs long, sites array<struct<file:string,line:long>>").withColumn(
                  "sites", F.transform("sites", lambda x: F.struct(x["file"], x["line"], F.lit("t").alias("text"), F.array(F.lit("t")).alias("ctx"), x["line"].alias("ctx_start"))))}
    path = new_path(spark, "docs")
    wr.write_dataset(tables, path, part_rows=part_rows, slice_rows=2)
    n = rd.read_documents(spark, path).count()
    assert n == 1 if parts == 1 else n > 1
    back = rd.read_dataset(spark, path)
    assert rows(back["diff_lines"], "pr_id", "path", "idx", "kind", "old", "new", "text") == rows(lines)
    assert rows(back["commits"], "sha", "ord") == [(f"c{i}", i) for i in range(5)]
    if parts == 1:
        doc = rd.read_documents(spark, path).first()
        assert [c.ord for c in doc.commits] == [0, 1, 2, 3, 4] and [x.path for x in doc.files] == ["f"] * 4
    assert rows(back["files"], "path", "delta") == [("f", "+8 −0")] and rows(back["prs"], "number", "title") == [("1", "title")]
    assert [s.line for s in back["edges"].first().sites] == [4]
    with open(path + "/broken.json", "w") as f:
        f.write("{not json\n")
    recent = rd.recent_datasets(spark, path).collect()
    assert [(r.pr_id, r.repo, r.commits, r.bands) for r in recent] == [("p", "o/r", 5, [0, 1, 2])]


def test_refs_of_a_differing_upstream_are_dropped(spark):
    prs = spark.createDataFrame([("a", "1234567890"), ("b", "1234567890"), ("c", "1234567890")], "pr_id string, merged_sha string")
    up = spark.createDataFrame([("a", "1234567fff", "main", "x", "o:x"), ("b", "9999999", "main", "y", "o:y"), ("c", None, "dev", "z", "o:z")],
                               "pr_id string, merge_sha string, base_ref string, head_ref string, head_label string")
    assert rows(wr.reconcile_refs(prs, up), "pr_id", "base_ref", "local_only") == [("a", "main", False), ("b", None, True), ("c", "dev", False)]


class FakeSession:
    def __init__(self, master, folder=None, checkpoints=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: checkpoints)


def test_work_folder_comes_from_the_session():
    assert work_dir(FakeSession("yarn", "hdfs:///shared/folder/")) == "hdfs:///shared/folder"
    own = work_dir(FakeSession("local[2]"))
    assert os.path.isdir(own) and work_dir(FakeSession("local[2]")) == own
    with pytest.raises(ValueError):
        work_dir(FakeSession("yarn"))
    with pytest.raises(ValueError):
        work_dir(FakeSession("local-cluster[2,1,1024]"))
    assert work_dir(FakeSession("yarn", None, "hdfs:///set")) == "hdfs:///set"


def test_cuts_are_removed_on_request(spark):
    kept = cut(spark.range(3))
    assert kept.count() == 3 and remove_cuts(spark)
    assert not os.path.exists(os.path.dirname(new_path(spark, "x")))


def test_every_section_comes_back(spark):
    s = spark.createDataFrame
    tables = {"prs": s([("p", "t")], "pr_id string, title string"), "commits": s([("p", "c2", 1, ["c1", "c0"], "Mon", "08:15"), ("p", "c1", 2, [], "Sun", "21:00")], "pr_id string, sha string, ord long, parents array<string>, day string, time string"),
              "written": s([("p", "f", "c1", 2, i, "add", f"t{i}") for i in range(3)], "pr_id string, path string, sha string, ord long, line_idx long, kind string, text string"),
              "checks": s([("p", 4, "unit", "completed", "failure")], "pr_id string, run_id long, name string, status string, conclusion string"),
              "extra_files": s([("p", "x.ts", "new", 1)], "pr_id string, path string, delta string, pos long"), "method": s([("p", 2, "b"), ("p", 1, "a")], "pr_id string, pos long, text string"),
              "initial_component": s([("p", "k")], "pr_id string, comp_id string")}
    path = new_path(spark, "docs")
    wr.write_dataset(tables, path)
    for i in range(wr.BUCKETS // 32):  # other requests, some of them in the same folder
        wr.write_dataset({"prs": s([(f"q{i}-{k}", "other") for k in range(64)], "pr_id string, title string")}, path)
    back = rd.read_dataset(spark, path)
    for name, table in tables.items():
        got = back[name].filter("pr_id = 'p'")
        assert rows(got, *table.columns) == rows(table), name
    assert [m.text for m in rd.read_documents(spark, path).filter("pr_id = 'p'").first().method] == ["a", "b"]
    assert back["prs"].count() == 1 + 64 * (wr.BUCKETS // 32)


def test_documents_are_written_compressed_and_without_a_further_shuffle(spark, tmp_path, monkeypatch):
    def no_shuffle(*_):
        raise AssertionError("documents lie together already")
    lines = spark.createDataFrame([(p, f"f{p}", i, "add", f"line {i}") for p in "pq" for i in range(1, 6)], "pr_id string, path string, idx long, kind string, text string")
    files = lines.select("pr_id", "path", F.lit(None).cast("string").alias("old_path"), F.lit("d").alias("delta")).distinct()
    tables = {"prs": spark.createDataFrame([("p", "one"), ("q", "two")], "pr_id string, title string"), "files": files, "diff_lines": lines}
    path = str(tmp_path / "set")
    monkeypatch.setattr(type(lines), "repartition", no_shuffle)
    for title in ("one", "again"):  # the second time the folder is there
        tables["prs"] = tables["prs"].withColumn("title", F.lit(title))
        wr.write_dataset(tables, path, slice_rows=2)
        got = rd.read_dataset(spark, path)
        assert rows(got["diff_lines"], "pr_id", "path", "idx", "text") == rows(lines, "pr_id", "path", "idx", "text")
        assert rows(got["prs"], "pr_id", "title") == [("p", title), ("q", title)]
    written = [n for _, _, names in os.walk(path) for n in names if n.startswith("part-")]
    assert written and all(n.endswith(".json.gz") for n in written)


def test_outbox_takes_nothing_twice(spark):
    s = spark.createDataFrame
    payload = s([("p", 0, 1, "note", [])], "pr_id string, part long, n long, body string, comments array<string>")
    replies = s([("p", "r1", "t1", "yes", True), ("p", "r2", "t1", "no", False)], "pr_id string, id string, reply_to string, body string, is_reply boolean")
    path = new_path(spark, "outbox")
    for _ in range(3):
        wr.export_outbox(payload, replies, path)
    assert rows(spark.read.parquet(path), "what", "body") == [("reply", "yes"), ("review", "note")]


def test_two_replies_with_one_text_are_both_sent(spark):
    s = spark.createDataFrame
    nothing = s([], "pr_id string, part long, n long, body string, comments array<string>")
    path = new_path(spark, "outbox")
    for ids in (["n1"], ["n2"], ["n1", "n2"], ["n2", "n2"]):
        wr.export_outbox(nothing, s([("p", i, "t1", "done", True) for i in ids], "pr_id string, id string, reply_to string, body string, is_reply boolean"), path)
    assert rows(spark.read.parquet(path), "note", "reply_to", "body") == [("n1", "t1", "done"), ("n2", "t1", "done")]


def test_unreadable_references_go_to_quarantine(spark):
    d = spark.createDataFrame([(1, "box/trie#7"), (2, "no reference"), (3, None)], "id int, ref string")
    good, bad = rd.read_pr_refs(d)
    assert rows(good, "id", "owner", "repo", "number") == [(1, "box", "trie", "7")]
    assert rows(bad, "id", "reason") == [(2, "not a reference to a request"), (3, "not a reference to a request")]


def test_outer_folders_of_a_listing_do_not_matter(spark, tmp_path):
    for p in ("node_modules/x/a.ts", "b.ts"):
        os.makedirs(tmp_path / "deep" / os.path.dirname(p), exist_ok=True)
        (tmp_path / "deep" / p).write_text("let x;")
    assert rows(rd.list_source_files(spark, str(tmp_path / "deep"))) == [("b.ts", "let x;")]
