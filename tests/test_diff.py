from pyspark.sql import functions as F

from patchlore.functions import text as tx
from patchlore.functions.paths import module_candidates, normalize_path
from patchlore.operators import diff
from tests.conftest import rows

PATCH = """diff --git a/makefile b/makefile
index 77..78 100644
--- a/makefile
+++ b/makefile
@@ -7,5 +7,6 @@ all:
 \tcc -c queue.c
-\tcc -c stack.c
-\tcc -c heap.c
+\tcc -O2 -c stack.c
+\tcc -O2 -c heap.c
+\tcc -O2 -c trie.c
 \tar rc libbox.a
 
diff --git a/trie.c b/trie.c
new file mode 100644
--- /dev/null
+++ b/trie.c
@@ -0,0 +1,2 @@
+#include "trie.h"
+int depth(void) { return 0; }
diff --git a/notes/todo.txt b/notes/todo.txt
deleted file mode 100644
--- a/notes/todo.txt
+++ /dev/null
@@ -1 +0,0 @@
-write a trie"""


def parsed(spark, patch):
    r = diff.patch_rows(spark.createDataFrame([("p", "", patch)], "pr_id string, sha string, patch string"))
    return diff.diff_lines(r), diff.diff_files(r)


def test_kinds_numbers_and_deltas(spark):
    lines, files = parsed(spark, PATCH)
    assert rows(files, "path", "delta") == [("makefile", "+3 −2"), ("notes/todo.txt", "deleted"), ("trie.c", "new")]
    assert rows(lines.filter("path = 'trie.c'"), "idx", "kind", "old", "new") == [(1, "add", None, 1), (2, "add", None, 2)]
    assert rows(lines.filter("path = 'notes/todo.txt'"), "idx", "kind", "old", "new", "text") == [(1, "del", 1, None, "write a trie")]
    assert rows(lines.filter("path = 'makefile'"), "idx", "kind", "old", "new") == [
        (1, "ctx", 7, 7), (2, "del", 8, None), (3, "del", 9, None), (4, "add", None, 8), (5, "add", None, 9), (6, "add", None, 10), (7, "ctx", 10, 11), (8, "ctx", 11, 12)]


def test_empty_patch_has_no_files(spark):
    lines, files = parsed(spark, "")
    assert rows(lines) == [] and rows(files) == []


def test_removed_line_that_looks_like_a_header_is_a_line(spark):
    patch = "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -5,3 +5,2 @@\n a\n--- note\n-b\n\\ No newline at end of file\n+++ c"
    lines, _ = parsed(spark, patch)
    assert rows(lines, "idx", "kind", "old", "new", "text") == [(1, "ctx", 5, 5, "a"), (2, "del", 6, None, "-- note"), (3, "del", 7, None, "b"), (4, "add", None, 6, "++ c")]


def test_renames_deletions_and_second_hunks(spark):
    patch = ("junk before\ndiff --git a/old name b/new name\nsimilarity index 90%\nrename from old name\nrename to new name\n@@ -1 +1 @@\n-a\n+b\n@@ -10,2 +10 @@ f()\n c\n-d\n"
             "diff --git a/gone b/gone\ndeleted file mode 100644\n@@ -1 +0,0 @@\n-z")
    lines, files = parsed(spark, patch)
    assert rows(files, "path", "old_path", "delta") == [("gone", None, "deleted"), ("new name", "old name", "+1 −2")]
    assert rows(diff.base_paths(files), "path") == [("old name",)]
    assert rows(lines.filter("path = 'new name'"), "idx", "old", "new")[2:] == [(3, 10, 10), (4, 11, None)]


def test_insignificant_texts(spark):
    yes = ["\t\t  ", "//", "------", "/**", " ***/", "= = =", "#"]
    no = ["}", "x", "// 1", "*ptr = 0", "return;", "/* why */", "a // b"]
    d = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [r[0] for r in d.select(tx.insignificant(F.col("t"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_touched_head_lines(spark, plans):
    data = [("m", 1, "add", 1, "#include <a>"), ("m", 2, "ctx", 2, "int main"), ("m", 3, "ctx", 3, "{"), ("m", 4, "del", None, "old();"), ("m", 5, "del", None, "older();"),
            ("m", 6, "ctx", 4, "}"), ("m", 7, "add", 5, "// ----"), ("m", 8, "del", None, "  "), ("z", 1, "ctx", 80, "x"), ("z", 2, "del", None, "tail")]
    d = spark.createDataFrame(data, "path string, idx long, kind string, new long, text string")
    assert rows(diff.changed_head_lines(d, ["path"])) == [("m", 1), ("m", 3), ("z", 80)]


def test_pr_refs(spark):
    d = spark.createDataFrame([(t,) for t in ["see http://github.com/box-lib/trie_c/pull/4/files", "box-lib/trie_c#4", "box-lib#4", "https://github.com/box-lib/trie_c.git/pull/31?w=1", ""]], "t string")
    got = [tuple(r[0]) for r in d.select(tx.pr_ref(F.col("t"))).collect()]
    assert got == [("box-lib", "trie_c", "4"), ("box-lib", "trie_c", "4"), (None, None, None), ("box-lib", "trie_c", "31"), (None, None, None)]


def test_ids_paths_and_hash_text(spark):
    d = spark.range(1)
    one = lambda c: d.select(c).first()[0]
    assert one(tx.node_file(F.lit("a#b/c.ts#name#const#3"))) == "a#b/c.ts"
    assert one(tx.node_file(F.lit("plain"))) == ""
    assert one(tx.normalize_for_hash(F.lit("""from './a.ts'; import("../b.tsx"); from "pkg.ts" """))) == """from './a'; import("../b"); from "pkg.ts" """
    assert one(normalize_path(F.lit("a/./b/../../../c//d"))) == "../c/d"
    assert one(module_candidates(F.lit("src/a/b.ts"), F.lit("../core")))[:3] == ["src/core", "src/core.ts", "src/core.tsx"]
    assert one(module_candidates(F.lit("src/b.ts"), F.lit("pkg"))) is None
