import os
import re
from collections import Counter

import duckdb

from patchlore.llm import quality
from tests.llm.conftest import CLASHES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base


def test_counts_equal_brute_force(docs):
    texts = [None, "", "   \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "one\none\n\n two three \r\n# $ % one", "é 你好 😀 " * 30,
             "the quick brown fox " * 5000, "word " * 3, "\n".join(f"line {i % 7} of the text" for i in range(60)), "a\x0bb\x0cc\x1cd"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "the end")]
    got = quality.apply_rules(docs(rows, CLASHES)).collect()
    want = sorted(((i,) + brute(t) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert all(not (r.base_failed and r.kept) for r in got)


def test_verdicts(docs):
    good = " ".join(f"the {c}lan of {c}mor was in {c}tal." for c in "abcdefghijklm")
    rows = [(1, good), (2, " ".join(w + "%%%" for w in good.split())), (3, " | ".join(f"kqz{i}" for i in range(80))), (4, good.replace(" ", ""))]
    assert {r.doc_id: r.kept for r in quality.apply_rules(docs(rows)).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_empty_table(docs):
    assert quality.apply_rules(docs([])).count() == 0


def test_plan_has_no_shuffle_and_no_python(docs):
    plan = quality.apply_rules(docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_sql_twin(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(quality.SQL)
    cols = [d[0] for d in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in quality.op5_quality_rules(spark, sf).select(*cols).collect())
