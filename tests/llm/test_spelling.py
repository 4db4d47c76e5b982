import random
import re
import zlib
from collections import Counter

from patchlore.llm import spelling
from tests.llm.conftest import CLASHES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UPPER)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{word}".encode())
            if h % 199 == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1:]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def mutated(r, word):
    i, c = r.randrange(len(word) + 1), r.choice("abe\xe9\xff")
    return r.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])


def check(spark, rows):
    extra = CLASHES + ("word", "n", "form", "root", "other", "of", "part", "piece")
    table = spark.createDataFrame([(i, t, *([1] * len(extra))) for i, t in rows], "doc_id long, text string" + "".join(f", {c} int" for c in extra))
    got = [tuple(x) for x in spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    return got


def test_equals_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcde\xe8") for _ in range(r.randrange(6, 11))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = r.choice(base[:20] if r.random() < .7 else base)
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                w = mutated(r, w)
            words.append(w.upper() if r.random() < .1 else w)
        rows.append((i, r.choice([" ", "-", "7"]).join(words)))
    rows += [(None, "nullid nullid nullid nullid nullid nullie"), (1, None), (2, ""), (3, "\xc9\xc8\xc9\xc8\xc9\xc8 " * 6), (4, "\xd7\xf7abcd " * 7)]
    rows += [rows[0]] * 3
    got = check(spark, rows)
    assert any(x[4] > 1 for x in got) and any(x[1] for x in got) and len({len(x[0]) for x in got}) > 3


def test_paths_of_forms_end_in_one_root(spark):
    path, n = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"], 5
    rows = []
    for step, word in enumerate(path):
        rows.append((10**6 + step, f"{word} " * (n * 6**step)))
    got = {x[0]: x for x in check(spark, rows)}
    assert {x[2] for x in got.values()} == {path[-1]}


def test_ties_and_hot_chunks(spark):
    # one chunk shared by many words, equal counts among near words
    rows = [(i, " ".join([f"shared{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] * 5)) for i in (7, 8)]
    got = check(spark, rows)
    assert max(x[4] for x in got) >= 18


def test_empty_and_slips(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    words = [f"word{i:04d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(3000)]
    slips = [w for w in words if spelling.slipped(w, zlib.crc32(b"5:"), 199) != w]
    assert slips == [w for w in words if zlib.crc32(f"5:{w}".encode()) % 199 == 0] and slips


def test_long_text_is_counted_in_slices(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 10)
    parts = list(spelling.runs("Alpha \xc9ta beta " * 100))
    assert len(parts) == 30 and sum(parts, Counter()) == {"alpha": 100, "\xc9ta": 100, "beta": 100}
