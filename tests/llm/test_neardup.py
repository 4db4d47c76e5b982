import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from patchlore.llm import icws, neardup
from tests.llm.conftest import CLASHES


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, least=neardup.SIMILARITY, share=neardup.SHARE):
    """Class of each row number by comparing all pairs of texts."""
    bags = [bag(t) for _, t in rows]
    df = Counter(s for b in bags for s in b)
    idf = {s: math.log(1 + len(rows) / max(n, share * len(rows))) for s, n in df.items()}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b:
                common = sum(min(n, b[s]) * idf[s] for s, n in a.items())
                total = sum(n * idf[s] for s, n in a.items()) + sum(n * idf[s] for s, n in b.items()) - common
                if common / total >= least - 1e-9:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    out = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        out[find(i)].append(doc)
    return Counter(d for own in out.values() for d in [(x, min(own)) for x in own])


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    notice = " ".join(f"notice{i}" for i in range(12))
    for group in range(40):
        words = [r.choice(vocabulary) for _ in range(r.choice([30, 80, 200]))]
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            own = words[:]
            for _ in range(r.choice([0, 0, 1, 2, len(own) // 20, len(own) // 8])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((n, " ".join(own) + (" " + notice if group % 3 == 0 else "")))
            n += 1
    rows += [(1000 + i, "An exact COPY of one short text here") for i in range(50)] + [(2000 + i, "a b c") for i in range(3)]
    rows += [(3000, None), (3001, ""), (3002, "  \n"), (3003, "word"), (3004, "Word"), (3005, "long " * 20_000), (3006, "long " * 20_000 + "end")]
    return rows


def test_samples_estimate_weighted_similarity():
    r = random.Random(1)
    base = [f"v{i}" for i in range(300)]
    changed = [w if r.random() > 0.05 else w + "x" for w in base]
    s = icws.shingles(icws.words_of([" ".join(base), " ".join(changed)]))
    w = np.where(s.hashes % np.uint64(3) == 0, 0.3, 1.7)
    w[s.bounds[1]:] *= 1.2
    codes = icws.samples(s, w, 3000)
    exact = icws.similarity(s.hashes[:s.bounds[1]], w[:s.bounds[1]], s.hashes[s.bounds[1]:], w[s.bounds[1]:])
    assert abs((codes[0] == codes[1]).mean() - exact) < 0.03


def test_classes_equal_all_pairs(docs, monkeypatch):
    rows = corpus()
    for block in (256, 7):
        monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
        got = neardup.classes(docs(rows, CLASHES)).collect()
        assert Counter((r.doc_id, r.class_id) for r in got) == brute(rows)
        assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_common_shingles_are_counted_exactly(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 5)
    texts = [f"one two three four five own{i} a{i} b{i} c{i}" if i % 3 else f"x{i} y{i} z{i} u{i} v{i}" for i in range(60)]
    weights = neardup.shingle_weights(docs(list(enumerate(texts))))
    assert weights.values.tolist() == [math.log(1 + 60 / 40)] and abs(weights.rare - math.log(6)) < 1e-12


def test_document_frequencies_decide_a_link(docs):
    # By plain counts the first two are a link; what they share is a notice on one text in twelve, so by TF-IDF they are not.
    notice = " ".join(f"notice{k}" for k in range(120))
    rows = [(i, notice + "".join(f" own{i}a{k}" for k in range(10 if i < 2 else 300))) for i in range(40)]
    rows += [(100 + i, " ".join(f"o{i}x{k}" for k in range(30))) for i in range(440)]
    a, b = bag(rows[0][1]), bag(rows[1][1])
    assert sum((a & b).values()) / sum((a | b).values()) > neardup.SIMILARITY
    got = Counter((r.doc_id, r.class_id) for r in neardup.classes(docs(rows)).collect())
    assert got == brute(rows) and got[1, 1] == 1


def test_links_that_no_leader_sees(docs, monkeypatch):
    # Bands of one sample throw unlike texts into one bucket; the pairs of small blocks must still find all links.
    monkeypatch.setattr(neardup, "BANDS", 12)
    monkeypatch.setattr(neardup, "ROWS", 1)
    monkeypatch.setattr(neardup, "AGREE", 1)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 8)
    rows = corpus()[:60]
    assert Counter((r.doc_id, r.class_id) for r in neardup.classes(docs(rows)).collect()) == brute(rows)


def test_ids_that_repeat_or_lack(docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (None, "h i j k l m n"), (2, "other words than all of these")]
    got = Counter((r.doc_id, r.class_id) for r in neardup.classes(docs(rows)).collect())
    assert got == {(1, 1): 3, (None, 1): 1, (2, 2): 1}


def test_components_of_a_chain(spark):
    b = lambda i: i.to_bytes(2, "big")
    links = [(b(i), b(i + 1)) for i in range(40)] + [(b(200), b(i)) for i in range(300, 330)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert {bytes(got[b(i)]) for i in range(41)} == {b(0)} and {bytes(got[b(i)]) for i in range(300, 330)} == {b(200)}


def test_stage_keeps_one_of_each(docs):
    rows = [(i, "the same words in every one of these texts") for i in range(5)] + [(0, "the same words in every one of these texts"), (9, "quite another text of some more words"), (10, None)]
    table = docs(rows)
    kept = neardup.keep_one(table)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9, 10] and set(kept.columns) == set(table.columns)


def test_stage_keeps_one_row_of_each_class_when_ids_repeat_or_lack(docs):
    def text(k):
        return " ".join(f"{k}w{i}" for i in range(300))
    a, b, c, d = (text(k) for k in "abcd")
    rows = [(5, a), (8, a + " end"), (3, b), (5, b + " end"),    # id 5 heads the class of a and is no head in that of b
            (6, c), (6, c + " end"), (6, c),                      # near copies of one id
            (None, d), (None, d + " end"), (None, d),             # and of none
            (7, None), (7, None), (None, None), (None, None), (9, "")]
    got = Counter((r.doc_id, r.text) for r in neardup.keep_one(docs(rows)).collect())
    kept = [next(k for k in "abcd" if t.startswith(k)) for _, t in got.elements() if t]
    assert sorted(kept) == list("abcd")
    assert got[5, a] == 1 and got[3, b] == 1 and got[7, None] == 1 and got[None, None] == 2 and got[9, ""] == 1


def test_empty_table(docs):
    assert neardup.classes(docs([])).count() == 0 and neardup.keep_one(docs([])).count() == 0


def test_frequent_shingles_take_little_memory(monkeypatch):
    # A million shingles, nearly all different: the count must not hold several arrays as long as they are.
    many = np.append(np.arange(1_000_000), [7] * 9).astype(np.uint64)
    monkeypatch.setattr(icws, "all_shingles", lambda words: (many.copy(), None))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 10)], names=["text"])
    tracemalloc.start()
    got = pa.Table.from_batches(neardup.frequent_in_blocks(0.5)(iter([batch]))).to_pydict()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {"shingle": [7], "n": [10]}
    assert most < 3 * many.nbytes


def test_frequent_shingles_equal_a_plain_count():
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(60)]
    for share in (0.01, 0.1, 0.6, 1.0):
        got = pa.Table.from_batches(neardup.frequent_in_blocks(share)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))).to_pydict()
        h, n = np.unique(icws.all_shingles(icws.words_of(texts))[0], return_counts=True)
        assert dict(zip(got["shingle"], got["n"], strict=True)) == {int(x): min(int(c), 60) for x, c in zip(h.view(np.int64), n, strict=True) if c >= share * 60}
