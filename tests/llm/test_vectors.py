import math

import numpy as np

from patchlore.llm import bitslice, vectors


def test_bit_arithmetic(monkeypatch):
    for seed in range(40):
        r = np.random.default_rng(seed)
        n, d, m = r.integers(1, 300), r.integers(1, 8), r.integers(1, 600)
        x = r.integers(-m, m + 1, (n, d)) // (1 if seed % 3 else m // 2 + 1)
        ids = np.sort(r.choice(9999, n, replace=False))
        s = bitslice.Slices.build(x)
        assert (s.values(np.arange(n)) == x).all()
        monkeypatch.setattr(bitslice, "BOUNDARY", [0, 5, 256][seed % 3])
        q, own = x[r.integers(n)], int(ids[r.integers(n)])
        want = sorted((-int(v), int(i)) for v, i in zip(x @ q, ids, strict=True) if i != own)[:10]
        assert [(-a, b) for a, b in bitslice.top_rows(s, ids, q, own, 10)] == want


def test_signed_digits():
    for v in range(-600, 600):
        digits = bitslice.signed_digits(v)
        assert sum(s << p for p, s in digits) == v and len(digits) <= bin(abs(v)).count("1") + 1


def brute(rows, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in {i: min(v for j, v in ok if j == i) for i, _ in ok if i % 4 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        for rank, (score, j) in enumerate(best, 1):
            out[i, rank] = (j, -score)
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vectors, "QUERY_BATCH", 5)
    r = np.random.default_rng(2)
    rows = [(i, np.float32(r.normal(0, 0.3, 6)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]                     # a large group of equal vectors
    rows += [(300, None), (301, []), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] + [0.0] * 5), (None, rows[1][1]), (8, rows[9][1]), (400, [0.0] * 6), (404, [1.0, 2.0]), (405, [1.0, -2.0])]
    table = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, rank int, block int")
    got = vectors.search(vectors.build_index(table), table.filter("vec_id % 4 = 0"), k=7)
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in got.collect()} == brute(rows, 7)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0])]):
        table = spark.createDataFrame(rows, schema)
        assert vectors.search(vectors.build_index(table), table.filter("vec_id = 0")).count() == max(0, len(rows) - 1)
