from collections import Counter, defaultdict
import re

import numpy as np

from patchlore.llm import divergence
from tests.llm.conftest import CLASHES


def brute(rows, ranks=200):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    group, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(upper))
        group[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in group}:
        kept = [t for t, n in in_docs[lang].items() if n >= 3]
        counts = {s: {t: c[t] for t in kept} for (x, s), c in group.items() if x == lang}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(h, sum((p(c, t) - p(d, t)) ** 2 // p(d, t) for t in kept)) for h, d in counts.items() if h != s]
            terms = [(t, (p(c, t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= ranks:
                        out.add((lang, s, part, item, value, rank))
    return out


def texts(seed, n):
    r = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}" for a in ("Kam", "té", "日本", "zz", "q") for b in ("or", "IN", "ül", "")]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    return [(" 7-".join(r.choice(vocabulary, r.integers(0, 40), p=weight / weight.sum())), str(r.choice(["aa", "bb"])), f"s{r.choice(7, p=[.4, .1, .1, .1, .1, .1, .1])}") for _ in range(n)]


def test_equals_brute_force_in_many_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS_PER_BLOCK", 4)
    monkeypatch.setattr(divergence, "GROUPS_PER_BLOCK", 2)
    rows = texts(1, 120)
    rows += [(None, "aa", "s1"), ("", None, None), ("   12 ", "cc", "x"), ("lone words", "cc", "y"), ("same Same", "dd", None), ("same", "dd", None), ("same", "dd", None), ("", "dd", "empty")]
    rows += [("copy of kamor", "aa", "s3")] * 4
    rows.append(("kamor long " * 5000 + "end", "bb", "s2"))
    table = docs([(i, *r) for i, r in enumerate(rows)], extra=CLASHES + ("term", "n", "docs", "total", "terms", "own", "side"))
    got = [tuple(x) for x in divergence.divergence(table).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    few = {tuple(x) for x in divergence.divergence(table, ranks=2).collect()}
    assert few == brute(rows, 2)


def test_empty_table(spark, docs):
    assert divergence.divergence(docs([])).collect() == []


def test_products_split_by_columns_equal_plain_sums(monkeypatch):
    for seed in range(12):
        r = np.random.default_rng(seed)
        terms, groups, others = (int(x) for x in r.integers(1, 40, 3))
        a = r.zipf(1.5, (terms, groups)).astype(np.int64) % 10**6
        b = r.zipf(2.5, (terms, others)).astype(np.int64) % 50
        a_total, b_total = (a.sum(0) + 5).tolist(), (b.sum(0) + 3).tolist()

        def price(c, total):
            return np.array([[1 + 10**9 * (int(x) + 1) // (t + terms) for x, t in zip(row, total, strict=True)] for row in c])

        p, q = price(a, a_total)[:, :, None], price(b, b_total)[:, None, :]
        for columns in (1, 7, 2048):
            monkeypatch.setattr(divergence, "COLUMNS", columns)
            there, back = divergence.joint_prices(a, b, a_total, b_total, terms)
            assert (there == ((p - q) ** 2 // q).sum(0)).all() and (back == ((p - q) ** 2 // p).sum(0).T).all()


def test_very_long_text_is_counted_in_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 10)
    text = ("Ab cd\xe9 ef 12 " * 100).encode()
    parts = list(divergence.words(text))
    assert max(map(len, parts)) == 10 and sum(parts, []) == ["ab".encode(), "cd\xe9".encode(), b"ef"] * 100
