import random
import zlib
from array import array
from collections import Counter, defaultdict

from patchlore.llm import packing, tokens
from tests.llm.conftest import CLASHES


def one_at_a_time(histogram, capacity):
    """Best-two-fit bin by bin on a plain list of lengths."""
    left = sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True)
    bins = []
    while left:
        bin_, gap = [], capacity
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        small = bin_[-1]
        best = max(((a + b, a) for i, a in enumerate(left) for b in left[i + 1:] if a + b <= gap + small), default=(0, 0))
        if gap and best[0] > small:
            bin_.remove(small)
            left.append(small)
            left.sort(reverse=True)
            for x in (best[1], best[0] - best[1]):
                bin_.append(x)
                left.remove(x)
        bins.append(sum(bin_))
    return bins


def test_patterns_fill_as_well_as_bin_by_bin():
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([10, 60, 200])
        histogram = {r.randint(1, capacity): r.randint(1, 12) for _ in range(r.randint(1, 12))}
        plan = packing.pack_histogram(dict(histogram), capacity)
        used = Counter()
        for times, bin_ in plan:
            assert sum(k * n for k, n in bin_.items()) <= capacity
            used.update({k: n * times for k, n in bin_.items()})
        assert used == Counter(histogram)
        assert sorted(t for times, b in plan for t in [sum(k * n for k, n in b.items())] * times) == sorted(one_at_a_time(histogram, capacity))


def test_replacement_fills_the_gap():
    # Greedy gives 6 + 3 in 10; two pieces of 2 fill it instead.
    assert packing.pack_histogram({6: 1, 3: 1, 2: 2}, 10)[0] == (1, {6: 1, 2: 2})


def test_chunked_ids_equal_whole_text_ids():
    enc = tokens.encoder()
    texts = ["Hello, World! It's  fine\n\nnow.", "ΑΣ Σ. İstanbul Å K ㄱㅏ naïve café 12ab x_y", "<|endoftext|> a<|endoftext|>b \t t\x0bv\xa0n '' . ,", "你好，世界。 😀 ﬁ ǅ ß ẞ", "x" * 5000, " ", "\n"]
    got = enc.encode(texts)
    for i, t in enumerate(texts):
        assert got.text(i).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_small_table_changes_nothing(monkeypatch):
    texts = [f"word{i} and {'x' * (i % 90)} again, word{i // 2}. <|ENDOFTEXT|>" for i in range(400)] + [None, "", "a\n\nb  c "]
    enc = tokens.Encoder(tokens.vocabulary_path())
    want = enc.encode(texts, tokens.END_ID)
    monkeypatch.setattr(tokens, "BATCH", 50)
    monkeypatch.setattr(tokens, "ENTRIES", 80)
    got = tokens.Encoder(tokens.vocabulary_path()).encode(texts, tokens.END_ID)
    assert got.ids.tolist() == want.ids.tolist() and got.bounds.tolist() == want.bounds.tolist()


def test_pack_documents(docs, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BLOCK", 5)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("the sea is blue and very wide".split()) for _ in range(r.randint(0, 60)))) for i in range(80)]
    rows += [(900 + i, "one two three") for i in range(40)] + [(7, rows[7][1]), (None, "no id"), (1000, None), (1001, ""), (1002, "far " * 150)]
    got = packing.pack_documents(docs(rows, CLASHES), capacity=64).collect()
    enc = tokens.encoder()
    want = Counter()
    for i, t in rows:
        ids = enc.encode([t], tokens.END_ID).ids.tolist()
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k:k + 64]), zlib.crc32(array("I", ids[k:k + 64]).tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= -(-sum(x.length for x in got) // 64) + 3


def test_empty_table(docs):
    assert packing.pack_documents(docs([])).count() == 0
