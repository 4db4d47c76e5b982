from collections import Counter

import numpy as np
import pytest

from patchlore.llm import shards, tokens
from tests.llm.conftest import CLASHES


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 17, 100, 1000, 4097):
        a, b = shards.permute(np.arange(n), n), shards.permute(np.arange(n), n, key=9)
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert (shards.permute(np.arange(1000), 1000) != shards.permute(np.arange(1000), 1000, key=9)).mean() > 0.9


def wanted(rows):
    enc, out = tokens.encoder(), Counter()
    for i, t in rows:
        ids = enc.encode([t], tokens.END_ID).ids.tolist()
        for k in range(0, len(ids), shards.LENGTH):
            out[-1 if i is None else i, k // shards.LENGTH, tuple(ids[k:k + shards.LENGTH])] += 1
    return out


@pytest.fixture
def few_slots(monkeypatch):
    monkeypatch.setattr(shards, "SHARD_SLOTS", 16)
    monkeypatch.setattr(shards, "SHARDS_PER_TASK", 2)
    monkeypatch.setattr(shards, "ROWS_PER_BLOCK", 10)


def test_written_shards(spark, docs, tmp_path, few_slots):
    rows = [(i, "some words to fill a line " * (i % 9)) for i in range(120)] + [(5, "some words to fill a line " * 5)] * 3 + [(5, "another"), (None, "no id"), (500, None), (501, "long " * 5000)]
    table = docs(rows, CLASHES)
    folder = f"file://{tmp_path}/a"
    n = shards.write_shards(table, folder)
    found = list(shards.read_from(folder))
    assert [x[0] for x in found] == list(range(n))
    assert Counter((d, p, tuple(ids.tolist())) for _, d, p, ids in found) == wanted(rows)
    assert {f.stat().st_size for f in (tmp_path / "a").glob("shard-*")} <= {16 * shards.STRIDE, n % 16 * shards.STRIDE}
    resumed = list(shards.read_from(folder, 37))
    assert [(a[0], a[1], a[2]) for a in resumed] == [(a[0], a[1], a[2]) for a in found[37:]]
    assert [x[0] for x in shards.read_from(folder, 30, 50)] == list(range(30, 50))
    listed = shards.read_shards(spark, folder).orderBy("slot").collect()
    assert [(r.slot, r.doc_id, r.piece, r.length) for r in listed] == [(s, d, p, len(ids)) for s, d, p, ids in found]
    before = {f.name: f.read_bytes() for f in (tmp_path / "a").iterdir()}
    shards.write_shards(table.repartition(7), folder)  # other partitions, same bytes
    assert {f.name: f.read_bytes() for f in (tmp_path / "a").iterdir()} == before


def test_empty_table(spark, docs, tmp_path):
    assert shards.write_shards(docs([]), f"file://{tmp_path}/e") == 0
    assert shards.read_shards(spark, f"file://{tmp_path}/e").count() == 0 and list(shards.read_from(f"file://{tmp_path}/e")) == []
