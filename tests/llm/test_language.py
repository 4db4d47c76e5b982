import random
import zlib

import numpy as np

from patchlore.llm import gru, language
from tests.llm.conftest import CLASHES

WORDS = {"aa": "kor tam velik dro sanat perk".split(), "bb": "liu ai oue eia umi oao".split(), "cc": "xqz zzx qxx zqz xxq qqz".split()}


def texts(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 40))), lang))
    return rows


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.new_model(3, 4, 1).items()}
    x, y = rng.integers(0, 256, (4, 5)).astype(np.uint8), rng.integers(0, 3, 4)
    _, g = gru.gradients(p, x, y)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), p[k].shape)
        shifted = [gru.gradients({**p, k: p[k] + s * (np.arange(p[k].size).reshape(p[k].shape) == np.ravel_multi_index(at, p[k].shape))}, x, y)[0] for s in (1e-5, -1e-5)]
        assert abs((shifted[0] - shifted[1]) / 2e-5 - g[k][at]) < 1e-6


def test_remembered_words_equal_fresh_ones(monkeypatch):
    model = gru.train([w.encode() for ws in WORDS.values() for w in ws], [i for i, ws in enumerate(WORDS.values()) for _ in ws], 3, epochs=2)
    docs = [t for _, t, _ in texts(30)] + [None, "", "  ", "x" * 1000, "1 2"]
    fresh = [language.WordLabels(model).documents([t])[0] for t in docs]
    monkeypatch.setattr(language, "CACHE_ENTRIES", 7)
    table = language.WordLabels(model)
    for i in range(0, len(docs), 4):
        assert np.allclose(table.documents(docs[i:i + 4]), fresh[i:i + 4], atol=1e-5)
    whole = "x" * 1000
    by_hand = np.concatenate([gru.positions(model, np.frombuffer(w, np.uint8)[None])[:, 0] for w in language.windows_of(whole)]).mean(axis=0)
    assert np.allclose(language.WordLabels(model).documents([whole])[0], by_hand, atol=1e-5)


def test_held_out_accuracy_and_odd_rows(docs):
    rows = texts(400)
    odd = [(1000, None), (1001, ""), (1002, "12 !! 3"), (1003, "kor " * 20_000), (None, "liu ai umi"), (5, rows[5][1], rows[5][2])]
    table = docs(rows + odd, CLASHES)
    langs, model = language.train(table.filter(~language.held_out(table.doc_id)))
    assert langs == ["aa", "bb", "cc"]
    got = language.identify(table, langs, model)
    assert got.columns[-2:] == ["lang_pred", "score"]
    by_id = {r.doc_id: r.lang_pred for r in got.collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and sum(by_id[i] == lang for i, lang in held) / len(held) > 0.97
    assert [by_id[i] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"]


def test_training_does_not_see_held_out_labels(docs):
    rows = texts(200)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    table = docs(wrong)
    langs, model = language.train(table.filter(~language.held_out(table.doc_id)))
    assert "zz" not in langs


def test_nothing_to_learn_from(docs):
    langs, model = language.train(docs([(1, "a b", None), (2, None, "en")]))
    assert model is None
    assert [r.lang_pred for r in language.identify(docs([(1, "a b")]), langs, model).collect()] == ["und"]
    assert language.identify(docs([]), langs, model).count() == 0


def test_stage_keeps_clear_texts(docs):
    table = docs(texts(200) + [(1000, None, "aa"), (1001, "12 34", "aa")])
    kept = language.keep_known(table)
    assert kept.columns == table.columns and kept.count() == 200
