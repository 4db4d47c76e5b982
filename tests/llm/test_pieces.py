from array import array

import sentencepiece

from patchlore.llm import pieces
from tests.llm.conftest import CLASHES

TEXTS = ["", "a", " a", "a ", "hello  world", "  x", "\n", "x\ny\n\nz", "The quick brown fox, isn't it? http://www.example.com/a?b=c&d=e", "ﬁ ½ é 你好，世界 😀😀 \t tab​", "a" * 300, "=====....,,,,!!!!", "1234567890 3.14159",
         "\x00\x01<0x0A></s><s><unk>", "Donaudampfschifffahrtsgesellschaft über Straße naïveté", "an unusually long word: " + "antidisestablishmentarianism" * 40]


def test_ids_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    enc = pieces.encoder()
    for t in TEXTS:
        ids = list(array("I", enc.encode(t)))
        assert ids == sp.encode(t), t
        assert enc.decode(ids) == t == sp.decode(ids)


def test_shortest_path_is_cheapest():
    """Against all segmentations of short strings."""
    m = pieces.Transducer(pieces.model_path())
    names = {i: p for p, i in m.id_of.items()}

    def all_paths(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if text[:k] in m.id_of:
                for rest in all_paths(text[k:]):
                    yield [text[:k], *rest]
    for text in ("▁hello", "▁where", "aaaa", "▁▁▁a", "tion", "isn't"):
        free = [p for p in all_paths(text) if all(m.may_follow(a, b) for a, b in zip([None, *p], p))]
        assert free == [[names[i] for i in array("I", m.shortest_path(text))]] == [m.merge(text)]


def test_bounded_memory_changes_nothing(monkeypatch):
    want = [pieces.Encoder(pieces.Transducer(pieces.model_path())).encode(t) for t in TEXTS]
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 3)
    enc = pieces.Encoder(pieces.Transducer(pieces.model_path()))
    assert [enc.encode(t) for t in TEXTS] == want


def test_columns(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, ""), (None, "no id"), (90, None), (91, "long text " * 20_000), (92, "▁marked")]
    table = docs(rows)
    both = pieces.decode_ids(pieces.encode_texts(table)).collect()
    assert all(r.decoded == (None if r.text is None else r.text.replace("▁", " ")) for r in both)
    got = {r.doc_id: r for r in pieces.round_trips(docs(rows, CLASHES)).collect()}
    assert all(r.exact for r in got.values()) and got[90].n_ids is None and got[0].n_ids == 0 and got[91].n_decoded == 200_000
    assert {r.doc_id: len(r.ids) for r in both if r.ids is not None} == {i: r.n_ids for i, r in got.items() if i != 90}
    assert pieces.round_trips(docs([])).count() == 0
