"""SentencePiece encoding and decoding with a weighted transducer (operator 4).

A model file is compiled into three machines: the normaliser (a marker in front,
a marker for each space), a trie of the pieces, and arcs that spell a character
without a piece as its bytes. Composed with an input they give a lattice whose
arcs are pieces; the encoding is its shortest path in the tropical semiring.

The pieces come from a byte-pair model, so an arc is free only if it may follow
the piece before it: merging the two pieces' characters by score must give just
these two pieces again. Any other arc costs one, a spelled character
``FALLBACK``. A path of free arcs is the model's own encoding, and each prefix
has only one, so one state per position is enough.

No piece crosses a pair of characters that occurs in no piece, so the lattice
falls apart there; the parts repeat, and a worker remembers their paths up to a
bound. Decoding runs the transducer the other way.

Defined results: a null text has null ids and an empty text none; the marker
character itself decodes as a space (the model writes both alike); ids that are
control pieces decode to nothing, bytes that are not UTF-8 to U+FFFD; repeated
rows are encoded one by one; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlore.llm.registry import query, table
from patchlore.llm.tokens import held, text_slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
FALLBACK = 1000
CACHE_ENTRIES = 400_000
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(MODEL)


class Transducer:
    """The compiled model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or spec.trainer_spec.model_type != 2:
            raise ValueError("only byte-pair models with the identity normaliser are compiled")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.spells: list[bytes] = []
        self.trie: dict = {}
        self.joined: set[str] = set()      # pairs of characters that some piece holds side by side
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.spells.append(bytes([int(piece[3:5], 16)]))
                continue
            control = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
            self.spells.append(b"" if control else piece.replace(MARK, " ").encode())
            if control:
                continue
            self.score[piece], self.id_of[piece] = sp.get_score(i), i
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = piece
            self.joined.update(a + b for a, b in zip(piece, piece[1:]))
        self.free: dict[tuple[str | None, str], bool] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Characters merged by score, the leftmost of equal pairs first."""
        symbols = list(text)
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, before: str | None, piece: str) -> bool:
        key = (before, piece)
        known = self.free.get(key)
        if known is None:
            if len(self.free) >= 4 * CACHE_ENTRIES:
                self.free.clear()
            known = self.free[key] = self.merge((before or "") + piece) == ([piece] if before is None else [before, piece])
        return known

    def shortest_path(self, text: str) -> bytes:
        """Ids on the cheapest path through the lattice of ``text``; of equal paths the one whose last piece is longer."""
        n = len(text)
        cost: list[float] = [0.0] + [float("inf")] * n
        last: list[str | None] = [None] * (n + 1)      # the piece into each position, null after spelled bytes
        start = [0] * (n + 1)
        root, free, may_follow = self.trie, self.free, self.may_follow
        for i in range(n):
            base, before, node, j = cost[i], last[i], root, i
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                piece = node.get(None)
                if piece is not None and cost[j] > base:
                    ok = free.get((before, piece))
                    c = base if (may_follow(before, piece) if ok is None else ok) else base + 1
                    if c < cost[j]:
                        cost[j], last[j], start[j] = c, piece, i
            if text[i] not in self.id_of and base + FALLBACK < cost[i + 1]:
                cost[i + 1], last[i + 1], start[i + 1] = base + FALLBACK, None, i
        back: list[int] = []
        while n:
            piece = last[n]
            back += [self.byte_id[b] for b in reversed(text[start[n]:n].encode())] if piece is None else [self.id_of[piece]]
            n = start[n]
        return array("I", reversed(back)).tobytes()

    def segment(self, text: str) -> bytes:
        """Shortest path of a segment, part by part where no piece can cross."""
        out, at, joined, parts = [], 0, self.joined, self.parts
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1:k + 1] not in joined:
                part = text[at:k]
                got = parts.get(part)
                if got is None:
                    if len(parts) >= CACHE_ENTRIES:
                        parts.clear()
                    got = parts[part] = self.shortest_path(part)
                out.append(got)
                at = k
        return b"".join(out)


class Encoder(dict):
    """word (without its leading space) -> ids of the marked word, filled on demand."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        got = self[word] = self.machine.segment(MARK + word)
        return got

    def encode(self, text: str | None) -> bytes | None:
        """Little-endian unsigned 32-bit ids of a text."""
        if not text:
            return None if text is None else b""
        words = text.split(" ")
        if self.machine.prefix and "" not in words and MARK not in text:
            return b"".join(map(self.__getitem__, words))
        return b"".join([self.machine.segment(s) for s in SEGMENT.findall(self.machine.prefix + text.replace(" ", MARK))])

    def decode(self, ids: Sequence[int] | None) -> str | None:
        if ids is None:
            return None
        spells = self.machine.spells
        text = b"".join([spells[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.machine.prefix and text[:1] == " " else text


def encoder(path: str | None = None) -> Encoder:
    """One encoder per Python worker and model."""
    path = model_path(path)
    return held(("pieces", path), lambda: Encoder(Transducer(path)))


def encode_texts(docs: DataFrame, model: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (array of int)."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        enc = encoder(model)
        return pd.Series([None if (d := enc.encode(t)) is None else list(array("I", d)) for t in texts], dtype=object)

    return docs.withColumn("ids", ids(F.col(text_col)))


def decode_ids(docs: DataFrame, model: str | None = None, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id list."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        enc = encoder(model)
        return pd.Series([enc.decode(None if i is None else i.tolist() if hasattr(i, "tolist") else i) for i in ids], dtype=object)

    return docs.withColumn(to, text(F.col(ids_col)))


def round_trips(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_decoded, exact): what encoding gives and whether decoding gives the text back.

    Both ways run in one task, so the id lists, larger than the texts, are never written.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            for lo, texts in text_slices(b.column(1)):
                n, crc, size, same = [], [], [], []
                for t in texts:
                    data = enc.encode(t)
                    back = None if data is None else enc.decode(memoryview(data).cast("I"))
                    n.append(None if data is None else len(data) // 4)
                    crc.append(None if data is None else zlib.crc32(data))
                    size.append(None if back is None else len(back))
                    same.append(back == (None if t is None else t.replace(MARK, " ")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(same)],
                                                 names=["doc_id", "n_ids", "ids_crc32", "n_decoded", "exact"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_decoded long, exact boolean")


@query("op4_pieces")
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
