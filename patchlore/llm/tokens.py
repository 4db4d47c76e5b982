"""Token ids of whole texts with a public tokenizer, inside tasks.

The word-end BPE drops white space before it looks at words, so the ids of a
text are the ids of its chunks between spaces and line feeds, in a row. Chunks
repeat, so each worker keeps the ids of up to ``ENTRIES`` of them in arrays and
looks up all chunks of many texts at once.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import TypeVar
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from patchlore.llm import icws
from patchlore.llm.icws import hash_runs

VOCABULARY = "word_bpe_49k.json"
ENTRIES = 500_000
BATCH = 250_000       # chunks looked up at once, at most ENTRIES
END_ID = 1

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[10, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

T = TypeVar("T")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level vocabularies: printable bytes stand for themselves, the rest for 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Encoded:
    """Ids of several texts in a row; text i has ids[bounds[i] : bounds[i + 1]]."""
    ids: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i]:self.bounds[i + 1]]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.n = 0
        self.data = np.zeros(1024, dtype=kind)

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(self.n + len(more), dtype=self.data.dtype)])
        self.data[self.n:self.n + len(more)] = more
        self.n += len(more)


class ChunkTable:
    """64-bit hash -> list of ids: open addressing, one array of all ids."""

    def __init__(self, entries: int):
        self.entries = entries
        size = 1 << (2 * entries).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.rows = np.zeros(size, dtype=np.int32)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.start, self.length, self.ids = Grown(np.uint32), Grown(np.uint32), Grown(np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not known."""
        at = keys & self.mask
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at[left]]
            hit = there == keys[left]
            found[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (there != 0)]
            at[left] = (at[left] + np.uint64(1)) & self.mask
        return found

    def add(self, keys: np.ndarray, lists: list[list[int]]) -> np.ndarray:
        """Rows of new, distinct keys."""
        rows = np.arange(len(keys)) + self.start.n
        length = np.array([len(x) for x in lists], dtype=np.int64)
        self.start.extend(self.ids.n + np.cumsum(length) - length)
        self.length.extend(length)
        self.ids.extend(np.array([i for x in lists for i in x], dtype=np.uint32))
        at = keys & self.mask
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.rows[at[won]] = rows[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + np.uint64(1)) & self.mask
        return rows


class Encoder:
    def __init__(self, path: str, entries: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.table = ChunkTable(entries or ENTRIES)
        self.marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ",."}

    def ids_of(self, chunk: str) -> list[int]:
        low = chunk.lower()
        if chunk.isalpha() and low.isalpha() and "\u03a3" not in chunk and is_normalized("NFC", chunk):
            # One pre-token whose normal form is its lower case (a capital sigma would depend on its place).
            return [t.id for t in self.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))]
        if chunk and chunk[-1] in self.marks and chunk[:-1].isalpha():
            return self.ids_of(chunk[:-1]) + self.marks[chunk[-1]]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def look_up(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some chunks in a row, and how many each chunk has."""
        if self.table.start.n + len(keys) > self.table.entries:
            self.table.clear()
        rows = self.table.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            distinct, first, again = np.unique(keys[new], return_index=True, return_inverse=True)
            at = new[first]
            lists = [self.ids_of(raw[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            rows[new] = self.table.add(distinct, lists)[again]
        length = self.table.length.data[rows].astype(np.int64)
        before = np.cumsum(length) - length
        return self.table.ids.data[np.repeat(self.table.start.data[rows].astype(np.int64) - before, length) + np.arange(length.sum())], length

    def encode(self, texts: Sequence[str | None], end: int | None = None) -> Encoded:
        """Ids of each text, with the id ``end`` after it if given; a null text has none of its own."""
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", dtype=np.uint8)
        offsets = np.cumsum([1] + [len(p) + 1 for p in parts])
        # Capitals fold, but not where a special token may stand, which is matched before folding.
        folded = data if any(b"<|" in p for p in parts) else _LOWER[data]
        raw = folded.tobytes()
        starts, ends, keys = hash_runs(folded, _SEPARATOR)
        got = [self.look_up(keys[i:i + BATCH], starts[i:i + BATCH], ends[i:i + BATCH], raw) for i in range(0, len(keys), BATCH)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in got)])
        upto = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in got)])))
        bounds = upto[np.searchsorted(starts, offsets)]
        if end is not None:
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
        return Encoded(ids, bounds)


def encoder(path: str | None = None, entries: int | None = None) -> Encoder:
    """One encoder per Python worker, vocabulary and table size."""
    path = vocabulary_path(path)
    return held(("tokens", path, entries), lambda: Encoder(path, entries))


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: one table or model at a time, the last one asked for."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Drop what this worker keeps: a stage that holds nothing between tasks must not carry the model of the stage before."""
    if _held:
        _held.clear()
        release()


def release() -> None:
    """Give memory that earlier tasks have freed back to the system: workers live on from stage to stage."""
    icws.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as a task that gives its freed memory back at its end: Spark keeps more workers than run at once."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return task


def text_slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``size`` bytes each, with the place of the first: only one run at a time becomes Python text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")))
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi
