"""Weighted shingles of texts and improved consistent weighted sampling, in numpy.

A text is the multiset of its five-word shingles; a shingle weighs its count
times an inverse document frequency. One sample of a weighted set (Ioffe 2010)
is a (shingle, level) pair that two sets share with probability equal to their
weighted Jaccard similarity. The random numbers of a sample come from a hash of
shingle and sample number, so they agree everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

WORDS = 5
HASH_BITS = 48        # of a shingle, so that text number and hash sort as one integer
CHUNK = 1 << 16
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)  # splitmix64
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, extended as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(2 * n, _BASE, dtype=np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.cumprod(steps)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def forget_powers() -> None:
    _powers.__init__()


@dataclass
class Words:
    """Word hashes of several texts in a row; text i has hashes[bounds[i] : bounds[i + 1]]."""
    hashes: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i]:self.bounds[i + 1]]


def hash_runs(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each run of bytes without a separator; ``data`` begins and ends with one."""
    apart = separator[data]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1     # first byte of a run, first byte after it, and so on
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    up, down = _powers.get(len(data))
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * up, edge)[::2]
    return starts, ends, mix(sums * down[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: Sequence[str | None]) -> Words:
    """Lower-cased words between ASCII white space, hashed over their bytes all at once."""
    parts = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    starts, _, hashes = hash_runs(np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", dtype=np.uint8), _SPACE)
    return Words(hashes, np.searchsorted(starts, np.cumsum([1] + [len(p) + 1 for p in parts])))


def fingerprint(words: np.ndarray) -> bytes | None:
    """128 bits of the word sequence; none for a text without words."""
    return blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None


def all_shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle occurrence.

    A text of fewer than five words is one shingle of all of them; no words, no shingle.
    """
    flat, bounds = words.hashes, words.bounds
    sizes = np.diff(bounds)
    few = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    short = np.zeros((len(few), WORDS), dtype=np.uint64)
    for row, i in zip(short, few, strict=True):
        row[:sizes[i]] = words.text(i)
    long_h, long_text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(flat) >= WORDS:
        text = np.repeat(np.arange(len(sizes)), sizes)
        n = len(flat) - WORDS + 1
        h = np.zeros(n, dtype=np.uint64)
        for k in range(WORDS):
            h = h * _GOLD + flat[k:k + n]
        inside = text[:n] == text[WORDS - 1:]
        long_h, long_text = h[inside], text[:n][inside]
    h = np.zeros(len(few), dtype=np.uint64)
    for k in range(WORDS):
        h = h * _GOLD + short[:, k]
    return mix(np.concatenate([long_h, h])) >> np.uint64(64 - HASH_BITS), np.concatenate([long_text, few])


@dataclass
class Shingles:
    """Distinct shingles of several texts in a row: hash (ascending within a text) and count; bounds[i] : bounds[i + 1] is text i."""
    hashes: np.ndarray
    counts: np.ndarray
    bounds: np.ndarray


def shingles(words: Words) -> Shingles:
    """At most 2**16 texts at once."""
    h, text = all_shingles(words)
    key = np.sort((text.astype(np.uint64) << np.uint64(HASH_BITS)) | h)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    bounds = np.searchsorted(key[at], np.arange(len(words.bounds), dtype=np.uint64) << np.uint64(HASH_BITS))
    return Shingles(key[at] & np.uint64((1 << HASH_BITS) - 1), np.diff(np.append(at, len(key))), bounds)


@dataclass
class Weights:
    """Inverse document frequency: a common shingle has its own weight, every other one ``rare``."""
    hashes: np.ndarray   # sorted
    values: np.ndarray
    rare: float

    def of(self, s: Shingles) -> np.ndarray:
        w = np.full(len(s.hashes), self.rare)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, s.hashes), len(self.hashes) - 1)
            w = np.where(self.hashes[at] == s.hashes, self.values[at], w)
        return w * s.counts


def samples(s: Shingles, weights: np.ndarray, count: int) -> np.ndarray:
    """(texts, count) 64-bit codes of the samples; rows of texts without shingles are zero."""
    texts = len(s.bounds) - 1
    out = np.zeros((texts, count), dtype=np.uint64)
    sizes = np.diff(s.bounds)
    log_w = np.log(weights).astype(np.float32)
    lo = 0
    while lo < texts:  # whole texts, about CHUNK shingles at a time
        hi = max(lo + 1, int(np.searchsorted(s.bounds, s.bounds[lo] + CHUNK, side="right")) - 1)
        full = np.flatnonzero(sizes[lo:hi]) + lo
        a, b = int(s.bounds[lo]), int(s.bounds[hi])
        if b > a:
            h, lw, n, starts = s.hashes[a:b], log_w[a:b], sizes[full], s.bounds[full] - a
            owner = np.repeat(np.arange(len(full)), n)
            for k in range(count):
                level, cost = one_sample(h, lw, k)
                best = np.minimum.reduceat(cost, starts)
                at = np.flatnonzero(cost == best[owner])
                at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
                out[full, k] = mix(h[at] ^ mix(level[at].astype(np.int64).view(np.uint64)))
        lo = hi
    return out


_SCALE = np.float32(2.0 ** -21)


def one_sample(h: np.ndarray, log_w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Level and log cost of each shingle for sample ``k``."""
    with np.errstate(over="ignore"):
        x = mix(h + np.uint64(2 * k + 1) * _GOLD)
        y = mix(x + _GOLD)
    low = np.uint64((1 << 21) - 1)
    unit = lambda v: ((v & low).astype(np.float32) + np.float32(0.5)) * _SCALE
    r = -np.log(unit(x) * unit(x >> np.uint64(21)))
    c = -np.log(unit(x >> np.uint64(42)) * unit(y))
    beta = unit(y >> np.uint64(21))
    level = np.floor(log_w / r + beta)
    return level, np.log(c) - r * (level - beta + np.float32(1))


def band_keys(codes: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) signed 64-bit keys from groups of ``rows`` samples; the band number is part of a key."""
    bands = codes.shape[1] // rows
    keys = np.zeros((len(codes), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(codes), b + 1, dtype=np.uint64)
        for i in range(rows):
            h = mix(h * _GOLD + codes[:, b * rows + i])
        keys[:, b] = h
    return keys.view(np.int64)


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard of two weighted sets given by sorted hashes."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = float(np.minimum(wa[ia], wb[ib]).sum())
    total = float(wa.sum() + wb.sum()) - common
    return common / total if total else 0.0
