"""Bit-sliced integer vectors: inner products and top rows by bitmap arithmetic.

Rows of a block are bit positions; slice (d, b) is the bitmap of bit b of
attribute d over all rows. An inner product with a query is a sum of shifted
slices: the query's components are written in signed digits, a negative digit
takes the complement of a slice (which differs by a constant for all rows), and
bitmaps of equal weight are added three at a time by carry-save adders.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BOUNDARY = 256  # so few candidate rows are resolved by their exact products


def signed_digits(value: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (power, +1 or -1), fewest non-zero digits."""
    out, power = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((power, digit))
            value -= digit
        value >>= 1
        power += 1
    return out


@dataclass
class Slices:
    rows: int
    low: int                # subtracted from every component
    words: np.ndarray       # (attributes, bits, words) unsigned 64-bit

    @staticmethod
    def build(values: np.ndarray) -> Slices:
        """``values``: (rows, attributes) integers, at least one row."""
        low = int(values.min())
        shifted = (values - low).astype(np.uint64).T
        bits = max(1, int(shifted.max()).bit_length())
        rows = values.shape[0]
        size = -(-rows // 64) * 8
        out = np.zeros((shifted.shape[0], bits, size), dtype=np.uint8)
        for b in range(bits):
            packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
            out[:, b, :packed.shape[1]] = packed
        return Slices(rows, low, out.view("<u8"))

    def values(self, rows: np.ndarray) -> np.ndarray:
        """The integers of some rows, read back from the slices."""
        bit = (self.words[:, :, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
        weights = (np.uint64(1) << np.arange(self.words.shape[1], dtype=np.uint64))
        return ((bit * weights[None, :, None]).sum(axis=1).astype(np.int64) + self.low).T

    def all_rows(self) -> np.ndarray:
        mask = np.full(self.words.shape[2], ~np.uint64(0), dtype=np.uint64)
        if self.rows % 64:
            mask[-1] = (np.uint64(1) << np.uint64(self.rows % 64)) - np.uint64(1)
        return mask

    def product_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of each row's inner product up to one constant for all rows."""
        columns: dict[int, list[tuple[np.ndarray, bool]]] = {}
        for d, q in enumerate(query.tolist()):
            for power, digit in signed_digits(int(q)):
                for b in range(self.words.shape[1]):
                    columns.setdefault(power + b, []).append((self.words[d, b], digit < 0))
        out: list[np.ndarray] = []
        carries = np.empty((0, self.words.shape[2]), dtype=np.uint64)
        weight = 0
        while weight <= max(columns, default=-1) or len(carries):
            own = columns.get(weight, [])
            stack = np.empty((len(own) + len(carries), self.words.shape[2]), dtype=np.uint64)
            for i, (bitmap, flip) in enumerate(own):
                np.invert(bitmap, out=stack[i]) if flip else np.copyto(stack[i], bitmap)
            stack[len(own):] = carries
            up = []
            while len(stack) > 2:
                n = len(stack) // 3
                a, b, c, rest = stack[:n], stack[n:2 * n], stack[2 * n:3 * n], stack[3 * n:]
                either = a ^ b
                up.append((a & b) | (c & either))
                stack = np.concatenate([either ^ c, rest])
            if len(stack) == 2:
                up.append((stack[0] & stack[1])[None])
                out.append(stack[0] ^ stack[1])
            else:
                out.append(stack[0] if len(stack) else np.zeros(self.words.shape[2], dtype=np.uint64))
            carries = np.concatenate(up) if up else carries[:0]
            weight += 1
        return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_candidates(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Row positions that hold the ``k`` best sums of ``among``.

    From the most significant slice down: rows above the boundary are sure,
    rows equal to it so far stay open. The scan ends when few rows are left or
    all open rows are equal; of equal rows the first positions are taken.
    """
    sure = np.zeros_like(among)
    open_ = among
    for s in reversed(slices):
        if count(sure | open_) <= max(k, BOUNDARY):
            return positions(sure | open_)
        ones = open_ & s
        with_ones = sure | ones
        if count(with_ones) >= k:
            open_ = ones
        else:
            sure, open_ = with_ones, open_ & ~s
    first = positions(open_)[:max(0, k - count(sure))]
    return np.concatenate([positions(sure), first])


def top_rows(block: Slices, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
    """[(score, id)] of the ``k`` best rows, ``ids`` ascending, ties to the smaller id; rows with the query's id are left out."""
    among = block.all_rows()
    lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
    for r in range(lo, hi):
        among[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
    rows = top_candidates(block.product_slices(query), among, k)
    scores = block.values(rows) @ query.astype(np.int64)
    order = np.lexsort((ids[rows], -scores))[:k]
    return [(int(scores[i]), int(ids[rows[i]])) for i in order]
