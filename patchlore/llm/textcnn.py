"""A convolutional text classifier over hashed words, in numpy.

Words are hashed to buckets and buckets to embedding rows; filters of several
widths slide over the embeddings, each filter keeps its maximum over the text,
and a logistic layer reads the maxima. Buckets seen in fewer than ``LEAST_TEXTS``
training texts share one row, so rare and unknown words look alike.

The first embedding channel starts as the word's smoothed log-odds of the label;
all parameters are then trained by gradient descent (Adagrad), the gradient
passing through the position of each maximum.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

BUCKETS = 1 << 17
LEAST_TEXTS = 3
CHANNELS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PRIOR = 10.0          # pseudo texts behind each word's log-odds
CACHE_ENTRIES = 300_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def buckets_of(words: Sequence[str], known: dict[str, int]) -> np.ndarray:
    """Buckets of a text's words; ``known`` remembers words up to a bound."""
    if len(known) > CACHE_ENTRIES:
        known.clear()
    out = np.empty(len(words), dtype=np.int32)
    for i, w in enumerate(words):
        b = known.get(w)
        if b is None:
            b = known[w] = bucket(w)
        out[i] = b
    return out


@dataclass
class Model:
    """row_of: bucket -> embedding row; row 0 is padding, row 1 the shared rare row."""
    row_of: np.ndarray
    embed: np.ndarray            # (rows, channels)
    conv: list[np.ndarray]       # per width: (width, channels, filters)
    conv_bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float


class Rows(dict):
    """word -> embedding row, remembered up to a bound."""

    def __init__(self, row_of: np.ndarray):
        super().__init__()
        self.row_of = row_of

    def __missing__(self, word: str) -> int:
        row = int(self.row_of[bucket(word)])
        if len(self) < CACHE_ENTRIES:
            self[word] = row
        return row


def flatten(texts: Sequence[Sequence[int]], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows in a line with ``pad`` padding rows after each text; start and end of each text (never empty)."""
    flat: list[int] = []
    starts, ends = [], []
    for t in texts:
        starts.append(len(flat))
        flat.extend(t or (0,))
        ends.append(len(flat))
        flat.extend([0] * pad)
    return np.array(flat, dtype=np.int64), np.array(starts), np.array(ends)


class Scorer:
    """Scores of whole texts. Each filter's response to each embedding row is tabled once."""

    def __init__(self, model: Model, rows: Rows | None = None):
        self.model = model
        self.rows = Rows(model.row_of) if rows is None else rows
        self.tables = [[(model.embed @ w[o]).astype(np.float32) for o in range(len(w))] for w in model.conv]

    def pooled(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(texts, widths * filters) maxima."""
        cuts = np.column_stack([starts, ends]).reshape(-1)
        out = []
        n = len(flat) - max(WIDTHS) + 1
        for table, bias in zip(self.tables, self.model.conv_bias, strict=True):
            h = table[0][flat[:n]]
            for o in range(1, len(table)):
                h += table[o][flat[o:n + o]]
            out.append(np.maximum(np.maximum.reduceat(h, cuts, axis=0)[::2] + bias, 0))
        return np.concatenate(out, axis=1)

    def rows_of(self, texts: Sequence[str | None]) -> list[list[int]]:
        get = self.rows.__getitem__
        return [[get(w) for w in words_of(t)] for t in texts]

    def logits_of_rows(self, rows: Sequence[Sequence[int]]) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        return self.pooled(*flatten(rows, max(WIDTHS))) @ self.model.out + self.model.out_bias

    def logits(self, texts: Sequence[str | None]) -> np.ndarray:
        return self.logits_of_rows(self.rows_of(texts))


def seen_and_hits(buckets: Sequence[np.ndarray], labels: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each bucket occurs, and in how many with the label."""
    seen = np.zeros(BUCKETS)
    hits = np.zeros(BUCKETS)
    for own, y in zip(buckets, labels, strict=True):
        own = np.unique(own)
        seen[own] += 1
        hits[own] += y
    return seen, hits


def start_model(seen: np.ndarray, hits: np.ndarray, texts: int, positive: int, rng: np.random.Generator) -> Model:
    base = (positive + 1) / (texts + 2)
    frequent = np.flatnonzero(seen >= LEAST_TEXTS)
    row_of = np.ones(BUCKETS, dtype=np.int32)
    row_of[frequent] = np.arange(len(frequent)) + 2
    embed = rng.normal(0, 0.05, (len(frequent) + 2, CHANNELS))
    rate = (hits[frequent] + PRIOR * base) / (seen[frequent] + PRIOR)
    embed[2:, 0] = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    embed[:2] = 0
    conv = [rng.normal(0, 0.3, (w, CHANNELS, FILTERS)) for w in WIDTHS]
    for w in conv:
        w[:, 0, :] = np.abs(w[:, 0, :]) + 0.3
    return Model(row_of, embed, conv, [np.zeros(FILTERS) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1), float(np.log(base / (1 - base))))


class Training:
    """A model with the squared gradients that Adagrad has summed; ``state`` and ``load`` turn both into rows of CHANNELS numbers."""

    def __init__(self, model: Model):
        self.model = model
        self.past = np.zeros_like(model.embed)
        self.past_out, self.past_bias = np.zeros_like(model.out), 0.0
        self.past_conv = [np.zeros_like(w) for w in model.conv]
        self.past_conv_bias = [np.zeros_like(b) for b in model.conv_bias]

    def state(self) -> np.ndarray:
        """(rows, 2 * CHANNELS): parameters and squared gradients, embedding rows first."""
        m = self.model
        dense = [np.concatenate([*(w.ravel() for w in conv), *bias, out, [last]])
                 for conv, bias, out, last in ((m.conv, m.conv_bias, m.out, m.out_bias), (self.past_conv, self.past_conv_bias, self.past_out, self.past_bias))]
        dense = [np.append(d, np.zeros(-len(d) % CHANNELS)).reshape(-1, CHANNELS) for d in dense]
        return np.hstack([np.vstack([m.embed, dense[0]]), np.vstack([self.past, dense[1]])])

    def load(self, state: np.ndarray) -> None:
        m, n = self.model, len(self.model.embed)
        m.embed, self.past = state[:n, :CHANNELS].copy(), state[:n, CHANNELS:].copy()
        for half, conv, bias in ((state[n:, :CHANNELS], m.conv, m.conv_bias), (state[n:, CHANNELS:], self.past_conv, self.past_conv_bias)):
            flat, at = half.ravel(), 0
            for group in (conv, bias):
                for i, w in enumerate(group):
                    group[i] = flat[at:at + w.size].reshape(w.shape).copy()
                    at += w.size
            out, last = flat[at:at + m.out.size].copy(), float(flat[at + m.out.size])
            if conv is m.conv:
                m.out, m.out_bias = out, last
            else:
                self.past_out, self.past_bias = out, last

    def epoch(self, rows: Sequence[np.ndarray], y: np.ndarray, rng: np.random.Generator, batch: int = 32, rate: float = 0.05, decay: float = 1e-4) -> None:
        """One pass over texts given as embedding rows, in random order."""
        model, past, past_conv, past_bias = self.model, self.past, self.past_conv, self.past_conv_bias
        last = max(WIDTHS) - 1
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            pooled = np.zeros((len(part), len(model.out)))
            picked: list[list[tuple[np.ndarray, np.ndarray]]] = []
            for i, k in enumerate(part):
                e = model.embed[np.concatenate([rows[k], np.zeros(last, dtype=np.int64)])]
                n = len(rows[k])
                of_text = []
                for j, (w, b) in enumerate(zip(model.conv, model.conv_bias, strict=True)):
                    h = sum(e[o:n + o] @ w[o] for o in range(len(w))) + b
                    at = h.argmax(axis=0)
                    pooled[i, j * FILTERS:(j + 1) * FILTERS] = np.maximum(h[at, np.arange(FILTERS)], 0)
                    of_text.append((at, h[at, np.arange(FILTERS)] > 0))
                picked.append(of_text)
            z = pooled @ model.out + model.out_bias
            d = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
            d_pooled = np.outer(d, model.out)
            g_out = pooled.T @ d + decay * model.out
            g_conv = [decay * w for w in model.conv]
            g_bias = [np.zeros_like(b) for b in model.conv_bias]
            g_rows: dict[int, np.ndarray] = {}
            for i, k in enumerate(part):
                ext = np.concatenate([rows[k], np.zeros(last, dtype=np.int64)])
                for j, (at, live) in enumerate(picked[i]):
                    g = d_pooled[i, j * FILTERS:(j + 1) * FILTERS] * live
                    g_bias[j] += g
                    for o in range(len(model.conv[j])):
                        r = ext[at + o]
                        g_conv[j][o] += (model.embed[r] * g[:, None]).T
                        for f in np.flatnonzero(live):
                            g_rows.setdefault(int(r[f]), np.zeros(CHANNELS))
                            g_rows[int(r[f])] += g[f] * model.conv[j][o][:, f]
            self.past_out += g_out ** 2
            model.out -= rate * g_out / (np.sqrt(self.past_out) + 1e-6)
            self.past_bias += d.sum() ** 2
            model.out_bias -= rate * d.sum() / (np.sqrt(self.past_bias) + 1e-6)
            for j in range(len(WIDTHS)):
                past_conv[j] += g_conv[j] ** 2
                model.conv[j] -= rate * g_conv[j] / (np.sqrt(past_conv[j]) + 1e-6)
                past_bias[j] += g_bias[j] ** 2
                model.conv_bias[j] -= rate * g_bias[j] / (np.sqrt(past_bias[j]) + 1e-6)
            for r, g in g_rows.items():
                if r > 1:  # padding and rare words stay neutral
                    past[r] += g ** 2
                    model.embed[r] -= 0.2 * rate * g / (np.sqrt(past[r]) + 1e-6)


def train(texts: Sequence[np.ndarray], labels: Sequence[int], epochs: int = 12, seed: int = 11) -> Model:
    """Fit on the word buckets of texts."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float64)
    own = [t if len(t) else np.zeros(1, dtype=np.int32) for t in texts]
    training = Training(start_model(*seen_and_hits(own, y), len(y), y.sum(), rng))
    rows = [training.model.row_of[b] for b in own]
    for _ in range(epochs):
        training.epoch(rows, y, rng)
    return training.model
