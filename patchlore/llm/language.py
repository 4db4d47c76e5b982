"""Language of whole texts by a byte-level bidirectional GRU (operator 2).

The network labels every byte that is not white space. Its state starts anew at
each white space and, inside long runs without any, every ``WINDOW`` bytes. So
equal words have equal labels, and a worker computes each word once and keeps
its summed probabilities in a table of bounded size. A document's probabilities
are the mean over all its labelled bytes.

The network is fitted on a bounded sample: about ``SAMPLE_DOCS`` documents per
language, ``SAMPLE_WORDS`` words spread evenly over each of them.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any usable training row every text is ``und``; repeated rows are
labelled one by one; columns other than id, text and (in training) the label
are ignored; ties go to the language that sorts first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlore.llm import gru
from patchlore.llm.registry import beside, fields, query, table
from patchlore.llm.tokens import held, release, text_slices

SAMPLE_DOCS = 300     # documents per language that the network is fitted on, about
SAMPLE_WORDS = 60     # words of each of them, spread over the text
MAX_LANGUAGES = 200   # most frequent languages that are learned
WINDOW = 24
CACHE_ENTRIES = 300_000
LEAST_SCORE = 0.4     # pipeline: a text whose language is less certain is rejected
LETTER = re.compile(r"[^\W\d_]")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def windows_of(word: str) -> list[bytes]:
    data = word.encode("utf-8", "surrogatepass")
    return [data[i:i + WINDOW] for i in range(0, len(data), WINDOW)]


def sample_words(labelled: DataFrame, id_col: str, text_col: str, label_col: str, docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> tuple[list[str], list[tuple[str, str]]]:
    """Languages and (language, word) pairs of a sample whose size does not depend on the corpus."""
    sizes = {r[0]: r[1] for r in labelled.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return [], []
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs / n))])[F.col(label_col)]
    draw = F.pmod(F.xxhash64(F.lit("language sample"), id_col), F.lit(1_000_000)) / 1e6
    picked = labelled.filter(draw < share).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(lang, w) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in evenly((t or "").split(), words)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k][:4 * WINDOW] for x in out] if k else [x[0] for x in out], pa.string()) for k in (0, 1)], names=["lang", "word"])

    rows = picked.mapInArrow(spread, "lang string, word string").collect()
    return sorted(sizes), sorted((r[0], r[1]) for r in rows)


def evenly(items: Sequence[str], n: int) -> list[str]:
    return [items[i * len(items) // n] for i in range(n)] if len(items) > n else list(items)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **sample) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages, network) from labelled rows; rows with a null label or text are left out."""
    usable = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    langs, rows = sample_words(usable, id_col, text_col, label_col, **sample)
    at = {k: i for i, k in enumerate(langs)}
    pairs = [(w, at[lang]) for lang, word in rows for w in windows_of(word)]
    if not pairs:
        return [], None
    return langs, gru.train([w for w, _ in pairs], [y for _, y in pairs], len(langs))


class WordLabels:
    """Summed class probabilities over the bytes of each word, computed once per worker."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self.known: dict[str, int] = {}
        self.sums = np.zeros((0, len(model["bias"]) + 1), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        pieces: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, w in enumerate(words):
            for piece in windows_of(w):
                own = pieces.setdefault(len(piece), ([], []))
                own[0].append(i)
                own[1].append(piece)
        new = np.zeros((len(words), self.sums.shape[1]), dtype=np.float32)
        for n, (at, data) in pieces.items():
            for lo in range(0, len(at), 2048):
                x = np.frombuffer(b"".join(data[lo:lo + 2048]), dtype=np.uint8).reshape(-1, n)
                p = gru.positions(self.model, x).sum(axis=0)
                np.add.at(new, at[lo:lo + 2048], np.column_stack([p, np.full(len(p), n, dtype=np.float32)]))
        base = len(self.sums)
        self.sums = np.concatenate([self.sums, new])
        self.known.update(zip(words, range(base, base + len(words)), strict=True))

    def documents(self, texts: Sequence[str | None]) -> np.ndarray:
        """(documents, classes) mean probabilities; zero rows for texts without words."""
        split = [t.split() if t else [] for t in texts]
        new = list(set().union(*split) - self.known.keys())
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            self.sums = self.sums[:0]
            new = list(set().union(*split))
        if new:
            self.learn(new)
        known = self.known
        ids = np.array([known[w] for words in split for w in words], dtype=np.int64)
        ends = np.array(list(accumulate(len(w) for w in split)), dtype=np.int64)
        out = np.zeros((len(texts), self.sums.shape[1]), dtype=np.float64)
        full = [i for i, w in enumerate(split) if w]
        if full:
            starts = np.array([ends[i] - len(split[i]) for i in full])
            out[full] = np.add.reduceat(self.sums[ids].astype(np.float64), starts, axis=0)
        return out[:, :-1] / np.maximum(out[:, -1:], 1)


def model_key(model: dict[str, np.ndarray]) -> str:
    return "-".join(f"{zlib.crc32(v.tobytes()):08x}" for _, v in sorted(model.items()))


def identify(docs: DataFrame, langs: list[str], model: dict[str, np.ndarray] | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (in place of columns of these names); only the text is looked at."""
    return beside(docs, p=predictor(langs, model)(F.col(text_col))).select(*fields(docs, "lang_pred", "score"), "p.lang_pred", "p.score")


def predictor(langs: list[str], model: dict[str, np.ndarray] | None) -> Callable[[Column], Column]:
    """Text column -> struct of language and score."""
    if model is None:
        return lambda text: F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    key = model_key(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table_ = held(("language", key), lambda: WordLabels(model))
        for series in batches:
            found: list[tuple[str, float]] = []
            for _, texts in text_slices(pa.array(series, pa.string())):
                part = [t if t and LETTER.search(t) else None for t in texts]
                probs = table_.documents(part)
                best = probs.argmax(axis=1)
                found += [(langs[k], min(1.0, float(p[k]))) if t else ("und", 0.0) for t, k, p in zip(part, best, probs, strict=True)]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])
        release()

    return predict


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Pipeline stage: train on ``docs`` itself and keep the texts whose language is clear."""
    langs, model = train(docs.filter(~held_out(F.col("doc_id"))))
    got = beside(docs, p=predictor(langs, model)(F.col("text")))
    return got.filter((F.col("p.lang_pred") != "und") & (F.col("p.score") >= least)).select(*fields(docs))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, model = train(docs.filter(~held_out(F.col("doc_id"))))
    got = identify(docs.select("doc_id", "text"), langs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
