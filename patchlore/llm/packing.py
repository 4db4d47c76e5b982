"""Best-two-fit packing of documents into fixed-length sequences (operator 6).

Which pieces go together depends on their lengths only, and a length is at most
the capacity. So Spark counts the pieces per length, the driver packs that
histogram (at most ``capacity`` rows, whatever the size of the corpus), and the
resulting bin patterns are joined back to the pieces by length and rank.

A pattern is one bin filled by best-two-fit: fill greedily with the longest
piece that fits, then replace the bin's smallest piece with two unpacked pieces
that fit the expanded gap more tightly. As long as no length runs out the next
bin comes out the same, so a pattern is applied as often as its pieces last.

Defined results: null and empty texts are one piece that holds only the end id;
repeated rows are packed once each; an empty table gives an empty table; other
columns are ignored; a null id is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from patchlore.llm.registry import query, table
from patchlore.llm.tokens import END_ID, encoder, text_slices, tidy
from patchlore.session import cut

CAPACITY = 4096
SLICE_BYTES = 1 << 18   # of texts encoded at once
ROWS_PER_BLOCK = 20_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids; only longer documents are cut."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, texts in text_slices(batch.column(1), SLICE_BYTES):
                got = enc.encode(texts, END_ID)
                data = memoryview(got.ids.astype("<u4")).cast("B")
                out: list[tuple] = []
                for doc, a, b in zip(ids[lo:lo + len(texts)], got.bounds[:-1].tolist(), got.bounds[1:].tolist(), strict=True):
                    for k, at in enumerate(range(a, b, capacity)):
                        stop = min(at + capacity, b)
                        out.append((doc, k, at - a, stop - at, zlib.crc32(data[4 * at:4 * stop])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(pieces), PIECE)


def best_two(sizes: np.ndarray, left: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """Indices of two available sizes with the largest sum in (more_than, gap]; the larger first."""
    fit = np.flatnonzero((left > 0) & (sizes < gap))
    if not len(fit):
        return None
    have = sizes[fit]
    pos = np.searchsorted(have, gap - have, side="right") - 1  # the largest partner that still fits
    pos = np.minimum(pos, np.arange(len(fit)))  # count each pair once, partner not longer
    same = (pos == np.arange(len(fit))) & (left[fit] < 2)
    pos = np.where(same, pos - 1, pos)
    total = np.where(pos >= 0, have + have[np.maximum(pos, 0)], 0)
    best = int(np.argmax(total))
    if total[best] <= more_than:
        return None
    return int(fit[best]), int(fit[pos[best]])


def one_bin(sizes: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """Best-two-fit on the pieces left: {index of size: pieces of it}; ``left`` is used up."""
    bin_: dict[int, int] = {}
    gap = capacity
    top = len(sizes)
    while True:
        top = min(top, int(np.searchsorted(sizes, gap, side="right")))
        while top and left[top - 1] == 0:
            top -= 1
        if not top:
            break
        i = top - 1
        n = int(min(left[i], gap // sizes[i]))
        bin_[i] = bin_.get(i, 0) + n
        left[i] -= n
        gap -= n * int(sizes[i])
        top -= 1
    small = min(bin_)
    pair = best_two(sizes, left, gap + int(sizes[small]), int(sizes[small])) if gap else None
    if pair:
        bin_[small] -= 1
        left[small] += 1
        if not bin_[small]:
            del bin_[small]
        for i in pair:
            bin_[i] = bin_.get(i, 0) + 1
            left[i] -= 1
    return bin_


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(how often, {length: pieces per bin})] for all pieces of the histogram."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    plan = []
    while left.any():
        before = left.copy()
        bin_ = one_bin(sizes, left, capacity)
        # Three spare pieces of each size: one for a piece put back, two for a pair.
        times = max(1, min((int(before[i]) - 3) // n for i, n in bin_.items()))
        for i, n in bin_.items():
            left[i] = before[i] - n * times
        plan.append((times, {int(sizes[i]): n for i, n in sorted(bin_.items(), reverse=True)}))
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces per bin, first bin, offset in the bin) for each part of each pattern."""
    used: dict[int, int] = {}
    out, first = [], 0
    for times, bin_ in plan:
        offset = 0
        for length, n in bin_.items():
            lo = used.get(length, 0)
            used[length] = lo + n * times
            out.append((length, lo, lo + n * times, n, first, offset))
            offset += n * length
        first += times
    return out


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``_rank`` of each piece among those of its length, from 0, in blocks of bounded size."""
    blocks = 1 + rows // ROWS_PER_BLOCK
    pieces = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    within = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    starts = counts.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    numbered = pieces.withColumn("_in", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "_block"]).withColumn("_rank", F.col("_from") + F.col("_in")).drop("_from", "_in", "_block")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, ids_crc32, length) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = slots(pack_histogram(histogram, capacity))
    # Bounded by the capacity alone: each pattern uses up what some length can still give.
    where = spark.createDataFrame(plan, "_len long, _lo long, _hi long, _each long, _first long, _off long")
    r = ranked(pieces, sum(histogram.values()))
    hit = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    at = F.col("_rank") - F.col("_lo")
    placed = r.join(F.broadcast(where), hit).withColumns({
        "sequence_id": (F.col("_first") + F.floor(at / F.col("_each"))).cast("long"),
        "offset": (F.col("_off") + F.pmod(at, F.col("_each")) * F.col("length")).cast("long"),
    })
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    return pack(cut(token_pieces(docs, capacity, vocabulary), "pieces"), capacity)


@query("op6_best_two_fit")
def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
