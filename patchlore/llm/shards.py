"""Token ids in training order as fixed-stride binary shards (operator 8).

Every document is tokenised, closed by the end id and cut into sequences of
``LENGTH`` ids. Sequences are numbered 0 .. N - 1 by a prefix sum over documents;
a keyed Feistel network on the next even number of bits, walked until it lands
below N, permutes these numbers to global slots. Shard s holds the slots
[s * SHARD_SLOTS, (s + 1) * SHARD_SLOTS); range partitions of slots are sorted
and written, one file per shard, so that training reads files front to back and
resumes at any slot by arithmetic alone.

A record is a header (doc_id int64, piece int32, ids int32) and LENGTH ids of two
bytes, all little-endian, unused ids zero. A shard appears under its final name
only when it is complete, so a task that is run again replaces it by the same
bytes.

Defined results: null and empty texts are one sequence holding only the end id;
repeated rows are written as often as they occur; a null id is stored as -1; an
empty table writes no shard; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from patchlore.llm.icws import mix
from patchlore.llm.neardup import small
from patchlore.llm.registry import query, table
from patchlore.llm.tokens import END_ID, encoder, text_slices
from patchlore.session import cut, new_path

LENGTH = 512
SHARD_SLOTS = 2048
SHARDS_PER_TASK = 4
KEY = 0x5EED
ROUNDS = 6
ROWS_PER_BLOCK = 100_000
ENTRIES = 2_000_000    # chunks a worker keeps from the counting pass to the writing pass
RECORD = np.dtype([("doc", "<i8"), ("piece", "<i4"), ("n", "<i4"), ("ids", "<u2", (LENGTH,))])
STRIDE = RECORD.itemsize


def permute(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed bijection of 0 .. size - 1: Feistel rounds, repeated while outside (cycle-walking)."""
    half = max(1, ((max(1, size - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << np.uint64(half)) | right

    x = rounds(np.asarray(numbers).astype(np.uint64))
    out = np.flatnonzero(x >= size)
    while len(out):
        x[out] = rounds(x[out])
        out = out[x[out] >= size]
    return x.astype(np.int64)


def numbered(docs: DataFrame, vocabulary: str | None) -> tuple[DataFrame, int]:
    """(_id, _key, copies, pieces, first) for each distinct (id, text), and the number of sequences."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ENTRIES)
        for b in batches:
            n = [-(-np.diff(enc.encode(texts, END_ID).bounds) // LENGTH) for _, texts in text_slices(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], names=["_id", "_key", "pieces"])

    counts = cut(docs.select("_id", "_key", "_text").mapInArrow(count, "_id long, _key long, pieces long"), "counts")
    rows = counts.count()
    blocks = 1 + rows // ROWS_PER_BLOCK
    one = counts.groupBy("_id", "_key", "pieces").agg(F.count("*").alias("copies")).withColumn("block", F.pmod(F.xxhash64("_id", "_key"), F.lit(blocks)))
    size = F.col("pieces") * F.col("copies")
    within = Window.partitionBy("block").orderBy("_id", "_key").rowsBetween(Window.unboundedPreceding, -1)
    one = cut(one.withColumn("in_block", F.coalesce(F.sum(size).over(within), F.lit(0))), "in-block")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    bases = one.groupBy("block").agg(F.sum(size).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("block", "base", "n")
    total = bases.agg(F.sum("n")).first()[0] or 0
    index = one.join(F.broadcast(bases.drop("n")), "block").withColumn("first", F.col("base") + F.col("in_block"))
    return cut(index.select("_id", "_key", "copies", "pieces", "first"), "numbered"), int(total)


def records(docs: DataFrame, size: int, key: int, vocabulary: str | None) -> DataFrame:
    """(slot, record) of every sequence of ``docs`` (_id, _text, first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ENTRIES)
        for b in batches:
            ids, first = (b.column(i).fill_null(-1).to_numpy() for i in (0, 2))
            for lo, texts in text_slices(b.column(1)):
                hi = lo + len(texts)
                got = enc.encode(texts, END_ID)
                sizes = np.diff(got.bounds)
                pieces = -(-sizes // LENGTH)
                owner = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                used = np.minimum(sizes[owner] - piece * LENGTH, LENGTH)
                out = np.zeros(len(owner), dtype=RECORD)
                out["doc"], out["piece"], out["n"] = ids[lo:hi][owner], piece, used
                out["ids"][np.arange(LENGTH) < used[:, None]] = got.ids  # both run through texts and pieces in order
                slots = permute(first[lo:hi][owner] + piece, size, key)
                ends = pa.py_buffer(np.arange(len(out) + 1, dtype=np.int32) * STRIDE)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.Array.from_buffers(pa.binary(), len(out), [None, ends, pa.py_buffer(out.view(np.uint8))])], names=["slot", "record"])

    return docs.select("_id", "_text", "first").mapInArrow(run, "slot long, record binary")


def joined(column: pa.Array, lo: int, hi: int) -> bytes:
    """The bytes of some rows of a binary column in a row, without a Python object for each."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset:]
    return column.buffers()[2].slice(int(ends[lo]), int(ends[hi] - ends[lo])).to_pybytes()


def shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def write_shards(docs: DataFrame, folder: str, key: int = KEY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write all shards into ``folder`` (a URI every executor can reach) and return the number of sequences."""
    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    index, size = numbered(picked, vocabulary)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    if not size:
        return 0
    single, several = index.filter("copies = 1"), index.filter("copies > 1")
    placed = located(picked, single)
    if several.limit(1).count():
        again = located(picked, several).dropDuplicates(["_id", "_key"])
        placed = placed.unionByName(again.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("first", F.col("first") + F.col("copy") * F.col("pieces")).drop("copy"))
    shard = F.floor(F.col("slot") / SHARD_SLOTS)
    tasks = -(-size // (SHARD_SLOTS * SHARDS_PER_TASK))
    ranged = records(placed, size, key, vocabulary).repartitionById(tasks, F.floor(shard / SHARDS_PER_TASK).cast("int")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = fs.FileSystem.from_uri(folder)
        shard_: int | None = None
        parts: list[bytes] = []
        done: list[tuple[int, int]] = []

        def close() -> None:
            if shard_ is not None:
                draft = f"{base}/_{shard_name(shard_)}-{np.random.default_rng().integers(1 << 62)}"
                with to.open_output_stream(draft) as f:
                    for p in parts:
                        f.write(p)
                to.move(draft, f"{base}/{shard_name(shard_)}")
                done.append((shard_, sum(map(len, parts)) // STRIDE))

        for b in batches:
            shards_ = b.column(0).to_numpy() // SHARD_SLOTS
            edges = np.flatnonzero(np.append(True, shards_[1:] != shards_[:-1]))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(shards_)], strict=True):
                if shards_[lo] != shard_:
                    close()
                    shard_, parts = int(shards_[lo]), []
                parts.append(joined(b.column(1), lo, hi))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in (0, 1)], names=["shard", "n"])

    written = ranged.mapInArrow(write, "shard long, n long").agg(F.sum("n")).first()[0]
    if written != size:
        raise RuntimeError(f"{written} of {size} sequences were written")
    return size


def located(docs: DataFrame, index: DataFrame) -> DataFrame:
    hit = F.col("_id").eqNullSafe(F.col("i")) & (F.col("_key") == F.col("k"))
    there = index.select(F.col("_id").alias("i"), F.col("_key").alias("k"), "copies", "pieces", "first")
    return docs.join(small(there), hit).select("_id", "_key", "_text", "copies", "pieces", "first")


def read_from(folder: str, slot: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(slot, doc_id, piece, ids) in training order from any slot on, reading forwards only."""
    files, root = fs.FileSystem.from_uri(folder)
    while stop is None or slot < stop:
        name = f"{root}/{shard_name(slot // SHARD_SLOTS)}"
        if files.get_file_info(name).type == fs.FileType.NotFound:
            return
        with files.open_input_file(name) as f:
            f.seek(slot % SHARD_SLOTS * STRIDE)
            while (stop is None or slot < stop) and len(data := f.read(STRIDE)) == STRIDE:
                r = np.frombuffer(data, dtype=RECORD)[0]
                yield slot, int(r["doc"]), int(r["piece"]), r["ids"][:r["n"]]
                slot += 1
        if slot % SHARD_SLOTS:
            return


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(slot, shard, doc_id, piece, length, ids_crc32) of every record; the checksum is over unsigned 32-bit ids."""
    files, root = fs.FileSystem.from_uri(folder)
    names = [f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("shard-")]
    shards = int(max(names).split("-")[1].split(".")[0]) + 1 if names else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for shard in b.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{shard_name(shard)}") as f:
                    r = np.frombuffer(f.read(), dtype=RECORD)
                crc = [zlib.crc32(x[:n]) for x, n in zip(r["ids"].astype("<u4"), r["n"].tolist(), strict=True)]
                slots = shard * SHARD_SLOTS + np.arange(len(r))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(r), shard)), pa.array(r["doc"].copy()), pa.array(r["piece"].copy()), pa.array(r["n"].astype(np.int64)), pa.array(crc, pa.int64())],
                                                 names=["slot", "shard", "doc_id", "piece", "length", "ids_crc32"])

    found = spark.range(0, shards, 1, max(1, -(-shards // SHARDS_PER_TASK)))
    return found.mapInArrow(run, "slot long, shard long, doc_id long, piece int, length long, ids_crc32 long")


@query("op8_training_order")
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(spark, folder)
