"""Exact top-k vectors by inner product over a bit-sliced index (operator 9).

The index is a table: one row per block of at most about ``BLOCK_ROWS`` vectors
with its bit slices (``bitslice``). Queries are a stated set of rows, dealt into
batches; a task holds one block and one batch, finds the block's best rows for
each query, and a ranking over (blocks * k) rows per query picks the result.

Defined results: vectors that are null, empty or hold null or non-finite
components, and rows without an id, take no part; vectors are compared only with
vectors of their own length; rows that repeat a query's id are the query's own;
of repeated query rows the smallest vector counts; ties go to the smaller id;
fewer than k candidates give fewer rows. Components must stay below 2**40 after
quantisation, so that a product fits 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from patchlore.llm.bitslice import Slices, top_rows
from patchlore.llm.registry import query, table
from patchlore.session import cut

SCALE = 1024
K = 10
BLOCK_ROWS = 60_000
QUERY_BATCH = 64

INDEX = "dim int, block long, n long, low long, bits int, ids binary, words binary"


def quantise(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    ok = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(finite(F.col(vector_col)), F.lit(False)))
    return ok.select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector_col), scale).alias("v")).withColumn("dim", F.size("v"))


def matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("v").combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, -1)


def build_block(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("id")
    s = Slices.build(matrix(t))
    ids = t.column("id").to_numpy().astype("<i8")
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([s.rows], pa.int64()), "low": pa.array([s.low], pa.int64()),
                     "bits": pa.array([s.words.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "words": pa.array([s.words.tobytes()], pa.binary())})


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Write the bit-sliced index of all usable vectors and return it."""
    q = quantised(vectors, id_col, vector_col, scale)
    blocks = 1 + q.count() // BLOCK_ROWS
    dealt = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return cut(dealt.groupBy("dim", "block").applyInArrow(build_block, INDEX), "bit-slices")


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows of the index for each row of ``queries``."""
    q = quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("m")).select("id", "m.*")
    batches = 1 + q.count() // QUERY_BATCH
    blocks = index.select("dim", F.col("block").alias("at"))
    asked = q.join(blocks, "dim").withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)))
    held = index.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            b = left.to_pylist()[0]
            s = Slices(b["n"], b["low"], np.frombuffer(b["words"], dtype="<u8").reshape(b["dim"], b["bits"], -1))
            ids = np.frombuffer(b["ids"], dtype="<i8")
            for query_id, vector in zip(right.column("id").to_pylist(), matrix(right), strict=True):
                found += [(query_id, vec, score) for score, vec in top_rows(s, ids, vector, query_id, k)]
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    asked = asked.select(F.col("dim").alias("q_dim"), "at", F.col("batch").alias("q_batch"), "id", "v")
    part = held.groupBy("dim", "block", "batch").cogroup(asked.groupBy("q_dim", "at", "q_batch")).applyInArrow(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= {K}
"""


@query("op9_exact_top_k", SQL)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.filter(F.col("vec_id") % 100 == 0))
