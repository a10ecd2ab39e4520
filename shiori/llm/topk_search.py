"""Exact top-k inner products: columnar branch and bound.

Vectors are kept in vertical layout (dimensions x vectors). A query adds up its scores dimension block by dimension
block, the blocks where it has most mass first. After each block a candidate can gain at most the product of the
masses that remain on both sides (Cauchy-Schwarz); candidates that cannot reach the k-th best score are compacted away.

Stored vectors never move: blocks of queries, bounded in bytes, are broadcast to them one after the other.

Defined results: vectors that are null, or hold a null or non-finite component, take no part. Shorter vectors count as
filled with zeros. Rows with the same id are candidates of their own; as a query an id asks once, with its smallest
vector. A query never finds rows of its own id. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import fresh_path

BLOCK_DIMENSIONS = 8
# Bytes of query vectors sent to every task at once.
QUERY_BYTES = 32 << 20
# Vectors scored at once inside a task.
CHUNK_ROWS = 16_384
# Lists of one query are merged in groups of this many tasks before they meet.
MERGE_TASKS = 64

SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component of the valid vectors."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        vectors.filter(F.col(id_column).isNotNull() & x.isNotNull())
        .filter(finite)
        .select(
            F.col(id_column).cast("bigint").alias("vec_id"),
            F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"),
        )
    )


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """dimensions x vectors, int64; missing components are 0."""
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((width, len(sizes)), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return out


def best_of(query: np.ndarray, vertical: np.ndarray, mass: np.ndarray, own: np.ndarray, k: int, floor: int):
    """Columns of ``vertical`` with the k best scores, and all that tie with the last, at or above ``floor``.

    ``mass``: squared length of each column in each dimension block. ``own``: columns not to be found.
    """
    starts = np.arange(0, len(query), BLOCK_DIMENSIONS)
    weight = np.add.reduceat(query.astype(np.float64) ** 2, starts)
    order = np.argsort(-weight, kind="stable")
    alive = np.flatnonzero(~own)
    score = np.zeros(len(alive), dtype=np.int64)
    left = mass[:, alive].sum(axis=0)
    weight_left = weight.sum()
    for block in order:
        at = slice(starts[block], starts[block] + BLOCK_DIMENSIONS)
        part = vertical[at] if len(alive) == vertical.shape[1] else vertical[at][:, alive]
        score = score + query[at] @ part
        left = np.maximum(left - mass[block, alive], 0)
        weight_left = max(weight_left - weight[block], 0)
        gain = np.sqrt(left * weight_left) * (1 + 1e-9) + 1
        bound = floor
        if len(score) > k:
            worst = score - gain
            bound = max(bound, int(np.floor(np.partition(worst, len(worst) - k)[len(worst) - k])))
        keep = score + gain >= bound
        if not keep.all():
            alive, score, left = alive[keep], score[keep], left[keep]
    if len(score) > k:
        floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
    keep = score >= floor
    return alive[keep], score[keep]


class _Best:
    """The k best rows of one query so far, in final order."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else -(1 << 62)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def _search(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, block = queries.value
        best = [_Best(k) for _ in ids]
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK_ROWS):
                rows = batch.slice(begin, CHUNK_ROWS)
                found = rows.column("vec_id").to_numpy()
                vertical = _matrix(rows.column("v"), block.shape[0])
                asked = np.zeros((len(vertical), len(ids)), dtype=np.int64)
                asked[: len(block)] = block
                starts = np.arange(0, len(vertical), BLOCK_DIMENSIONS)
                mass = np.add.reduceat(vertical.astype(np.float64) ** 2, starts, axis=0) if len(vertical) else np.zeros((0, len(found)))
                for i, own in enumerate(ids):
                    at, score = best_of(asked[:, i], vertical, mass, found == own, k, best[i].floor)
                    best[i].add(found[at], score)
        sizes = [len(b.ids) for b in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, sizes)),
                pa.array(np.concatenate([b.ids for b in best])),
                pa.array(np.concatenate([b.scores for b in best])),
            ],
            names=["query_id", "vec_id", "score"],
        )

    return run


def _query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (ids, dimensions x queries), one at a time on the driver."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = size["width"] or 0
    rows = max(1, block_bytes // (8 * max(1, width)))
    n_blocks = -(-size["n"] // rows)
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))) if n_blocks > 1 else queries
    for b in range(n_blocks):
        block = (numbered.filter(F.col("block") == b) if n_blocks > 1 else numbered).select("vec_id", "v").toArrow()
        if block.num_rows:
            yield block.column("vec_id").to_numpy(), _matrix(block.column("v").combine_chunks(), width)


def _ranked(lists: DataFrame, k: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topk(
    vectors: DataFrame,
    k: int = 10,
    *,
    is_query,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 1024,
    block_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row; ``is_query`` is a column of ``vectors``."""
    spark: SparkSession = vectors.sparkSession
    queries = (
        quantised(vectors.filter(is_query), id_column, vector_column, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    )
    stored = quantised(vectors, id_column, vector_column, scale)
    path, blocks = fresh_path(spark, "topk"), 0
    for ids, block in _query_blocks(queries, block_bytes):
        sent = spark.sparkContext.broadcast((ids, block))
        found = stored.mapInArrow(_search(sent, k), SCHEMA).withColumn("task", F.spark_partition_id() % MERGE_TASKS)
        lists = _ranked(_ranked(found, k, ["query_id", "task"]).drop("rank", "task"), k, ["query_id"])
        lists.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        sent.destroy()
        blocks += 1
    if not blocks:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(path)
