"""Embedding texts with a pluggable function, unit vectors, exact inner-product top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import best, by_score, unit
from ..sources.workspace import materialise
from .cluster_topk import Plan
from .task_topk import matrix_of, search_rows

# Texts in, one float vector per text out.
Embedder = Callable[[list[str]], np.ndarray]

BATCH = 100
# Components of query vectors held by every task at once, about 50 MB; and vectors, each with its list in every task.
QUERY_CELLS = 4_096 * 1_536
MOST_QUERIES = 16_384
# Documents per block of a cluster, where queries are too many for that.
DOC_BLOCK = 20_000


def hashing_embedder(dimension: int) -> Embedder:
    """Deterministic embedder: token counts in md5 buckets, unit length."""

    def embed_batch(texts: list[str]) -> np.ndarray:
        bucket: dict[str, int] = {}
        out = np.zeros((len(texts), dimension))
        for row, text in enumerate(texts):
            tokens = text.split()
            for token in set(tokens).difference(bucket):
                bucket[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimension
            out[row] = np.bincount([bucket[token] for token in tokens], minlength=dimension)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1.0)).astype(np.float32)

    return embed_batch


def first_available(providers: Sequence[tuple[str, Callable[[], bool], Embedder]], default: str) -> tuple[str, Embedder]:
    """Name and embedder of the first provider that is available, else of the default one."""
    for name, available, embedder in providers:
        if available():
            return name, embedder
    return next((name, embedder) for name, _, embedder in providers if name == default)


def embedded(texts: list[str], embedder: Embedder, batch_size: int = BATCH) -> pa.ListArray:
    """The vectors of ``texts``, asked for in batches; one that gives another shape fails."""
    parts = []
    for start in range(0, len(texts), batch_size):
        chosen = texts[start : start + batch_size]
        vectors = np.asarray(embedder(chosen), dtype=np.float32)
        if vectors.ndim != 2 or vectors.shape[0] != len(chosen) or vectors.shape[1] == 0:
            raise ValueError(f"embedder gave shape {vectors.shape} for {len(chosen)} texts")
        offsets = np.arange(len(chosen) + 1, dtype=np.int32) * vectors.shape[1]
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch_size: int = BATCH) -> DataFrame:
    """(key, embedding): ``embedder`` over batches of texts. A batch that fails fails the job."""
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                lists = embedded(part.column(1).to_pylist(), embedder, batch_size)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "embedding"])

    schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )
    return df.select(key, text).mapInArrow(run, schema)


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, unit(F.col(column)))


def query_units(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Query vectors at unit length; those that have it up to float rounding stay as they are."""
    squares = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.withColumn(column, F.when(F.abs(F.sqrt(squares) - 1) > 1e-6, unit(F.col(column))).otherwise(F.col(column)))


def dimension_check(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Dimension of the vectors and whether all of them agree."""
    size = F.size(column)
    return vectors.filter(F.col(column).isNotNull()).agg(
        F.count("*").alias("n_vectors"),
        F.max(size).alias("dimension"),
        (F.min(size) == F.max(size)).alias("uniform"),
    )


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    query_block: int | None = None,
    doc_block: int = DOC_BLOCK,
) -> DataFrame:
    """(query_id, doc_id, score, rk): exact inner-product top-k of every query over all documents.

    ``vectors`` is (doc_id, embedding), ``queries`` is (query_id, embedding). Each task multiplies its
    documents with a block of queries and hands on only its k best per query, so score pairs are never
    rows and never shuffled. Up to ``query_block`` queries go to every task as one broadcast matrix and
    the documents stay where they are (unless given, as many as ``QUERY_CELLS`` allows at their dimension); more meet the blocks of documents, by cluster, that can still reach their k-th score.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), "embedding").filter(
        F.col("embedding").isNotNull()
    )
    queries = materialise(queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull()), "query-vectors")
    id_type = queries.schema["query_id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    names = schema.fieldNames()
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimension")).first()
    n_queries = size["n"]
    if query_block is None:
        query_block = min(MOST_QUERIES, max(1, QUERY_CELLS // max(1, size["dimension"] or 1)))

    if n_queries <= query_block:
        block = queries.toArrow()
        dimension = len(block.column(1)[0]) if block.num_rows else 0
        shared = spark.sparkContext.broadcast(
            (block.column(0).combine_chunks(), matrix_of(block.column(1), dimension)) if block.num_rows else None
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if shared.value is None:
                return
            query_ids, matrix = shared.value
            rows = ((b.column(0).to_numpy(zero_copy_only=False), b.column(1)) for b in batches if b.num_rows)
            yield from search_rows(rows, matrix, k).table(query_ids, names).to_batches()

        found = vectors.mapInArrow(scan, schema)
    else:
        plan = Plan(vectors, queries, k, query_block, doc_block, schema)
        found = spark.createDataFrame([], schema) if plan.empty else plan.rows()
    return best(found, k, ["query_id"], by_score())
