"""Exact top-k of very many query vectors: blocks of documents by cluster, passed over by centroid and radius.

1. Centres are taken from a bounded sample of the documents. Every document goes to its nearest centre, and the largest
   distance of each cluster is its radius. A cluster of any size is cut into blocks of about ``doc_block`` documents.
2. Each query searches the first blocks of its nearest clusters until they hold ``k`` documents. The k-th score there is
   a floor of its final k-th score.
3. An inner product in a cluster is at most centre . query + radius x |query|. A query meets only the blocks of clusters
   whose bound reaches its floor; a cluster's documents are copied once for each ``query_block`` queries that meet it.

Centres decide what is passed over, never the result. Vectors that are all alike give one cluster and no saving.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import SCALE, best, by_score
from ..sources.workspace import materialise
from .task_topk import TaskBest, matrix_of, search_rows

# Centres at most, documents of the sample they come from, and documents a centre stands for at least.
CENTRES, SAMPLE, DOCS_A_CENTRE = 1_024, 4_096, 64
ROUNDS = 3
# Rows held against all centres at once.
ROWS = 2_048


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of the sample's rows at most, by a few rounds of moving them to the means of their rows."""
    sample = sample[np.isfinite(sample).all(axis=1)]
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(n, len(centres))).astype(int)]
    for _ in range(ROUNDS):
        nearest, _ = nearest_of(sample, centres)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest_of(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centre and the distance to it."""
    nearest = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
    return nearest, np.sqrt(((rows - centres[nearest]) ** 2).sum(axis=1))


def clustered(vectors: DataFrame, centres) -> DataFrame:
    """(doc_id, embedding, cluster, distance) of every document; ``centres`` is a broadcast matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                nearest, distance = nearest_of(matrix_of(part.column(1), centres.value.shape[1]), centres.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest), pa.array(np.nan_to_num(distance, nan=np.inf))], names=["doc_id", "embedding", "cluster", "distance"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("cluster", T.LongType()), T.StructField("distance", T.DoubleType())])
    return vectors.mapInArrow(run, schema)


def met(queries: DataFrame, facts, k: int) -> DataFrame:
    """(query_id, embedding, floor, cluster): the clusters that each query meets.

    ``facts`` is a broadcast (centres, radius, documents in the first block). A query with a floor meets every cluster
    whose bound reaches it; one without meets the nearest clusters whose first blocks hold ``k`` documents together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, first = facts.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                asked = matrix_of(part.column(1), centres.shape[1])
                floor = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                scores = asked @ centres.T
                size = np.sqrt((asked**2).sum(axis=1))[:, None]
                # Scores are rounded before they are compared; sums differ in their last digits.
                slack = 1 / SCALE + 1e-9 * size * (np.sqrt((centres**2).sum(axis=1)) + radius)
                # Bounds that aren't numbers pass nothing over.
                meets = ~(scores + size * radius + slack < floor[:, None])
                meets[np.isnan(floor)] = False
                for row in np.flatnonzero(np.isnan(floor)):
                    order = np.argsort(-scores[row], kind="stable")
                    needed = np.searchsorted(np.cumsum(first[order]), k) + 1
                    meets[row, order[:needed]] = True
                row, cluster = np.nonzero(meets)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns), pa.array(cluster)], names=["query_id", "embedding", "floor", "cluster"])

    schema = T.StructType([*queries.schema.fields, T.StructField("cluster", T.LongType())])
    return queries.mapInArrow(run, schema)


def searched(docs: DataFrame, pairs: DataFrame, blocks: DataFrame, k: int, query_block: int, schema: T.StructType) -> DataFrame:
    """Best ``k`` of each query in each block that it meets. ``blocks`` is (cluster, salts), at most one row a centre."""
    parts = pairs.groupBy("cluster").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts")).join(F.broadcast(blocks), "cluster")
    parts = F.broadcast(parts)

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = docs.join(parts, "cluster").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("of")).cast("int"))
    left = left.filter(F.col("salt") < F.col("salts")).withColumn("part", every("parts")).select("cluster", "salt", "part", "doc_id", "embedding")
    right = pairs.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    right = right.withColumn("salt", every("salts")).select("cluster", "salt", "part", "query_id", "embedding", "floor")
    names = schema.fieldNames()

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids = right.column("query_id").combine_chunks()
        if not left.num_rows or not right.num_rows:
            return TaskBest(0, k).table(query_ids, names)
        asked = matrix_of(right.column("embedding"), len(right.column("embedding")[0]))
        floor = np.nan_to_num(right.column("floor").to_numpy().astype(float), nan=-np.inf)
        rows = left.combine_chunks()
        return search_rows([(rows.column("doc_id").to_numpy(), rows.column("embedding"))], asked, k, floor).table(query_ids, names)

    keys = ("cluster", "salt", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, schema)


class Plan:
    """Documents by cluster, and which clusters each query meets."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int, query_block: int, doc_block: int, schema: T.StructType):
        spark = vectors.sparkSession
        self.k, self.query_block, self.schema = k, query_block, schema
        sample = vectors.orderBy(F.xxhash64("doc_id")).limit(SAMPLE).select("embedding").toArrow().column(0)
        self.empty = not len(sample)
        if self.empty:
            return
        rows = matrix_of(sample, len(sample[0]))
        wanted = min(CENTRES, max(1, vectors.count() // DOCS_A_CENTRE))
        centres = centres_of(rows, wanted)
        self.docs = materialise(clustered(vectors, spark.sparkContext.broadcast(centres)), "clustered")
        of = F.ceil(F.count("*") / doc_block).cast("int")
        sizes = self.docs.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), of.alias("of"))
        sizes = sizes.join(self._first(sizes), "cluster", "left")
        # At most one row a centre.
        self.sizes = materialise(sizes.select("cluster", "n", "radius", "of", F.coalesce("first", F.lit(0)).alias("first")), "clusters")
        radius, first = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
        for r in self.sizes.collect():
            radius[r.cluster], first[r.cluster] = r.radius * (1 + 1e-9), r.first
        self.facts = spark.sparkContext.broadcast((centres[radius >= 0], radius[radius >= 0], first[radius >= 0]))
        # Clusters are told by their number among those with documents.
        number = np.cumsum(radius >= 0) - 1
        self.sizes = self.sizes.withColumn("number", F.element_at(F.array(*[F.lit(int(x)).cast("bigint") for x in number]), (F.col("cluster") + 1).cast("int")))
        self.docs = self.docs.join(F.broadcast(self.sizes.select("cluster", "number", "of")), "cluster").select("doc_id", "embedding", F.col("number").alias("cluster"), "of")
        self.sizes = self.sizes.select(F.col("number").alias("cluster"), "n", "of")
        none = queries.withColumn("floor", F.lit(None).cast("double"))
        seeds = materialise(met(none, self.facts, k), "seed-clusters")
        seeded = searched(self.docs, seeds, self.sizes.select("cluster", F.lit(1).alias("salts")), k, query_block, schema)
        floors = best(seeded, k, ["query_id"], by_score()).filter(F.col("rk") == k).select("query_id", F.col("score").alias("floor"))
        floors = queries.join(floors, "query_id", "left").select(*queries.columns, F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        self.pairs = materialise(met(floors, self.facts, k), "met-clusters")

    def _first(self, sizes: DataFrame) -> DataFrame:
        salted = self.docs.join(F.broadcast(sizes.select("cluster", "of")), "cluster")
        return salted.filter(F.pmod(F.xxhash64("doc_id"), F.col("of")) == 0).groupBy("cluster").agg(F.count("*").alias("first"))

    def rows(self) -> DataFrame:
        blocks = self.sizes.select("cluster", F.col("of").alias("salts"))
        return searched(self.docs, self.pairs, blocks, self.k, self.query_block, self.schema)

    def share_met(self) -> DataFrame:
        """(pairs, met): query-document pairs in all, and those whose score was worked out in the last step."""
        queries = self.pairs.select("query_id").distinct().count()
        reached = self.pairs.join(F.broadcast(self.sizes), "cluster").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met"))
        docs = self.sizes.agg(F.sum("n")).first()[0]
        return reached.select(F.lit(docs * queries).alias("pairs"), "met")
