"""Filling ranked lists up to a fixed depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import best, by_score
from ..sources.index_store import Index


def padded(index: Index, queries: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """Every list gets min(depth, N) rows: unmatched documents follow in id order with score 0.

    Scores are positive, so only the first ``depth`` documents by id can be fillers. Adding a filler's 0 to a matched
    document's score leaves that score as it was.
    """
    ids = index.first_ids(depth)
    fillers = queries.select(
        "query_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in ids])).alias("doc_id"), F.lit(0.0).alias("score")
    )
    # One shuffle by query serves both the sum per document and the ranking.
    merged = scores.unionByName(fillers).repartition("query_id").groupBy("query_id", "doc_id")
    return best(merged.agg(F.sum("score").alias("score")), depth, ["query_id"], by_score())
