"""Weighted fusion of the three ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import best, rounded


def scaled(ranked: DataFrame) -> DataFrame:
    """Scores divided by the list's maximum; all 0 when that is not positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(0.0))


def fuse(vector: DataFrame, keyword: DataFrame, tfidf: DataFrame, depth: int, vector_weight: float = 0.6) -> DataFrame:
    """(query_id, doc_id, score, rk): weighted sum over the lists, a missing score counting 0.

    Vector scores enter as they are, the other two scaled by their maximum; the rest of the weight is
    split evenly between them. Equal sums keep the order in which the documents first appear, going
    through the vector list, then BM25, then TF-IDF.
    """
    rest = (1 - vector_weight) / 2
    sources = [(vector, vector_weight), (scaled(keyword), rest), (scaled(tfidf), rest)]
    lists = [
        ranked.select(
            "query_id",
            "doc_id",
            (F.col("score") * weight).alias("part"),
            F.struct(F.lit(place).alias("source"), F.col("rk")).alias("seen"),
        )
        for place, (ranked, weight) in enumerate(sources)
    ]
    merged = (
        lists[0]
        .unionByName(lists[1])
        .unionByName(lists[2])
        .repartition("query_id")  # bounded rows per query: one shuffle for the sums and the ranking
        .groupBy("query_id", "doc_id")
        .agg(rounded(F.sum("part")).alias("score"), F.min("seen").alias("seen"))
    )
    return best(merged, depth, ["query_id"], [F.desc("score"), F.asc("seen")]).drop("seen")
