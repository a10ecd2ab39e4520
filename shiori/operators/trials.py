"""Statistics of timing trials: per query and model, per model, the fastest model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import rounded


def trial(valid: Column, seconds: Column, n_indicators: Column) -> list[Column]:
    """A trial's columns; an invalid answer has no time and no indicators."""
    return [
        F.when(valid, seconds).alias("seconds"),
        F.when(valid, n_indicators).otherwise(0).alias("n_indicators"),
    ]


def _means(trials: DataFrame) -> DataFrame:
    return trials.groupBy("query", "model").agg(
        F.avg("seconds").alias("avg_seconds"),
        F.avg(F.coalesce("n_indicators", F.lit(0))).alias("avg_indicators"),
        (100.0 * F.count("seconds") / F.count("*")).alias("success_pct"),
    )


def per_query(trials: DataFrame) -> DataFrame:
    """Per query and model: mean of the measured times, mean indicators over all trials, success in %."""
    numbers = ["avg_seconds", "avg_indicators", "success_pct"]
    return _means(trials).select("query", "model", *[rounded(F.col(n)).alias(n) for n in numbers])


def per_model(trials: DataFrame) -> DataFrame:
    """Per model: means of the per-query means of the queries that have a time, and their share in %.

    Every query counts in the share, also for a model with no trial of it. Models without any time drop out.
    """
    measured = _means(trials)
    n_queries = trials.agg(F.count_distinct("query")).first()[0]
    timed = measured.filter(F.col("avg_seconds").isNotNull() & (F.col("avg_seconds") != 0))
    return timed.groupBy("model").agg(
        rounded(F.avg("avg_seconds")).alias("avg_seconds"),
        rounded(F.avg("avg_indicators")).alias("avg_indicators"),
        rounded(100.0 * F.count("*") / F.lit(n_queries)).alias("success_pct"),
    )


def fastest(models: DataFrame) -> DataFrame:
    """The fastest model and by how many % it beats the second; no row with fewer than two models.

    Equal times go by model. Two rows are all that leave the top-2 step.
    """
    two = models.orderBy("avg_seconds", "model").limit(2)
    ends = two.agg(
        F.count("*").alias("n"),
        F.min_by("model", F.struct("avg_seconds", "model")).alias("model"),
        F.min("avg_seconds").alias("avg_seconds"),
        F.max("avg_seconds").alias("second_seconds"),
    )
    gain = (F.col("second_seconds") - F.col("avg_seconds")) / F.col("second_seconds") * 100
    return ends.filter("n = 2").select("model", "avg_seconds", rounded(gain).alias("gain_pct"))
