"""Score expressions. Scores are doubles rounded to six places before anything is ranked by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1e6


def rounded(score: Column) -> Column:
    """Six decimals by arithmetic, which stays in generated code (``round`` goes through BigDecimal)."""
    return F.rint(score * F.lit(SCALE)) / F.lit(SCALE)


def unit(vector: Column) -> Column:
    """L2-normalised vector of floats; a zero vector is left as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    def divided(n: Column) -> Column:
        return F.when(n > 0, F.transform(vector, lambda x: (x.cast("double") / n).cast("float"))).otherwise(
            F.transform(vector, lambda x: x.cast("float"))
        )

    # As an element of an array the norm is worked out once for the vector, not again for each component.
    return F.element_at(F.transform(F.array(norm), divided), 1)


def best(df: DataFrame, k: int, key: Sequence[str], order: Sequence[Column], rank: str = "rk") -> DataFrame:
    """First ``k`` rows per key with their 1-based rank.

    The filter on ``row_number`` lets Spark cut each task to ``k`` rows per key before the shuffle.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def by_score() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]
