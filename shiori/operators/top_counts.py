"""The exact n rows of highest count, ties by a key, without ordering the table or gathering candidates in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise

# Intervals a histogram has; each round narrows the floor to one of them.
INTERVALS = 1_024


def count_floor(table: DataFrame, column: str, n: int) -> tuple[int, int]:
    """(floor, more): the count of the n-th row and how many rows are above it; (0, all rows) if there are no more than n.

    Every round is one aggregate to a histogram of fixed size, first by powers of two, then by equal steps within one interval.
    """
    value = F.col(column)
    power = F.floor(F.log2(value.cast("double"))).cast("int")
    powers = table.filter(value > 0).groupBy(power.alias("k")).agg(F.count("*").alias("rows")).collect()
    if sum(r["rows"] for r in powers) <= n:
        return 0, sum(r["rows"] for r in powers)

    def crossed(counts: list[tuple[int, int]], above: int) -> tuple[int, int]:
        for k, rows in sorted(counts, reverse=True):
            if above + rows >= n:
                return k, above
            above += rows
        raise AssertionError("the floor lies in a counted interval")

    # log2 of a double can be off by one next to a power; neighbours are taken in.
    k, _ = crossed([(r["k"], r["rows"]) for r in powers], 0)
    low, high = 2 ** max(0, k - 1), 2 ** (k + 2)
    above = table.filter(value >= high).count()
    while high - low > 1:
        step = max(1, -(-(high - low) // INTERVALS))
        part = F.floor((value - low) / step).cast("bigint")
        found = table.filter((value >= low) & (value < high)).groupBy(part.alias("k")).agg(F.count("*").alias("rows")).collect()
        k, above = crossed([(r["k"], r["rows"]) for r in found], above)
        low, high = low + k * step, min(high, low + (k + 1) * step)
    return low, above


def top_by_count(table: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """The n rows of highest ``column``, equal ones by ascending ``key``; ``table`` is stored and its keys are unique.

    Rows above the floor are all taken. Rows on it are put into ranges of the key: whole ranges are taken in order, and
    only within the one that holds the last row are rows numbered.
    """
    floor, more = count_floor(table, column, n)
    if floor == 0:
        return table.filter(F.col(column) > 0)
    taken = table.filter(F.col(column) > floor)
    missing = n - more
    ties = table.filter(F.col(column) == floor)
    if ties.count() == missing:
        return taken.unionByName(ties)
    ranges = ties.repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    ranges = materialise(ranges, "ties")
    counts = sorted((r["_range"], r["n"]) for r in ranges.groupBy("_range").agg(F.count("*").alias("n")).collect())
    last, before = counts[0][0], 0
    for number, rows in counts:
        last = number
        if before + rows >= missing:
            break
        before += rows
    edge = ranges.filter(F.col("_range") == last)
    # One range of the ties at most: the least of its keys, as many as are missing.
    kept = edge.orderBy(key).limit(missing - before)
    return taken.unionByName(ranges.filter(F.col("_range") < last).drop("_range")).unionByName(kept.drop("_range"))
