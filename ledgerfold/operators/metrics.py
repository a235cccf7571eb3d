"""Order statistics by position, as benchmarks report them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.ordering import running


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group, the element at 0-based position min(n - 1, floor(share * n)) of its sorted values.

    Equal values are counted before the shuffle, and the counts are summed up along one order of all groups
    and values, dealt out by ranges; so a group of many values is spread over all tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    upto = running(counts, "c", group, value, how="sum", name="upto")
    sizes = upto.groupBy(group).agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("start"))
    placed = upto.withColumnRenamed(group, "_group").join(sizes, F.col("_group").eqNullSafe(F.col(group)))
    end = F.col("upto") - F.col("start")
    at = lambda share: F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")))
    pick = lambda share: F.max(F.when((at(share) >= end - F.col("c")) & (at(share) < end), F.col(value)))
    return placed.groupBy(group).agg(*(pick(s).alias(name) for name, s in shares.items()))


def repeats(runs: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, spread) of repeated measurements: the element at n/2, and (max - min) / median."""
    mid = percentiles(runs, group, value, {"median": 0.5})
    ends = runs.groupBy(group).agg((F.max(value) - F.min(value)).alias("width"))
    return mid.join(ends, group).select(group, "median", F.try_divide("width", "median").alias("spread"))
