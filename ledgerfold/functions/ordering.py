"""Global row numbers, running sums and running maxima without a global window."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OWN: dict[str, tempfile.TemporaryDirectory] = {}


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that driver and executors share.

    That is spark.checkpoint.dir or the context's checkpoint folder. Where neither is set, one machine may
    use a folder of its own, which goes when Python ends; a cluster has to name one.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.TemporaryDirectory(prefix="checkpoint-", ignore_cleanup_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN["dir"].name)
    return df.checkpoint(eager=True)


def _placed(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows in ranges of the order, each with the number of its range (_part) and its place in it (_id)."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Adds the 0-based position of each row in the order of the given columns.

    Rows are range-partitioned and sorted once; a partition's offset is the number of rows before it,
    so the only thing that one task orders is a row for each partition. Ties are numbered in any order.
    """
    placed = _placed(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
        .select("_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_id") - F.col("_first") + F.col("_start")).cast("long"))
        .drop("_part", "_id", "_first", "_start")
    )


def running(df: DataFrame, value: str, *order: str, how: str = "max", name: str = "running") -> DataFrame:
    """Adds the largest value, or the sum of values (``how`` sum), of the rows up to and with each row.

    Two levels, as in ``numbered``: what a range of rows needs from those before it is one value. Nulls
    count for nothing. Ties in the order take part in any order; equal order and value are interchangeable.
    """
    placed = _placed(df, order)
    total = {"max": F.max, "sum": F.sum}[how]
    within = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(total(value).alias("_own")).select("_part", total("_own").over(before).alias("_before"))
    own = total(value).over(within)
    both = F.greatest(own, "_before") if how == "max" else F.when(own.isNull(), F.col("_before")).otherwise(own + F.coalesce("_before", own - own))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, both).drop("_part", "_id", "_before")
