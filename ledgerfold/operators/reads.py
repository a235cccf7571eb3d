"""Reads that ask first: whether the whole span is owned, whether a lock holds it, and only then the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.keys import between
from ledgerfold.operators import transactions


def span_owned(owned: DataFrame, start: str | None, end: str | None) -> bool:
    """Whether the owned ranges (lo, hi) cover all of [start, end), null meaning unbounded; an empty span is covered.

    The ranges are a catalog's rows, which the driver may read.
    """
    if start is not None and end is not None and start >= end:
        return True
    at = start or ""
    ranges = sorted(((r["lo"] or "", r["hi"]) for r in owned.select("lo", "hi").collect()), key=lambda r: r[0].encode())
    for lo, hi in ranges:
        if lo.encode() > at.encode():
            break
        if hi is None:
            return True
        if hi.encode() > at.encode():
            at = hi
            if end is not None and at.encode() >= end.encode():
                return True
    return False


def guarded_scan(
    state: DataFrame, owned: DataFrame, locks: DataFrame, start: str | None = None, end: str | None = None, limit: int = 0
) -> DataFrame:
    """(code, key, value, holder): the rows of [start, end) in key order, or one row that says why there are none.

    WRONG_SHARD if a part of the span is not owned, whatever shard it is on; LOCKED with the smallest key that a lock
    other than LOCK_ONLY holds. Fences never hold back reads. ``state`` is one version, so a scan over several shards
    is one snapshot. Bounds reach the scans of both tables.
    """
    spark = state.sparkSession
    schema = f"code string, key {state.schema['key'].dataType.simpleString()}, value {state.schema['value'].dataType.simpleString()}, holder string"
    if not span_owned(owned, start, end):
        return spark.createDataFrame([("WRONG_SHARD", None, None, None)], schema)
    lock = transactions.blocking_in_span(locks, start, end).select(F.lit("LOCKED").alias("code"), "key", F.lit(None).cast(state.schema["value"].dataType).alias("value"), F.col("txid").cast("string").alias("holder"))
    rows = state.where(between("key", start, end)).select(F.lit("OK").alias("code"), "key", "value", F.lit(None).cast("string").alias("holder"))
    # The lock is one row at most; without it all rows pass.
    free = rows.join(F.broadcast(lock.select(F.lit(True).alias("_locked"))), F.lit(True), "left").where("_locked is null").drop("_locked")
    out = free.unionByName(lock).orderBy("key")
    return out.limit(limit) if limit else out


def guarded_get(keys: DataFrame, state: DataFrame, owned: DataFrame, locks: DataFrame) -> DataFrame:
    """(key, code, value) of each asked key: WRONG_SHARD, LOCKED, OK or NOT_FOUND, in that order."""
    ranges = sorted(((r["lo"], r["hi"]) for r in owned.select("lo", "hi").collect()), key=lambda r: r[0] or "")
    mine = F.lit(False)
    for lo, hi in ranges:
        mine = mine | between("key", lo, hi)
    held = locks.where(F.col("kind") != "LOCK_ONLY").select("key", F.lit(True).alias("_held")).distinct()
    found = keys.select("key").join(held, "key", "left").join(state.select("key", "value"), "key", "left")
    code = F.when(~mine, "WRONG_SHARD").when(F.col("_held"), "LOCKED").when(F.col("value").isNull(), "NOT_FOUND").otherwise("OK")
    return found.select("key", code.alias("code"), F.when(code == "OK", F.col("value")).alias("value"))
