"""Range-partition catalogs: routing, verdicts, splits, balancing and purging.

A catalog has (epoch, shard_id, lo, hi); the first lo and the last hi are null, ranges are
contiguous. A catalog is the description of a cluster, a row for each shard, not data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerfold.functions.keys import in_range, overlaps
from ledgerfold.functions.ordering import numbered


def create(spark, starts: list[tuple[int, str | None]], epoch: int = 1) -> DataFrame:
    """A catalog of (shard_id, lo) pairs in key order, the first lo null. Raises ValueError if it is not one."""
    ids, los = [i for i, _ in starts], [lo for _, lo in starts]
    if not starts or los[0] is not None or len(set(ids)) != len(ids):
        raise ValueError("a catalog has unique shards, and the first begins unbounded")
    if any(lo is None for lo in los[1:]) or any(a >= b for a, b in zip(los[1:], los[2:], strict=False)):
        raise ValueError("shards begin at increasing keys")
    rows = [(epoch, i, lo, hi) for i, lo, hi in zip(ids, los, [*los[1:], None], strict=True)]
    return spark.createDataFrame(rows, "epoch int, shard_id int, lo string, hi string")


def newest(catalogs: DataFrame) -> DataFrame:
    """The rows of the highest epoch; an older catalog never replaces a newer one."""
    top = catalogs.agg(F.max("epoch").alias("epoch"))
    return catalogs.join(F.broadcast(top), "epoch", "left_semi")


#: Shards up to which a key is looked up by a tree of comparisons instead of an array.
_TREE = 1024


def route(rows: DataFrame, catalog: DataFrame, key: str = "key") -> DataFrame:
    """Adds shard_id to each row by looking its key up among the shards' first keys; no row is shuffled.

    A catalog is a row for each shard, so the driver may read it. The look-up is a balanced tree of
    comparisons inside the plan; catalogs of more than ``_TREE`` shards are searched in Arrow batches.
    A null key belongs to no shard, and its row is dropped.
    """
    known = sorted(catalog.select("lo", "shard_id").collect(), key=lambda r: (r["lo"] is not None, (r["lo"] or "").encode()))
    out_type = catalog.schema["shard_id"].dataType

    def tree(part: list) -> Column:
        if len(part) == 1:
            return F.lit(part[0]["shard_id"]).cast(out_type)
        mid = len(part) // 2
        return F.when(F.col(key) < F.lit(part[mid]["lo"]), tree(part[:mid])).otherwise(tree(part[mid:]))

    some = rows.where(F.col(key).isNotNull())
    if len(known) <= _TREE:
        return some.withColumn("shard_id", tree(known)) if known else some.limit(0).withColumn("shard_id", F.lit(None).cast(out_type))
    starts = np.array([r["lo"].encode() for r in known[1:]], dtype=object)
    ids = pa.array([r["shard_id"] for r in known])

    @F.arrow_udf(out_type)
    def search(keys: pa.Array) -> pa.Array:
        at = np.searchsorted(starts, np.array([k.encode() for k in keys.to_pylist()], dtype=object), side="right")
        return ids.take(pa.array(at)).cast(to_arrow_type(out_type))

    return some.withColumn("shard_id", search(F.col(key).cast("string")))


def overlapping(catalog: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Shards that share a key with [start, end)."""
    lit = lambda x: F.lit(x).cast("string")
    return catalog.where(overlaps(F.col("lo"), F.col("hi"), lit(start), lit(end)))


def split(catalog: DataFrame, key: str, shard_id: int) -> DataFrame:
    """The next epoch, in which the range that holds ``key`` ends there and a new shard goes on.

    A key at which a shard already begins changes nothing but raises ValueError.
    """
    at = F.lit(key)
    if catalog.where(F.col("lo").eqNullSafe(at) | (F.col("shard_id") == shard_id)).head(1) or not key:
        raise ValueError("split inside a range, into a new shard")
    inside = in_range(at, F.col("lo"), F.col("hi"))
    left = catalog.withColumn("hi", F.when(inside, at).otherwise(F.col("hi")))
    right = catalog.where(inside).withColumns({"shard_id": F.lit(shard_id), "lo": at})
    return left.unionByName(right).withColumn("epoch", F.col("epoch") + 1)


def verdict(key: Column, lo: Column, hi: Column, fence_lo: Column, fence_hi: Column, fenced: Column, write: Column, owns: Column) -> Column:
    """OK, WRONG_SHARD or MOVING for a key against one owner's range; a fence holds back writes alone."""
    moving = write & fenced & in_range(key, fence_lo, fence_hi)
    return F.when(~owns | ~in_range(key, lo, hi), "WRONG_SHARD").when(moving, "MOVING").otherwise("OK")


def span_verdict(start: Column, end: Column, lo: Column, hi: Column, owns: Column) -> Column:
    """OK if the whole span [start, end) is owned, null end meaning unbounded."""
    inside = (lo.isNull() | (start.isNotNull() & (start >= lo))) & (hi.isNull() | (end.isNotNull() & (end <= hi)))
    return F.when(owns & inside, "OK").otherwise("WRONG_SHARD")


def command_verdict(by_key: DataFrame, command: str = "command") -> DataFrame:
    """The strictest verdict of all keys that a command touches."""
    rank = F.when(F.col("verdict") == "WRONG_SHARD", 2).when(F.col("verdict") == "MOVING", 1).otherwise(0)
    worst = F.max(rank)
    return by_key.groupBy(command).agg(F.when(worst == 2, "WRONG_SHARD").when(worst == 1, "MOVING").otherwise("OK").alias("verdict"))


def set_owned(current: DataFrame, lo: str | None, hi: str | None, epoch: int) -> DataFrame:
    """A one-row range state with a new range and no fence; an older epoch changes nothing, an equal one may."""
    new = {"lo": F.lit(lo).cast("string"), "hi": F.lit(hi).cast("string"), "epoch": F.lit(epoch), "fenced": F.lit(False)}
    ok = F.lit(epoch) >= F.coalesce("epoch", F.lit(0))
    return current.withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in new.items()} | {"accepted": ok})


def fence(current: DataFrame, locks: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """A one-row range state in which writes to [lo, hi) are held back, and whether that was accepted.

    Refused, without a change, if the shard owns nothing or a lock lies in the span. A shard without a range
    (owns null) becomes the owner of all.
    """
    lit = lambda x: F.lit(x).cast("string")
    held = locks.where(in_range(F.col("key"), lit(lo), lit(hi))).agg((F.count("*") == 0).alias("_free"))
    both = current.join(F.broadcast(held), F.lit(True))
    ok = F.col("_free") & F.coalesce("owns", F.lit(True))
    new = {"owns": F.lit(True), "fence_lo": lit(lo), "fence_hi": lit(hi), "fenced": F.lit(True)}
    return both.withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in new.items()} | {"accepted": ok}).drop("_free")


def purge(state: DataFrame, lo: str | None, hi: str | None, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """The state without the keys outside [lo, hi), the first ``limit`` of them if given, and one row (deleted).

    Call again while it deletes something; without a limit all go at once.
    """
    lit = lambda x: F.lit(x).cast("string")
    outside = state.where(~in_range(F.col("key"), lit(lo), lit(hi))).select("key")
    if not limit:
        return state.where(in_range(F.col("key"), lit(lo), lit(hi))), outside.agg(F.count("*").alias("deleted"))
    gone = outside.orderBy("key").limit(limit)
    return state.join(gone, "key", "left_anti"), gone.agg(F.count("*").alias("deleted"))


def purge_pages(state: DataFrame, lo: str | None, hi: str | None, size: int = 10_000) -> DataFrame:
    """(page, deleted) of the purge of all keys outside the owned range [lo, hi), in pages of key order."""
    lit = lambda x: F.lit(x).cast("string")
    outside = state.where(~in_range(F.col("key"), lit(lo), lit(hi)))
    return numbered(outside, "key").groupBy(F.floor(F.col("position") / size).alias("page")).agg(F.count("*").alias("deleted"))


def balance_plan(state: DataFrame, catalog: DataFrame, most: int = 100_000, size: int = 500) -> DataFrame:
    """(shard_id, split_key, keys_counted) for the first shard with more than ``most`` keys, or no row.

    Counting reads whole pages and stops after the one that passes ``most``; the split key is the middle
    of what was counted.
    """
    placed = route(state.select("key"), catalog)
    counts = placed.groupBy("shard_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    first = counts.join(catalog, "shard_id").orderBy(F.col("lo").asc_nulls_first()).limit(1)
    counted = F.least("n", F.lit(size * (most // size + 1)))
    chosen = first.select("shard_id", counted.cast("long").alias("keys_counted"))
    mine = numbered(placed.join(F.broadcast(chosen), "shard_id"), "key")
    return mine.where(F.col("position") == F.floor(F.col("keys_counted") / 2)).select(
        "shard_id", F.col("key").alias("split_key"), "keys_counted"
    )
