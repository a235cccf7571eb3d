"""Reads: the state that a log leaves, as of any command, by key, range and page.

A log has (seq, key, op, value); op is put, delete or create (put if absent). A delete ends the
search for older versions. The fold needs no window: the last command that is not a create settles a
key, unless it deletes, in which case the first create after it does. Both are partial
aggregates, so a key that holds a third of the log is combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.keys import between
from ledgerfold.functions.ordering import numbered


def latest(log: DataFrame) -> DataFrame:
    """(key, value, seq) of live keys, with creates taken as no-ops."""
    last = F.max_by(F.struct("op", "value", "seq"), "seq").alias("l")
    return log.where(F.col("op") != "create").groupBy("key").agg(last).where("l.op = 'put'").select("key", "l.value", "l.seq")


def full_state(log: DataFrame) -> DataFrame:
    """(key, value, seq) of live keys; seq is that of the command that wrote the value."""
    last = F.max_by(F.struct("op", "value", "seq"), "seq").alias("l")
    settled = log.where(F.col("op") != "create").groupBy("key").agg(last)
    created = (
        log.where(F.col("op") == "create").join(settled, "key", "left")
        .where("l is null or (l.op = 'delete' and seq > l.seq)")
        .groupBy("key").agg(F.min_by(F.struct("value", "seq"), "seq").alias("c"))
    )
    put = settled.where("l.op = 'put'").select("key", "l.value", "l.seq")
    return put.unionByName(created.select("key", "c.value", "c.seq"))


def lookup(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """(key, kind, value) for each asked key: kind put, delete, or null where the log has no record of it."""
    seen = log if as_of is None else log.where(F.col("seq") <= as_of)
    mine = seen.join(keys.select("key").distinct(), "key", "left_semi")
    live = full_state(mine).select("key", F.lit("put").alias("kind"), "value")
    known = mine.select("key").distinct().join(live, "key", "left").withColumn("kind", F.coalesce("kind", F.lit("delete")))
    return keys.select("key").join(known, "key", "left")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The state after command ``seq``; the bound reaches the scan."""
    return full_state(log.where(F.col("seq") <= seq))


def scan(log: DataFrame, start: str | None = None, end: str | None = None, limit: int = 0, seq: int | None = None) -> DataFrame:
    """(key, value) of live keys in [start, end), ascending; limit 0 is no limit. Bounds reach the scan of the log."""
    part = log.where(between("key", start, end))
    rows = (part if seq is None else part.where(F.col("seq") <= seq)).transform(full_state).select("key", "value").orderBy("key")
    return rows.limit(limit) if limit else rows


def scan_namespace(log: DataFrame, name: str, start: str | None = None, end: str | None = None, limit: int = 0) -> DataFrame:
    """(key, value) of live keys of a namespace, its prefix taken off; bounds are keys within it."""
    upper = name[:-1] + chr(ord(name[-1]) + 1) if end is None else name + end
    rows = scan(log, name + (start or ""), upper, limit)
    return rows.select(F.substring("key", len(name) + 1, 1 << 30).alias("key"), "value")


def page(log: DataFrame, start: str | None, end: str | None, limit: int = 1000, most: int = 10_000) -> DataFrame:
    """(key, value, more): one page, and whether the range holds further keys; limit 0 is the default of 1000."""
    limit = min(limit or 1000, most)
    probe = scan(log, start, end, limit + 1)  # at most one row more than a page
    ranked = probe.withColumn("rn", F.row_number().over(Window.orderBy("key"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return ranked.where(F.col("rn") <= limit).select("key", "value", (F.col("n") > limit).alias("more"))


def next_page(log: DataFrame, last_key: str, end: str | None, limit: int = 1000) -> DataFrame:
    """The page after a key."""
    return page(log.where(F.col("key") > last_key), None, end, limit)


def pages(state: DataFrame, size: int) -> DataFrame:
    """Adds the page of each key when the whole state is read in pages of ``size``."""
    return numbered(state, "key").withColumn("page", F.floor(F.col("position") / size)).drop("position")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left_value, right_value) where two states differ; null is absent."""
    both = left.select("key", F.col("value").alias("left_value")).join(
        right.select("key", F.col("value").alias("right_value")), "key", "full"
    )
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def advance(state: DataFrame, log: DataFrame) -> DataFrame:
    """The state after more commands: a stored state is a log of puts before them. Replaying is a no-op."""
    puts = state.select("seq", "key", F.lit("put").alias("op"), "value")
    return full_state(puts.unionByName(log.select("seq", "key", "op", "value")))
