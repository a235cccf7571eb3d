"""Optimistic transactions in two phases, as joins of write sets, locks, state and decisions.

Locks are (key, txid, primary_key, kind, value) with kind PUT, DELETE or LOCK_ONLY; decisions are
(txid, decision) with C or A. A LOCK_ONLY lock blocks writers and is invisible to readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.keys import between


def blocking(keys: DataFrame, locks: DataFrame) -> DataFrame:
    """The keys that a reader may not read."""
    return keys.join(locks.where(F.col("kind") != "LOCK_ONLY").select("key").distinct(), "key", "left_semi")


def blocking_in_span(locks: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The lock of the smallest key in [start, end) that blocks readers, or no row."""
    return locks.where(between("key", start, end) & (F.col("kind") != "LOCK_ONLY")).orderBy("key", "txid").limit(1)


def locked_writes(touched: DataFrame, locks: DataFrame) -> DataFrame:
    """Commands refused by a lock of any kind: (command, lock) of rows (command, pos, key), the first by position."""
    hit = touched.join(locks, "key")
    return hit.groupBy("command").agg(F.min_by(F.struct("key", "txid", "primary_key", "kind"), "pos").alias("lock"))


def validate(writes: DataFrame, state: DataFrame) -> DataFrame:
    """(txid, valid, failed): rows (txid, pos, key, expected, validate) against the state; null expects absence."""
    current = writes.where("validate").join(state.select("key", F.col("value").alias("current")), "key", "left")
    ok = F.col("expected").eqNullSafe(F.col("current"))
    return current.groupBy("txid").agg(F.bool_and(ok).alias("valid"), F.min(F.when(~ok, F.col("pos"))).alias("failed"))


def prewrite(writes: DataFrame, locks: DataFrame, state: DataFrame, decisions: DataFrame) -> DataFrame:
    """(txid, code, failed) of transactions that are prewritten against the same state.

    A decided transaction is ABORTED. Otherwise its first failing key decides: LOCKED by another
    transaction, or VALIDATION_FAILED; without one it is OK.
    """
    rows = (
        writes.join(locks.select("key", F.col("txid").alias("holder")), "key", "left")
        .join(state.select("key", F.col("value").alias("current")), "key", "left")
    )
    stale = F.col("validate") & ~F.col("expected").eqNullSafe(F.col("current"))
    code = F.when(F.col("holder").isNotNull() & (F.col("holder") != F.col("txid")), "LOCKED").when(stale, "VALIDATION_FAILED")
    failing = F.struct(F.col("pos"), code.alias("code"))
    by_tx = rows.withColumn("f", F.when(code.isNotNull(), failing)).groupBy("txid").agg(F.min("f").alias("f"))
    decided = by_tx.join(decisions.where("decision is not null"), "txid", "left")
    return decided.select(
        "txid", F.when(F.col("decision").isNotNull(), "ABORTED").otherwise(F.coalesce("f.code", F.lit("OK"))).alias("code"),
        F.when(F.col("decision").isNull(), F.col("f.pos")).alias("failed"),
    )


def commit(locks: DataFrame, txids: DataFrame, decisions: DataFrame) -> DataFrame:
    """(txid, code): OK if a lock is left or the transaction is already committed, else ABORTED."""
    held = locks.groupBy("txid").agg(F.count("*").alias("held"))
    seen = txids.join(held, "txid", "left").join(decisions, "txid", "left")
    ok = (F.col("decision") == "C") | (F.col("decision").isNull() & (F.col("held") > 0))
    return seen.select("txid", F.when(F.coalesce(ok, F.lit(False)), "OK").otherwise("ABORTED").alias("code"))


def rollback(txids: DataFrame, decisions: DataFrame) -> DataFrame:
    """(txid, code): ALREADY_COMMITTED or OK."""
    seen = txids.join(decisions, "txid", "left")
    return seen.select("txid", F.when(F.col("decision") == "C", "ALREADY_COMMITTED").otherwise("OK").alias("code"))


def effects(locks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(key, op, value): what the locks of committed transactions write."""
    done = locks.join(decisions.where("decision = 'C'"), "txid", "left_semi")
    return done.where(F.col("kind") != "LOCK_ONLY").select("key", F.lower("kind").alias("op"), F.when(F.col("kind") == "PUT", F.col("value")).alias("value"))


def remaining(locks: DataFrame, decisions: DataFrame) -> DataFrame:
    """The locks of undecided transactions."""
    return locks.join(decisions.where("decision is not null"), "txid", "left_anti")


def resolve(locks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds what to do with each lock that is met: roll it forward or back by its primary's decision, or wait."""
    known = locks.join(decisions, "txid", "left")
    forward = F.when(F.col("kind") == "LOCK_ONLY", "release").otherwise(F.concat(F.lit("apply_"), F.col("kind")))
    action = F.when(F.col("decision") == "C", forward).when(F.col("decision") == "A", "rollback").otherwise("wait")
    return known.withColumn("action", action)


def merged(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Reads (txid, key, seen) and writes (txid, key, kind, value) of transactions as one row for each key."""
    both = reads.withColumn("validate", F.lit(True)).join(writes, ["txid", "key"], "full")
    return both.select(
        "txid", "key", F.coalesce("kind", F.lit("LOCK_ONLY")).alias("kind"), "value",
        F.coalesce("validate", F.lit(False)).alias("validate"), F.col("seen").alias("expected"),
    )


def commit_paths(routed: DataFrame) -> DataFrame:
    """(txid, path, primary_key): one shard takes a batch, several two phases; the smallest key is the primary."""
    shards = F.count_distinct("shard_id")
    return routed.groupBy("txid").agg(F.when(shards == 1, "batch").otherwise("2pc").alias("path"), F.min("key").alias("primary_key"))
