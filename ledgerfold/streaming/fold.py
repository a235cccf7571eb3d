"""A state table that follows a stream of commands, one atomic version for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators import writes
from ledgerfold.operators.state import full_state
from ledgerfold.sources import versions


def follow(log: DataFrame, root: str, checkpoint: str):
    """Start a query that folds a stream of (seq, key, op, value) into the versioned table at ``root``.

    Commands at or below the table's high-water mark are dropped, so a redelivered batch changes
    nothing. Deletes are kept as rows of null value until ``live`` drops them: a key's last command is
    what later creates are judged by. If the stream also has client, number and cmd, repeats of a client's
    number are not applied again. State, sessions and the mark are published together, as one version.

    Each micro-batch rewrites the table, so batches should be large (availableNow, or a long trigger).
    """
    spark = log.sparkSession
    with_sessions = {"client", "number", "cmd"} <= set(log.columns)

    def apply(batch: DataFrame, _: int) -> None:
        known = versions.versions(spark, root)
        found = versions.manifest(spark, root, known[-1]) if known else {"tables": {}, "facts": {}}
        applied = found["facts"].get("applied")
        new = batch if applied is None else batch.where(F.col("seq") > applied)
        mark = new.agg(F.max("seq")).first()[0]
        if mark is None:
            return
        tables = {}
        if with_sessions:
            named = new.select(F.col("seq").alias("idx"), "client", F.col("number").alias("seq"), "cmd")
            if "sessions" in found["tables"]:
                old = versions.read(spark, root, known[-1], "sessions").select(F.lit(-1).cast("long").alias("idx"), "client", F.col("last_seq").alias("seq"), "cmd")
                named = old.unionByName(named)
            fresh = writes.session_verdicts(named).where("verdict = 'applied' and idx >= 0").select(F.col("idx").alias("seq"))
            new = new.join(fresh, "seq", "left_semi")
            tables["sessions"] = writes.sessions(named)
        new = new.select("seq", "key", "op", "value")
        if "" in found["tables"]:
            table = versions.read(spark, root, known[-1])
            new = table.select("seq", "key", F.when(F.col("value").isNull(), "delete").otherwise("put").alias("op"), "value").unionByName(new)
        state = full_state(new)
        last = new.groupBy("key").agg(F.max("seq").alias("touched"))
        tables[""] = last.join(state.select("key", "value"), "key", "left").select("key", "value", F.col("touched").alias("seq"))
        versions.publish(tables, root, known[-1] if known else None, sort_by=("key",), facts={"applied": mark})

    return (
        log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def compact(spark, log_root: str, root: str, threshold: int = 10_000) -> int:
    """Drop the part of the log at ``log_root`` that the table at ``root`` holds, once it holds ``threshold`` commands
    beyond what was dropped before; returns the mark up to which the log is dropped."""
    mark = versions.manifest(spark, root)["facts"].get("applied", 0)
    dropped = versions.manifest(spark, log_root)["facts"].get("compacted", 0)
    if mark - dropped < threshold:
        return dropped
    versions.compact_log(spark, log_root, mark)
    return mark


def live(table: DataFrame) -> DataFrame:
    """(key, value) of live keys of a table that ``follow`` keeps."""
    return table.where(F.col("value").isNotNull()).select("key", "value")


def windowed_counts(events: DataFrame, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, op, n) of a stream of (ts, op) by tumbling windows; later rows than the watermark are dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = stamped.groupBy(F.window("ts", length), "op").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "op", "n")
