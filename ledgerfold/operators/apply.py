"""What each command of a log is answered, by all rules in their order, as joins and windows over the log.

A command meets the rules in this order, and the first that applies decides its code:
already applied (OK, deduplicated), malformed (INVALID), session (a repeat gets the answer of the first, a
reused or an older number INVALID), ownership (WRONG_SHARD before MOVING, over all keys it touches), lock
(LOCKED), and at last the operation itself (OK, MISMATCH or, for an empty batch, INVALID).

Commands of one key are decided in their order. A batch is decided against the state before the log
that is given, as are ranges, locks and sessions; a stream gives micro-batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.ordering import durable
from ledgerfold.operators import writes

def _strictest(touched: DataFrame, owned: Column, moving: Column) -> DataFrame:
    """(idx, _owner) over all keys of a command: 2 not owned, 1 moving, 0 fine."""
    rank = F.when(~owned, 2).when(moving, 1).otherwise(0)
    return touched.groupBy("idx").agg(F.max(rank).alias("_owner"))


def decide(
    commands: DataFrame, touched: DataFrame, state: DataFrame, locks: DataFrame,
    owned: Column, moving: Column, applied: int = 0, sessions: DataFrame | None = None,
) -> DataFrame:
    """(idx, code, deduplicated, observed, failed_check) of every command.

    ``commands`` has idx, client, seq, digest, op (put, delete, cas, batch) and malformed; ``touched`` has
    idx, pos, key, role (check, put, delete, cas), expected and value; ``state`` key and value; ``locks``
    key. ``owned`` and ``moving`` are conditions on a row of ``touched`` and its command's op: whether the key
    is in the owned range, and whether a write of it is fenced off. ``sessions`` has client, last_seq, digest and code.
    """
    stored = commands.sparkSession.createDataFrame([], "client string, last_seq long, digest string, code string") if sessions is None else sessions
    named = F.coalesce(F.col("client").cast("string"), F.lit("")) != ""
    old = stored.select(F.col("client").alias("_client"), F.col("last_seq").alias("_stored_seq"), F.col("digest").alias("_stored_digest"), F.col("code").alias("_stored_code"))
    rows = commands.join(old, named & (F.col("client").cast("string") == F.col("_client").cast("string")), "left").drop("_client")

    # Rules before the state: commands that a rule has taken never reach a session.
    alive = named & (F.col("idx") > applied) & ~F.col("malformed")
    # Commands without a client have a window each.
    rows = rows.withColumn("_who", F.when(named, F.col("client").cast("string")).otherwise(F.concat(F.lit("#"), F.col("idx").cast("string"))))
    by_client = Window.partitionBy("_who").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.max(F.when(alive, F.col("seq"))).over(by_client), "_stored_seq")
    same_number = Window.partitionBy("_who", "seq").orderBy("idx")
    first_idx = F.first(F.when(alive, F.col("idx")), ignorenulls=True).over(same_number)
    first_digest = F.when(F.col("seq") == F.col("_stored_seq"), F.col("_stored_digest")).otherwise(F.first(F.when(alive, F.col("digest")), ignorenulls=True).over(same_number))
    session = (
        F.when(~alive | last.isNull() | (F.col("seq") > last), F.lit(None)).when(F.col("seq") < last, "stale")
        .when(F.col("digest").eqNullSafe(first_digest), "replayed").otherwise("reused")
    )
    rows = rows.withColumns({"_session": session, "_first": first_idx})
    pre = F.when(F.col("idx") <= applied, "REPLAYED").when(F.col("malformed"), "INVALID").when(F.col("_session").isin("stale", "reused"), "INVALID").when(F.col("_session") == "replayed", "REPLAYED")
    rows = rows.withColumn("_pre", pre)

    with_op = touched.join(rows.where("_pre is null").select("idx", "op"), "idx")
    locked = with_op.join(locks.select("key").distinct(), "key", "left_semi").groupBy("idx").agg(F.lit(True).alias("_locked"))
    judged = durable(
        rows.join(_strictest(with_op, owned, moving), "idx", "left").join(locked, "idx", "left")
        .withColumn("_pre", F.coalesce("_pre", F.when(F.col("_owner") == 2, "WRONG_SHARD").when(F.col("_owner") == 1, "MOVING").when(F.col("_locked"), "LOCKED")))
    )

    # What is left runs: single-key commands in order from the state, batches against it.
    runs = judged.where("_pre is null")
    single = touched.where(F.col("role") != "check").join(runs.where("op <> 'batch'").select("idx"), "idx")
    before = state.select(F.lit(-(2**62)).cast("long").alias("seq"), "key", F.lit("put").alias("op"), F.lit(None).cast("string").alias("expected"), F.col("value").cast("string").alias("value"))
    after = single.select(F.col("idx").cast("long").alias("seq"), "key", F.col("role").alias("op"), "expected", F.col("value").cast("string").alias("value"))
    swaps = writes.cas_outcomes(before.join(after.select("key").distinct(), "key", "left_semi").select(*after.columns).unionByName(after))
    swaps = swaps.select(F.col("seq").alias("idx"), F.col("applied").alias("_applied"), "observed")
    batches = runs.where("op = 'batch'").select(F.col("idx").alias("batch"))
    mine = touched.join(batches.withColumnRenamed("batch", "idx"), "idx").withColumnRenamed("idx", "batch")
    codes = writes.batch_codes(batches, mine.where("role = 'check'"), mine.where("role <> 'check'"), state)
    codes = codes.select(F.col("batch").alias("idx"), F.col("code").alias("_batch"), "failed_check")
    ran = judged.join(swaps, "idx", "left").join(codes, "idx", "left")
    own = F.coalesce("_pre", "_batch", F.when(F.col("_applied") == F.lit(False), "MISMATCH").otherwise("OK"))
    done = durable(ran.withColumn("_code", own))  # met twice below

    # A repeat is answered like the first of its number, refusals included.
    firsts = done.select(F.col("idx").alias("_first"), F.col("_code").alias("_first_code"), F.col("observed").alias("_first_observed"), F.col("failed_check").alias("_first_check"))
    repeat = F.col("_session") == "replayed"
    again = done.join(firsts, "_first", "left")
    of_first = lambda c, other: F.when(F.coalesce(repeat, F.lit(False)), F.col(c)).otherwise(F.col(other))
    stored_answer = F.coalesce(repeat & (F.col("seq") == F.col("_stored_seq")), F.lit(False))
    code = F.when(F.col("idx") <= applied, "OK").when(stored_answer, F.col("_stored_code")).otherwise(of_first("_first_code", "_code"))
    return again.select(
        "idx", code.alias("code"), (F.coalesce(repeat, F.lit(False)) | (F.col("idx") <= applied)).alias("deduplicated"),
        F.when(~stored_answer, of_first("_first_observed", "observed")).alias("observed"), F.when(~stored_answer, of_first("_first_check", "failed_check")).alias("failed_check"),
    )
