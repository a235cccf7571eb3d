"""Conditional writes and exactly-once sessions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerfold.functions.ordering import running

#: Checks and writes that one batch may hold.
MOST_IN_BATCH = 10_000


def create_verdicts(log: DataFrame) -> DataFrame:
    """(seq, key, applied) of create commands: applied if nothing or a delete comes before on the key."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("seq"))
    return (
        log.withColumn("before", before).where(F.col("op") == "create")
        .select("seq", "key", (F.col("before").isNull() | (F.col("before") == "delete")).alias("applied"))
    )


def _typed(commands: DataFrame) -> DataFrame:
    return commands.select("seq", "key", "op", F.col("expected").cast("string").alias("expected"), F.col("value").cast("string").alias("value"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def _step(now: str | None, op: str, expected: str | None, value: str | None) -> str | None:
    """What a key holds after a command; null is absent."""
    if op == "delete":
        return None
    return value if op == "put" or now == expected else now


def compare_and_swap(commands: DataFrame) -> DataFrame:
    """(key, value) after ordered put, delete and cas commands (seq, key, op, expected, value).

    A cas applies if its expectation equals the current value; null expects absence. What comes before a key's
    last put or delete cannot matter and is dropped first; the rest is read in order, holding one value.
    """
    typed = _typed(commands)
    fixed = typed.where(F.col("op") != "cas").groupBy("key").agg(F.max("seq").alias("base"))
    last = typed.join(fixed, "key", "left").where("base is null or seq >= base").select("key", "seq", "op", "expected", "value")
    schema = pa.schema([("key", to_arrow_type(typed.schema["key"].dataType)), ("value", pa.string())])

    def finals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_keys() -> Iterator[tuple]:
            for key, rows in itertools.groupby(_rows(batches), lambda r: r[0]):
                now = None
                for _, _, op, expected, value in rows:
                    now = _step(now, op, expected, value)
                yield key, now

        yield from _batches(of_keys(), schema)

    key_type = typed.schema["key"].dataType.simpleString()
    return last.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(finals, f"key {key_type}, value string")


def cas_outcomes(commands: DataFrame) -> DataFrame:
    """(seq, key, applied, observed) of every cas command; observed is the value that refused it.

    After a put or a delete a key's value is known whatever came before, so a log falls into runs that begin
    with one. Runs are dealt out and sorted, and a task reads its runs row by row, holding one value; a key that
    holds a third of the log is spread over as many tasks as it has runs.
    """
    typed = _typed(commands)
    fixed = F.when(F.col("op") != "cas", F.struct("key", "seq"))
    runs = running(typed.withColumn("_fixed", fixed), "_fixed", "key", "seq", name="_last")
    run = F.when(F.col("_last.key").eqNullSafe(F.col("key")), F.col("_last.seq"))
    dealt = runs.select("key", run.alias("run"), "seq", "op", "expected", "value").repartition("key", "run").sortWithinPartitions("key", "run", "seq")
    arrow = [to_arrow_type(typed.schema[c].dataType) for c in ("seq", "key")]
    schema = pa.schema([("seq", arrow[0]), ("key", arrow[1]), ("applied", pa.bool_()), ("observed", pa.string())])

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_runs() -> Iterator[tuple]:
            for (key, _), rows in itertools.groupby(_rows(batches), lambda r: r[:2]):
                now = None
                for _, _, seq, op, expected, value in rows:
                    if op == "cas":
                        yield seq, key, now == expected, None if now == expected else now
                    now = _step(now, op, expected, value)

        yield from _batches(of_runs(), schema)

    seq_type, key_type = (typed.schema[c].dataType.simpleString() for c in ("seq", "key"))
    return dealt.mapInArrow(outcomes, f"seq {seq_type}, key {key_type}, applied boolean, observed string")


def batch_verdicts(checks: DataFrame, state: DataFrame) -> DataFrame:
    """(batch, applied, failed_check) of batches' checks (batch, pos, key, expected) against the state before them."""
    current = checks.join(state.select("key", F.col("value").alias("current")), "key", "left")
    return verdicts_of(current.select("batch", "pos", F.col("expected").eqNullSafe(F.col("current")).alias("ok")))


def verdicts_of(checked: DataFrame) -> DataFrame:
    """(batch, applied, failed_check) from (batch, pos, ok): all or nothing, and the first failing check."""
    return checked.groupBy("batch").agg(
        F.bool_and("ok").alias("applied"), F.min(F.when(~F.col("ok"), F.col("pos"))).alias("failed_check")
    )


def batch_codes(batches: DataFrame, checks: DataFrame, ops: DataFrame, state: DataFrame, most: int = MOST_IN_BATCH) -> DataFrame:
    """(batch, code, failed_check) of every batch: INVALID if it holds nothing or more than ``most`` checks and
    writes, MISMATCH with the first failing check, or OK; checks without writes are a valid batch."""
    sizes = checks.select("batch").unionAll(ops.select("batch")).groupBy("batch").agg(F.count("*").alias("size"))
    judged = batches.select("batch").distinct().join(sizes, "batch", "left").join(batch_verdicts(checks, state), "batch", "left")
    bad = F.coalesce("size", F.lit(0)).between(1, most)
    code = F.when(~bad, "INVALID").when(F.coalesce("applied", F.lit(True)), "OK").otherwise("MISMATCH")
    return judged.select("batch", code.alias("code"), F.when(code == "MISMATCH", F.col("failed_check")).alias("failed_check"))


def batch_effects(writes: DataFrame, verdicts: DataFrame, seq: Column) -> DataFrame:
    """Log rows of applied batches: of a key's several writes (batch, pos, key, op, value) the last counts."""
    last = writes.groupBy("batch", "key").agg(F.max_by(F.struct("op", "value"), "pos").alias("w"))
    return last.join(verdicts.where("applied").select("batch"), "batch").select(seq.alias("seq"), "key", "w.op", "w.value")


def normalised(ops: DataFrame) -> DataFrame:
    """Per batch and key: the first check's expectation and the last write, of rows (batch, pos, key, role, value)."""
    first = F.min_by("value", F.when(F.col("role") == "check", F.col("pos")))
    last = F.max_by("value", F.when(F.col("role") == "write", F.col("pos")))
    has = lambda role: F.bool_or(F.col("role") == role)
    return ops.groupBy("batch", "key").agg(
        has("check").alias("checked"), first.alias("expected"), has("write").alias("written"), last.alias("value")
    )


def session_verdicts(log: DataFrame) -> DataFrame:
    """Adds ``verdict`` to (idx, client, seq, cmd): applied, replayed, reused or stale; no client is always applied.

    A client's rows are ordered in one window; clients are many and their logs short. Rows without a
    client do not enter it.
    """
    named = log.where(F.coalesce(F.col("client").cast("string"), F.lit("")) != "")
    rest = log.where(F.coalesce(F.col("client").cast("string"), F.lit("")) == "")
    before = Window.partitionBy("client").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("seq").over(before)
    first = F.first("cmd").over(Window.partitionBy("client", "seq").orderBy("idx"))
    verdict = (
        F.when(last.isNull() | (F.col("seq") > last), "applied").when(F.col("seq") < last, "stale")
        .when(F.col("cmd").eqNullSafe(first), "replayed").otherwise("reused")
    )
    return named.withColumn("verdict", verdict).unionByName(rest.withColumn("verdict", F.lit("applied")))


def cached_results(log: DataFrame, results: DataFrame) -> DataFrame:
    """Answers of every command: a replayed one gets the answer of the first, negative answers too.

    ``log`` has session verdicts; ``results`` (idx, code) has the answers of applied commands.
    """
    firsts = log.where("verdict = 'applied'").join(results, "idx").select("client", "seq", F.col("code").alias("first_code"))
    both = log.join(firsts, ["client", "seq"], "left")
    code = F.when(F.col("verdict").isin("stale", "reused"), "INVALID").otherwise(F.col("first_code"))
    return both.select("idx", "client", "seq", code.alias("code"), (F.col("verdict") == "replayed").alias("deduplicated"))


def sessions(log: DataFrame) -> DataFrame:
    """(client, last_seq, cmd): the newest session of each client, of rows (idx, client, seq, cmd)."""
    named = log.where(F.coalesce(F.col("client").cast("string"), F.lit("")) != "")
    first = F.min_by("cmd", F.struct(-F.col("seq"), F.col("idx")))
    return named.groupBy("client").agg(F.max("seq").alias("last_seq"), first.alias("cmd"))


def session_of(log: DataFrame, client) -> DataFrame:
    """The session of one client, or no row; the client reaches the scan."""
    return sessions(log.where(F.col("client") == client))


def after_high_water(log: DataFrame, applied: int) -> DataFrame:
    """Commands not yet applied; a redelivered prefix is dropped."""
    return log.where(F.col("idx") > applied)
