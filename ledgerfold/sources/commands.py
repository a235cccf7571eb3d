"""Command logs and related inputs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.keys import padded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_from_events(events: DataFrame) -> DataFrame:
    """(seq, key, op, value): errors delete, sign-ups create if absent, the rest put."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("put")
    return events.select(
        (F.col("event_id") + 1).alias("seq"), padded("u", F.col("user_id"), 6).alias("key"), op.alias("op"),
        F.col("event_id").cast("string").alias("value"),
    )


def conditional_from_events(events: DataFrame) -> DataFrame:
    """(seq, key, op, expected, value): every third command swaps if its expectation holds, the rest put."""
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    swap = F.col("event_id") % 3 == 0
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(swap, "cas").otherwise("put").alias("op"),
        before.alias("expected"), F.col("event_type").alias("value"),
    )


def sessions_from_events(events: DataFrame) -> DataFrame:
    """(idx, client, seq, cmd) with identical retries, reused numbers and late replays added."""
    base = events.select(F.col("event_id").alias("n"), F.col("user_id").alias("client"), F.col("event_type").alias("cmd"))
    row = lambda shift, cmd: F.struct(
        (F.col("n") * 10 + shift).alias("idx"), "client", F.col("n").alias("seq"), cmd.alias("cmd")
    )
    again = lambda k, shift, cmd: F.when(F.col("n") % k == 0, row(shift, cmd))
    copies = F.array(
        row(0, F.col("cmd")), again(7, 1, F.col("cmd")), again(11, 2, F.lit("other")), again(13, 100003, F.col("cmd"))
    )
    return base.select(F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("r")).select("r.*")


def requests_from_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commands (idx, client, seq, digest, op, malformed), and what they touch (idx, pos, key, role, expected, value).

    Errors delete, sign-ups swap, purchases are batches of a check and a write, the rest put. Clients number their
    commands by the hundred and lag behind by what an event is worth, so numbers repeat and fall back; events of little
    worth have no client, those of great worth are malformed.
    """
    kind = F.col("event_type")
    op = F.when(kind == "error", "delete").when(kind == "signup", "cas").when(kind == "purchase", "batch").otherwise("put")
    number = F.floor((F.col("event_id") - F.floor("value")) / 100).cast("long")
    cmds = events.select(
        F.col("event_id").alias("idx"), F.when(F.col("value") >= 5, F.col("user_id").cast("string")).alias("client"), number.alias("seq"),
        kind.alias("digest"), op.alias("op"), (F.col("value") >= 200).alias("malformed"),
    )
    row = lambda pos, role, expected, value: F.struct(F.lit(pos).alias("pos"), role.alias("role"), expected.cast("string").alias("expected"), value.cast("string").alias("value"))
    none = F.lit(None)
    swap = F.when(F.col("value") >= 50, "click")
    items = F.when(kind == "purchase", F.array(row(0, F.lit("check"), F.lit("BUILDING"), none), row(1, F.lit("put"), none, kind))).otherwise(
        F.array(row(0, op, F.when(kind == "signup", swap), F.when(kind != "error", kind)))
    )
    touched = events.select(F.col("event_id").alias("idx"), padded("u", F.col("user_id"), 6).alias("key"), F.explode(items).alias("i"))
    return cmds, touched.select("idx", "i.pos", "key", "i.role", "i.expected", "i.value")


def lines(lineitem: DataFrame) -> DataFrame:
    """Order lines with a total order within an order: (txid, key, kind, part of the tie-break)."""
    kind = F.when(F.col("l_returnflag") == "A", "PUT").when(F.col("l_returnflag") == "R", "DELETE").otherwise("LOCK_ONLY")
    return lineitem.select(
        F.col("l_orderkey").alias("txid"), F.col("l_partkey").alias("key"), kind.alias("kind"),
        "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity",
    )


def decisions(orders: DataFrame) -> DataFrame:
    """(txid, decision): C committed, A aborted, null undecided."""
    status = F.when(F.col("o_orderstatus") == "F", "C").when(F.col("o_orderstatus") == "O", "A")
    return orders.select(F.col("o_orderkey").alias("txid"), status.alias("decision"))
