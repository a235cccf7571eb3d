"""Mixing sources to target weights by a time-varying curriculum.

Every source has a schedule: a weight that is linear between knots of training progress 0..1. The
integral of the schedule is the source's weight; weights become targets in words, no target above
``max_passes`` times the source's size (the excess is shared out again by weight). The cumulative
demand of a source is its target times the part of its schedule's integral up to a moment. Its
documents stand in a fixed shuffled order, pass after pass; a document takes the moment at which
demand reaches its first word, and belongs to a pass if that is before the end. The last document of
a source is cut where its target ends.

Prefix sums run in two levels, buckets of a source and rows of a bucket, so a source that holds a
third of all rows is spread over all tasks. One row for each source is all that one task orders.

Null or blank texts have no words; they add nothing, wherever they stand. Documents of a null source
are a source of their own. Rows that repeat an id are documents of their own; equal rows are
interchangeable. Without rows, the result is empty. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm._store import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights count in millionths, so that sums and comparisons of them are exact.
_UNIT = 1_000_000


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def cyclic_schedules(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Schedules (skey, knots) whose integrals repeat ``weights`` over the sources by code point, null last.

    The lightest weight falls from 3/2 to 1/2 of its mean over training, the heaviest rises from 1/2 to 3/2.
    """
    n, low, high = len(weights), min(weights), max(weights)
    knots = []
    for w in weights:
        tilt = 0.0 if low == high else 0.5 - (w - low) / (high - low)
        knots.append(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w * (1 + s * tilt)).alias("w")) for t, s in ((0.0, 1), (1.0, -1)))))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sizes.select("skey", F.element_at(F.array(*knots), (rank - 1) % n + 1).alias("knots"))


def _segments(knots: Column) -> Column:
    """The pieces of a schedule, each with the integral before it."""
    piece = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["t"].alias("t"),
            F.element_at(knots, i)["w"].alias("w"),
            (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]).alias("dt"),
            (F.element_at(knots, i + 1)["w"] - F.element_at(knots, i)["w"]).alias("dw"),
        ),
    )
    area = lambda s: s["dt"] * (s["w"] + s["dw"] / 2)
    none = F.expr("cast(array() as array<struct<t:double,w:double,dt:double,dw:double,upto:double>>)")
    return F.aggregate(
        piece,
        none,
        lambda acc, s: F.concat(
            acc,
            F.array(
                F.struct(
                    s["t"].alias("t"), s["w"].alias("w"), s["dt"].alias("dt"), s["dw"].alias("dw"),
                    (area(s) + F.coalesce(F.try_element_at(acc, F.lit(-1))["upto"], F.lit(0.0))).alias("upto"),
                )
            ),
        ),
    )


def _moment(segments: Column, part: Column) -> Column:
    """The moment at which the schedule's integral reaches ``part`` of its whole."""
    y = part * F.element_at(segments, -1)["upto"]
    s = F.coalesce(F.get(F.filter(segments, lambda x: x["upto"] > y), 0), F.element_at(segments, -1))
    rest = y - (s["upto"] - s["dt"] * (s["w"] + s["dw"] / 2))
    root = F.sqrt(F.greatest(s["w"] * s["w"] + 2 * (s["dw"] / s["dt"]) * rest, F.lit(0.0)))
    return s["t"] + F.coalesce(F.try_divide(2 * rest, s["w"] + root), F.lit(0.0))


def source_targets(sources: DataFrame, max_passes: int = 3) -> DataFrame:
    """Adds ``target`` (double, words) to rows (skey, source_size, segments) by water filling.

    Sources are visited by cap over weight; one is full if what the earlier ones leave would give it
    its cap. Those that are not full share the rest by weight.
    """
    whole = F.element_at("segments", -1)["upto"]
    order = Window.orderBy("ratio", "skey")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(18,0)")
    ranked = (
        sources.withColumn("weight", F.round(whole * _UNIT).cast("long"))
        .withColumn("cap", F.col("source_size") * max_passes)
        .withColumn("ratio", F.try_divide(F.col("cap").cast("double"), F.col("weight").cast("double")))
        .withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
    )
    left = F.col("total") - F.col("cap_before")
    marked = ranked.withColumn(
        "full", big(left) * big(F.col("weight")) >= big(F.col("cap")) * big(F.col("weight_from"))
    )
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    share = F.try_divide(rest.cast("double") * F.col("weight").cast("double"), open_.cast("double"))
    return marked.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).select(
        *sources.columns, "target"
    )


def curriculum(docs: DataFrame, schedules=cyclic_schedules, max_passes: int = 3, seed: int = 0, row: str | None = None) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, parts (array of moment and words).

    ``docs`` has doc_id, text and source. ``schedules`` makes rows (skey, knots) of rows (skey,
    source, source_size). ``parts`` has the training position and the words taken for each pass that takes the document.
    ``row`` names a column that numbers the rows, which the result then has too.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    number = [row] if row else []
    sized = materialize(
        docs.select(*number, "doc_id", "source", _source_key("source").alias("skey"), words(F.col("text")).alias("size"), key.alias("key")),
        "sizes",
    ).withColumn("bucket", F.substring("key", 1, 3))
    buckets = materialize(
        sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets"
    )
    sizes = buckets.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(
        sizes.join(schedules(sizes).select("skey", _segments(F.col("knots")).alias("segments")), "skey").drop("source"),
        max_passes,
    )
    along = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)).alias("start")).join(
        targets, "skey"
    )
    within = Window.partitionBy("skey", "bucket").orderBy("key", "size", *number).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["skey", "bucket"])
    start = lambda p: F.col("start") + F.col("before") + p * F.col("source_size")
    taken = F.filter(F.sequence(F.lit(0), F.lit(max_passes - 1)), lambda p: start(p) < F.col("target"))
    parts = F.transform(
        taken,
        lambda p: F.struct(
            _moment(F.col("segments"), start(p) / F.col("target")).alias("moment"),
            F.least(F.col("size"), F.ceil(F.col("target") - start(p))).alias("words"),
        ),
    )
    return placed.select(*number, "doc_id", "size", "source_size", "target", parts.alias("parts"))


def in_order(docs: DataFrame, plan: DataFrame, row: str = "doc_id") -> DataFrame:
    """The documents in training order, whole, once for every pass that takes half of them or more.

    ``plan`` comes from ``curriculum``; ``row`` names a column of both that tells rows apart and is not null.
    """
    part = plan.select(row, "size", F.explode("parts").alias("_part")).where("_part.words * 2 >= size")
    rows = docs.join(part.select(row, F.col("_part.moment").alias("_moment")), row)
    return rows.orderBy("_moment", "doc_id").select(*docs.columns)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order by ``curriculum``; rows without an id or that repeat one take parts of their own.

    The rows are written down with a number, so that every reading gives a row the same one.
    """
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return in_order(numbered, curriculum(numbered, row="_row", **options), "_row").drop("_row")
