"""Minimax contiguous partition of documents into shards, by DataFrame operations alone.

Equal texts form an atomic group. Groups stand in the order of their SHA-256 digest (null texts
first), and shards are runs of that order. The smallest capacity with which a greedy pass over the
groups needs no more than the given shards is found by binary search; its cuts are digests, so a
document's shard follows from its own digest, without a join. A group that holds a third of all
rows is one row of the order and is aggregated before the shuffle.

The search needs sums alone. Blocks of the order, by the first digits of the digest, are summed up in one
pass; with them a capacity is certainly enough, certainly too small, or in doubt because a cut would fall
inside a block. Only blocks that may hold a cut of a capacity in doubt are summed up again, by more
digits, until no doubt is left; the largest of them come first. A pass narrows the doubt 256 times, and
brings some thousand sums.

A null text has size 1 and CRC 0; it is not equal to an empty text. Rows that repeat an id are
documents of their own. Without rows, the result is empty. Shards may stay empty. Other columns stay, but
for those that have a name of the result's, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm._store import materialize

#: Digits of the digest by which blocks are first summed up, and further digits of each later pass.
_DIGITS, _MORE = 3, 2
#: Blocks that one pass sums up again; the next pass takes what is still in doubt.
_AT_ONCE = 64
#: Buckets of a shard for numbering its rows.
_BUCKETS = 2048


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _digest(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))


class _Order:
    """What is known of the order: consecutive blocks with their sums, some of them single groups."""

    def __init__(self, rows: list) -> None:
        # block, size, first and last digest; by block, which is the order of digests
        self.rows = sorted(rows, key=lambda r: r["block"])
        self.upto = list(accumulate(r["size"] for r in self.rows))
        self.total = self.upto[-1] if rows else 0

    def whole(self, k: int) -> bool:
        return self.rows[k]["first"] == self.rows[k]["last"]

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Where a greedy pass ends its shards; a cut inside a block of several groups is moved to the block's
        start, or, hopefully, stays."""
        at, out = 0, []
        for _ in range(shards):
            end = min(at + capacity, self.total)
            k = bisect_right(self.upto, end)  # the block that would be cut
            if k < len(self.rows) and (self.whole(k) or not hopeful):
                end = self.upto[k - 1] if k else 0
            at = max(at, end)
            out.append(at)
        return out

    def enough(self, capacity: int, shards: int, hopeful: bool) -> bool:
        return self.cuts(capacity, shards, hopeful)[-1] == self.total

    def smallest(self, low: int, shards: int, hopeful: bool) -> int:
        high = self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.enough(mid, shards, hopeful) else (mid + 1, high)
        return low

    def in_doubt(self, low: int, high: int, shards: int) -> list[int]:
        """Blocks of several groups in which a capacity from ``low`` to ``high`` may place a cut."""
        out = set()
        for a, b in zip(self.cuts(low, shards, False), self.cuts(high, shards, True), strict=True):
            # From the block that begins at the least cut to the one that holds the greatest.
            first, last = bisect_right(self.upto, a), bisect_left(self.upto, b)
            out |= {k for k in range(first, min(last, len(self.rows) - 1) + 1) if not self.whole(k)}
        return sorted(out, key=lambda k: -self.rows[k]["size"])


def minimax_cuts(rows: DataFrame, shards: int, digits: int = _DIGITS, more: int = _MORE) -> tuple[int, list[str]]:
    """The smallest feasible capacity, and the last digest of each shard but the final one.

    ``rows`` has digest and size; rows of one digest form a group. The driver holds sums of blocks: 4096
    at first, and 256 in the place of each block that is summed up again.
    """

    def summed(part: DataFrame, block: Column) -> list:
        return part.groupBy(block.alias("block")).agg(F.sum("size").alias("size"), F.min("digest").alias("first"), F.max("digest").alias("last")).collect()

    order = _Order(summed(rows, F.substring("digest", 1, digits)))
    if not order.total:
        return 0, []
    low = -(-order.total // shards)
    while True:
        low = order.smallest(low, shards, hopeful=True)
        high = order.smallest(low, shards, hopeful=False)
        doubt = order.in_doubt(low, high, shards)[:_AT_ONCE]
        if not doubt:
            break
        by_length: dict[int, list[Column]] = {}
        for k in doubt:
            r = order.rows[k]
            by_length.setdefault(len(r["block"]), []).append(F.col("digest").between(r["first"], r["last"]))
        inside = {n: reduce(or_, them) for n, them in by_length.items()}
        block = F.coalesce(*(F.when(x, F.substring("digest", 1, n + more)) for n, x in inside.items()))
        finer = summed(rows.where(reduce(or_, inside.values())), block)
        order = _Order([r for k, r in enumerate(order.rows) if k not in set(doubt)] + finer)
    ends = [x for x in order.cuts(low, shards, False) if 0 < x < order.total]
    return low, [order.rows[bisect_left(order.upto, x)]["last"] for x in dict.fromkeys(ends)]


def shard_of(digest: Column, cuts: list[str]) -> Column:
    """The shard of a digest: how many cuts are below it."""
    return sum((F.when(digest > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def assign(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the documents; the law is ``bytes``.

    ``docs`` has doc_id and a text column. Slots run from 0 without gaps in each shard, in the order
    of a bucket of the id and the text, then of doc_id and digest.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.drop(*(c for c in added if c in docs.columns))
    # Columns of any name go by their places, so that none is in the way and those not asked for are not shuffled.
    place_of = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    content, doc_id = F.col(place_of[text]), place_of["doc_id"]
    own = docs.toDF(*place_of.values()).withColumns({"size": _size(content), "digest": _digest(content)})
    narrow = materialize(own.select(doc_id, "size", "digest"), "sized")
    _, cuts = minimax_cuts(narrow, shards)
    bucket = F.pmod(F.xxhash64(doc_id, "digest"), F.lit(_BUCKETS)).cast("int")
    place = {"shard": shard_of(F.col("digest"), cuts), "bucket": bucket}
    # At most shards * _BUCKETS rows.
    counts = narrow.withColumns(place).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    along = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy(doc_id, "digest")
    crc32 = F.coalesce(F.crc32(F.encode(content, "UTF-8")), F.lit(0)).cast("long")
    return (
        own.withColumns(place).withColumn("text_crc32", crc32)
        .withColumn("own", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select(
            *(F.col(at).alias(name) for name, at in place_of.items()), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("own") + F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
