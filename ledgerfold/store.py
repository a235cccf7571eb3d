"""A key-value table that sets of commands move from version to version.

Reads see one version. A write reads the newest version, decides all its commands against it, and
publishes the next; if another writer published first, nothing is written and ``Conflict`` is raised,
after which the caller decides again. An applied answer of "no" is a result, not an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.keys import between
from ledgerfold.operators import writes
from ledgerfold.operators.state import full_state
from ledgerfold.sources import versions
from ledgerfold.sources.versions import Conflict

__all__ = ["Conflict", "Store"]
_STATE = "key string, value string"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def version(self) -> int | None:
        known = versions.versions(self.spark, self.root)
        return known[-1] if known else None

    def state(self, version: int | None = None) -> DataFrame:
        """(key, value) of a version, the newest by default; nothing has been written: no rows."""
        at = self.version() if version is None else version
        return self.spark.createDataFrame([], _STATE) if at is None else versions.read(self.spark, self.root, at).select("key", "value")

    def get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """(key, value) for each asked key; null is absent."""
        return keys.select("key").join(self.state(version), "key", "left")

    def scan(self, start: str | None = None, end: str | None = None, limit: int = 0, version: int | None = None) -> DataFrame:
        rows = self.state(version).where(between("key", start, end)).orderBy("key")
        return rows.limit(limit) if limit else rows

    def _publish(self, state: DataFrame, expected: int | None) -> int:
        return versions.publish(state.select("key", "value"), self.root, expected, sort_by=("key",))

    def apply(self, log: DataFrame) -> int:
        """Puts, deletes and creates (seq, key, op, value) in the order of seq; returns the version."""
        at = self.version()
        before = self.state(at).select(F.lit(-(2**62)).cast("long").alias("seq"), "key", F.lit("put").alias("op"), "value")
        return self._publish(full_state(before.unionByName(log.select("seq", "key", "op", "value"))), at)

    def write(self, rows: DataFrame) -> int:
        """Put rows (key, value), null deleting; a key may come once. This is also the bulk import."""
        op = F.when(F.col("value").isNull(), "delete").otherwise("put")
        return self.apply(rows.select(F.lit(1).cast("long").alias("seq"), "key", op.alias("op"), "value"))

    def cas(self, swaps: DataFrame) -> DataFrame:
        """(key, applied, observed) of swaps (key, expected, value), one for a key; null expects absence."""
        at = self.version()
        judged = swaps.join(self.state(at).withColumnRenamed("value", "current"), "key", "left").withColumn(
            "applied", F.col("expected").eqNullSafe(F.col("current"))
        )
        done = judged.where("applied").select("key", "value")
        rest = self.state(at).join(done.select("key"), "key", "left_anti")
        self._publish(rest.unionByName(done.where("value is not null")), at)
        return swaps.join(self.state(at).withColumnRenamed("value", "current"), "key", "left").select(
            "key", F.col("expected").eqNullSafe(F.col("current")).alias("applied"),
            F.when(~F.col("expected").eqNullSafe(F.col("current")), F.col("current")).alias("observed"),
        )

    def batch(self, checks: DataFrame, ops: DataFrame) -> DataFrame:
        """(batch, code, applied, failed_check) of all-or-nothing batches with checks (batch, pos, key, expected) and
        ops (batch, pos, key, op, value). All are decided against the same state; of several applied
        batches that write a key, the last by number counts. A batch without checks applies; one of more than
        10,000 checks and writes is INVALID."""
        at = self.version()
        known = checks.select("batch").union(ops.select("batch")).distinct()
        codes = writes.batch_codes(known, checks, ops, self.state(at))
        codes = codes.withColumn("applied", F.col("code") == "OK")
        log = writes.batch_effects(ops, codes, F.col("batch").cast("long"))
        before = self.state(at).select(F.lit(-(2**62)).cast("long").alias("seq"), "key", F.lit("put").alias("op"), "value")
        self._publish(full_state(before.unionByName(log)), at)
        return codes

    def begin(self) -> Transaction:
        return Transaction(self, self.version())


@dataclass
class Transaction:
    """Reads of one version and buffered writes, committed if no read key has changed since.

    A transaction sees its own writes, deletes among them; a key that it wrote before reading it is not checked.
    """

    store: Store
    version: int | None
    _reads: list[DataFrame] = field(default_factory=list)
    _writes: list[DataFrame] = field(default_factory=list)

    def _seen(self, keys: DataFrame) -> DataFrame:
        if self.version is None:
            return keys.select("key", F.lit(None).cast("string").alias("value"))
        return self.store.get(keys, self.version)

    def _buffered(self) -> DataFrame:
        """(key, value): the last buffered write of each key, null deleting."""
        out = self.store.spark.createDataFrame([], "key string, value string, at int")
        for at, rows in enumerate(self._writes):
            out = out.unionByName(rows.select("key", "value", F.lit(at).alias("at")))
        return out.groupBy("key").agg(F.max_by(F.struct("value"), "at").alias("w")).select("key", "w.value")

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) for each asked key, null if absent; the keys count as read."""
        mine = self._buffered().select("key", "value", F.lit(True).alias("own"))
        seen = self._seen(keys).withColumnRenamed("value", "stored").join(mine, "key", "left")
        self._reads.append(seen.where("own is null").select("key", F.col("stored").alias("value")))
        return seen.select("key", F.when(F.col("own"), F.col("value")).otherwise(F.col("stored")).alias("value"))

    def put(self, rows: DataFrame) -> None:
        """Buffer rows (key, value), null deleting; a key may come once in a call, and the last call counts."""
        self._writes.append(rows.select("key", "value"))

    def delete(self, keys: DataFrame) -> None:
        self.put(keys.select("key", F.lit(None).cast("string").alias("value")))

    def commit(self, reads: DataFrame | None = None, rows: DataFrame | None = None) -> bool:
        """Publish the buffered writes, and ``rows`` if given. False, and nothing written: a key that was read has changed.

        ``reads`` (key, value) are further keys to check, as they were seen.
        """
        if rows is not None:
            self.put(rows)
        now = self.store.version()
        checked = self.store.spark.createDataFrame([], _STATE)
        for seen in [*self._reads, *([] if reads is None else [reads])]:
            checked = checked.unionByName(seen.select("key", "value"))
        current = self.store.state(now).withColumnRenamed("value", "current")
        changed = checked.join(current, "key", "left").where(~F.col("value").eqNullSafe(F.col("current")))
        if not changed.isEmpty():
            return False
        if self._writes:
            new = self._buffered()
            kept = self.store.state(now).join(new.select("key"), "key", "left_anti")
            self.store._publish(kept.unionByName(new.where("value is not null")), now)
        return True
