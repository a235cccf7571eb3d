"""Shards as versioned tables, splitting one while it lives, and splitting the largest by plan.

A shard's version holds its state, its locks and its range, so a read of one version sees them agree. A split
goes through phases; each is written down when it is done and may be done again, so a split that was cut
short anywhere is resumed by its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.keys import between
from ledgerfold.operators import reads, shards
from ledgerfold.sources import versions
from ledgerfold.sources.directory import Directory

PHASES = ("started", "fenced", "copied", "published", "released", "activated", "done")
_STATE = "key string, value string"
_LOCKS = "key string, txid long, primary_key string, kind string, value string"


class Refused(Exception):
    """The shard does not allow the step now: a lock lies in the span, or its range is of a newer epoch."""


@dataclass(frozen=True)
class Shard:
    spark: SparkSession
    root: str

    def _now(self) -> tuple[int | None, dict]:
        known = versions.versions(self.spark, self.root)
        return (known[-1], versions.manifest(self.spark, self.root, known[-1])) if known else (None, {"tables": {}, "facts": {}})

    def state(self) -> DataFrame:
        return versions.read(self.spark, self.root) if "" in self._now()[1]["tables"] else self.spark.createDataFrame([], _STATE)

    def locks(self) -> DataFrame:
        return versions.read(self.spark, self.root, table="locks") if "locks" in self._now()[1]["tables"] else self.spark.createDataFrame([], _LOCKS)

    def range(self) -> dict:
        """lo, hi, epoch, owns, fenced, fence_lo and fence_hi; a shard that was never told owns all."""
        return {"lo": None, "hi": None, "epoch": 0, "owns": True, "fenced": False, "fence_lo": None, "fence_hi": None} | self._now()[1]["facts"].get("range", {})

    def write(self, state: DataFrame | None = None, locks: DataFrame | None = None, span: dict | None = None) -> int:
        """The next version, with what is given in the place of what there was."""
        at, found = self._now()
        tables = dict(found["tables"])
        tables |= {name: t for name, t in (("", state), ("locks", locks)) if t is not None}
        facts = found["facts"] | ({"range": span} if span is not None else {})
        return versions.publish(tables, self.root, at, ("key",), facts, self.spark)

    def set_owned(self, lo: str | None, hi: str | None, epoch: int, owns: bool = True) -> None:
        """A new range without a fence. An older epoch is refused, an equal one is not."""
        if epoch < self.range()["epoch"]:
            raise Refused(f"epoch {epoch} is older than the shard's")
        self.write(span={"lo": lo, "hi": hi, "epoch": epoch, "owns": owns, "fenced": False, "fence_lo": None, "fence_hi": None})

    def fence(self, lo: str | None, hi: str | None) -> None:
        """Hold back writes to [lo, hi). Refused while a lock lies in it, or if the shard owns nothing."""
        now = self.range()
        if not now["owns"] or not self.locks().where(between("key", lo, hi)).isEmpty():
            raise Refused("a lock lies in the span, or the shard owns nothing")
        self.write(span=now | {"fenced": True, "fence_lo": lo, "fence_hi": hi})

    def purge(self) -> None:
        """Delete the keys outside the owned range."""
        now = self.range()
        self.write(state=self.state().where(between("key", now["lo"], now["hi"])) if now["owns"] else self.state().limit(0))


@dataclass(frozen=True)
class Cluster:
    """Shards under ``root``, and their directory."""

    spark: SparkSession
    root: str

    @property
    def directory(self) -> Directory:
        return Directory(self.spark, f"{self.root}/directory")

    def shard(self, shard_id: int) -> Shard:
        return Shard(self.spark, f"{self.root}/shard-{shard_id}")

    def create(self, starts: list[tuple[int, str | None]]) -> bool:
        """Publish the first catalog and tell each shard its range."""
        catalog = shards.create(self.spark, starts)
        done = self.directory.compare_and_publish(None, catalog)
        for r in catalog.collect() if done else ():
            self.shard(r["shard_id"]).set_owned(r["lo"], r["hi"], r["epoch"])
        return done

    def state(self) -> DataFrame:
        """(shard_id, key, value) of all owned keys."""
        _, catalog = self.directory.load()
        out = self.spark.createDataFrame([], f"shard_id int, {_STATE}")
        for r in catalog.collect():
            mine = self.shard(r["shard_id"]).state().where(between("key", r["lo"], r["hi"]))
            out = out.unionByName(mine.select(F.lit(r["shard_id"]).cast("int").alias("shard_id"), "key", "value"))
        return out

    def _parts(self, start: str | None, end: str | None) -> tuple[list, DataFrame]:
        """The catalog's rows that meet [start, end), and what of each range its shard says it owns."""
        _, catalog = self.directory.load()
        met = sorted(shards.overlapping(catalog, start, end).collect(), key=lambda r: (r["lo"] or "").encode())
        rows = []
        for r in met:
            told = self.shard(r["shard_id"]).range()
            if told["owns"]:
                los, his = ([x for x in (r[c], told[c]) if x is not None] for c in ("lo", "hi"))
                rows.append((r["shard_id"], max(los, default=None), min(his, default=None)))
        return met, self.spark.createDataFrame(rows, "shard_id int, lo string, hi string")

    def scan(self, start: str | None = None, end: str | None = None, limit: int = 0) -> DataFrame:
        """``reads.guarded_scan`` over all shards that [start, end) meets, by what each of them says it owns."""
        met, owned = self._parts(start, end)
        state, locks = self.spark.createDataFrame([], _STATE), self.spark.createDataFrame([], _LOCKS)
        for r in met:
            part = self.shard(r["shard_id"])
            # A shard may still hold keys that it does not own any more.
            state = state.unionByName(part.state().select("key", "value").where(between("key", r["lo"], r["hi"])))
            locks = locks.unionByName(part.locks().where(between("key", r["lo"], r["hi"])))
        return reads.guarded_scan(state, owned, locks, start, end, limit)

    def put(self, rows: DataFrame) -> DataFrame:
        """(key, code) of writes (key, value), null deleting, a key once: OK, WRONG_SHARD, MOVING or LOCKED.

        Each shard publishes what it accepts as one version; Conflict if another writer came first there.
        """
        _, catalog = self.directory.load()
        routed = shards.route(rows.select("key", "value"), catalog)
        codes = self.spark.createDataFrame([], "key string, code string")
        for r in sorted(routed.select("shard_id").distinct().collect()):
            part = self.shard(r["shard_id"])
            now, at = part.range(), {c: F.lit(v) for c, v in part.range().items()}
            verdict = shards.verdict(F.col("key"), at["lo"], at["hi"], at["fence_lo"], at["fence_hi"], at["fenced"], F.lit(True), F.lit(now["owns"]))
            held = part.locks().select("key", F.lit(True).alias("_held")).distinct()
            judged = routed.where(F.col("shard_id") == r["shard_id"]).join(held, "key", "left")
            code = F.when(verdict != "OK", verdict).when(F.col("_held"), "LOCKED").otherwise("OK")
            judged = judged.select("key", "value", code.alias("code"))
            before = part.state().select("key", "value")
            done = judged.where("code = 'OK'").select("key", "value")
            part.write(state=before.join(done.select("key"), "key", "left_anti").unionByName(done.where("value is not null")))
            codes = codes.unionByName(judged.select("key", "code"))
        return codes

    def split(self, name: str, split_key: str, target: int, stop_after: str | None = None) -> str:
        """Start a split, or go on with that of the same name; returns its phase."""
        if self.directory.record(f"split/{name}") is None:
            _, catalog = self.directory.load()
            shards.split(catalog, split_key, target)  # refuses a key at which a shard begins, and a used number
            source = next(r for r in catalog.collect() if (r["lo"] or "") <= split_key and (r["hi"] is None or split_key < r["hi"]))
            record = {"phase": "started", "split_key": split_key, "target": target, "source": source["shard_id"], "lo": source["lo"], "hi": source["hi"], "epoch": source["epoch"] + 1}
            self.directory.put_record(f"split/{name}", record)
        return self.resume(name, stop_after)

    def resume(self, name: str, stop_after: str | None = None) -> str:
        """Do the phases that are left; KeyError if there is no such split."""
        record = self.directory.record(f"split/{name}")
        if record is None:
            raise KeyError(name)
        source, target, key = self.shard(record["source"]), self.shard(record["target"]), record["split_key"]
        steps = {
            "fenced": lambda: (target.set_owned(None, None, record["epoch"], owns=False), source.fence(key, record["hi"])),
            "copied": lambda: target.write(state=source.state().where(between("key", key, record["hi"]))),
            "published": lambda: self._publish(record),
            "released": lambda: source.set_owned(record["lo"], key, record["epoch"]),
            "activated": lambda: target.set_owned(key, record["hi"], record["epoch"]),
            "done": source.purge,
        }
        for phase in PHASES[PHASES.index(record["phase"]) + 1 :]:
            if record["phase"] == stop_after:
                break
            steps[phase]()
            record = record | {"phase": phase}
            self.directory.put_record(f"split/{name}", record)
        return record["phase"]

    def _publish(self, record: dict) -> None:
        while True:
            token, catalog = self.directory.load()
            if not catalog.where(F.col("shard_id") == record["target"]).isEmpty():
                return  # an earlier try got this far
            if self.directory.compare_and_publish(token, shards.split(catalog, record["split_key"], record["target"])):
                return

    def balance(self, most: int = 100_000, size: int = 500) -> bool:
        """Split the first shard of more than ``most`` keys at the middle of what was counted; whether there was one."""
        _, catalog = self.directory.load()
        plan = shards.balance_plan(self.state().select("key"), catalog, most, size).first()
        if plan is None:
            return False
        ends = catalog.agg(F.max("shard_id").alias("id"), F.max("epoch").alias("epoch")).first()
        self.split(f"auto-{ends['epoch']}-{plan['shard_id']}", plan["split_key"], ends["id"] + 1)
        return True
