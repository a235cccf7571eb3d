"""Audits of logs, replicas and histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.ordering import running


def commit_candidate(matches: DataFrame) -> DataFrame:
    """(grp, commit_candidate): the index that a majority of peers (grp, peer, match_index) has reached."""
    at = F.floor(F.count("*") / 2).cast("int") + 1
    ordered = F.sort_array(F.collect_list("match_index"), asc=False)  # the peers of one group are few
    return matches.groupBy("grp").agg(F.element_at(ordered, at).alias("commit_candidate"))


def commit_index(matches: DataFrame, log: DataFrame, terms: DataFrame) -> DataFrame:
    """(grp, commit_index): the candidate, if its entry (grp, idx, term) is of the group's current term."""
    c = commit_candidate(matches).join(terms, "grp")
    entry = log.select("grp", F.col("idx").alias("commit_candidate"), F.col("term").alias("entry_term"))
    found = c.join(entry, ["grp", "commit_candidate"], "left")
    return found.select("grp", F.when(F.col("entry_term") == F.col("term"), F.col("commit_candidate")).alias("commit_index"))


def acknowledged(acks: DataFrame, members: int) -> DataFrame:
    """Read contexts (context, peer) that a majority has acknowledged."""
    return acks.groupBy("context").agg(F.count_distinct("peer").alias("acks")).where(F.col("acks") >= members // 2 + 1)


def check_quorum(contacts: DataFrame, leader: int, now: int, window: int, members: int) -> DataFrame:
    """(grp, active, keeps): how many members of each group, its leader included, were heard (grp, peer, at) within
    ``window`` before ``now``, and whether they are a majority."""
    heard = F.count_distinct(F.when((F.col("at") > now - window) & (F.col("peer") != leader), F.col("peer")))
    return contacts.groupBy("grp").agg((heard + 1).alias("active")).withColumn("keeps", F.col("active") >= members // 2 + 1)


def more_up_to_date(logs: DataFrame) -> DataFrame:
    """(grp, node): of (grp, node, idx, term) the node whose last entry has the highest term, then index."""
    last = logs.groupBy("grp", "node").agg(F.max(F.struct("term", "idx")).alias("last"))
    return last.groupBy("grp").agg(F.max_by("node", F.struct("last", "node")).alias("node"))


def two_leaders(leaders: DataFrame) -> DataFrame:
    """Terms (term, leader) with more than one leader."""
    return leaders.groupBy("term").agg(F.count_distinct("leader").alias("leaders")).where(F.col("leaders") > 1)


def first_divergence(log: DataFrame) -> DataFrame:
    """(grp, idx): the first index at which nodes' logs (grp, node, idx, term, payload) differ."""
    per = log.groupBy("grp", "idx").agg(F.min(F.struct("term", "payload")).alias("low"), F.max(F.struct("term", "payload")).alias("high"))
    return per.where("low <> high").groupBy("grp").agg(F.min("idx").alias("idx"))


def unmatched(log: DataFrame) -> DataFrame:
    """(grp, idx, term) where equal index and term hold different payloads."""
    per = log.groupBy("grp", "idx", "term").agg(F.min("payload").alias("low"), F.max("payload").alias("high"))
    return per.where("low <> high").select("grp", "idx", "term")


def prefix_mismatches(log: DataFrame) -> DataFrame:
    """(grp, idx, term) of entries (grp, node, idx, term, payload) that nodes share although what is before them, or
    they themselves, differ.

    A prefix is told by the sum of its entries' hashes, taken along one order of all logs in ranges; two
    logs that differ have the same sum by chance alone (2^-64).
    """
    entry = F.xxhash64("idx", "term", "payload").cast("decimal(38,0)")
    upto = running(log.withColumn("_hash", entry), "_hash", "grp", "node", "idx", how="sum", name="_upto")
    starts = upto.groupBy("grp", "node").agg(F.min_by(F.col("_upto") - F.col("_hash"), "idx").alias("_start"))
    prefix = upto.join(starts, ["grp", "node"]).withColumn("_prefix", F.col("_upto") - F.col("_start"))
    per = prefix.groupBy("grp", "idx", "term").agg(F.min("_prefix").alias("low"), F.max("_prefix").alias("high"))
    return per.where("low <> high").select("grp", "idx", "term")


def merge_suffix(own: DataFrame, sent: DataFrame) -> DataFrame:
    """A follower's log (idx, term, payload) after an append: cut at the first entry whose term differs, then extended."""
    both = own.select("idx", F.col("term").alias("t")).join(sent.select("idx", F.col("term").alias("u")), "idx")
    cut = both.where("t <> u").agg(F.min("idx").alias("cut"))
    kept = own.join(F.broadcast(cut), F.lit(True)).where("cut is null or idx < cut").drop("cut")
    return kept.unionByName(sent.join(kept.select("idx"), "idx", "left_anti"))


def term_runs(log: DataFrame) -> DataFrame:
    """(grp, term, first_idx, last_idx): terms never return, so a run is a group."""
    return log.groupBy("grp", "term").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def rewritten(observations: DataFrame) -> DataFrame:
    """Leaders' entries (term, leader, at, idx, payload) that change between observations."""
    before = F.lag("payload").over(Window.partitionBy("term", "leader", "idx").orderBy("at"))
    return observations.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("payload"))).select("term", "leader", "idx")


def incomplete_leaders(committed: DataFrame, leader_log: DataFrame, leaders: DataFrame) -> DataFrame:
    """(term_led, due, held) of leaders whose log (term_led, idx, term) lacks entries (idx, term) that were committed
    in an earlier term: how many of those there are, and how many it has.

    Counts by term are enough to tell, so no leader meets every entry. ``missing_of`` names the entries of a few.
    """
    distinct = committed.select("idx", "term").distinct()
    both = distinct.groupBy("term").agg(F.count("*").alias("n")).select("term", F.lit(0).alias("leads"), "n").unionByName(
        leaders.select(F.col("term_led").alias("term"), F.lit(-1).alias("leads"), F.lit(0).cast("long").alias("n")).distinct()
    )
    # A leader sorts before the entries of its own term, which are not due.
    due = running(both, "n", "term", "leads", how="sum", name="due").where("leads = -1").select(F.col("term").alias("term_led"), "due")
    known = leader_log.select("term_led", "idx", "term").distinct().where("term < term_led").join(distinct, ["idx", "term"], "left_semi")
    held = known.groupBy("term_led").agg(F.count("*").alias("held"))
    return due.join(held, "term_led", "left").fillna(0, ["held"]).where("held < due")


def missing_of(term_led: int, committed: DataFrame, leader_log: DataFrame) -> DataFrame:
    """The entries (idx, term) that the leader of one term lacks."""
    due = committed.select("idx", "term").distinct().where(F.col("term") < term_led)
    return due.join(leader_log.where(F.col("term_led") == term_led), ["idx", "term"], "left_anti")


def applied_twice(applied: DataFrame) -> DataFrame:
    """Indexes (idx, payload) at which machines applied different commands."""
    per = applied.groupBy("idx").agg(F.min("payload").alias("low"), F.max("payload").alias("high"))
    return per.where("low <> high").select("idx")


def stale_reads(reads: DataFrame, commits: DataFrame) -> DataFrame:
    """Reads (read_id, at, read_index) below what was committed (at, commit_index) when they were issued."""
    one = lambda df, kind: df.select("at", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast("long").alias(c) for c in ("read_id", "read_index", "commit_index")))
    both = running(one(commits, 0).unionByName(one(reads, 1)), "commit_index", "at", "kind", name="known")
    return both.where("kind = 1 and read_index < known").select("read_id", "read_index", "known")


def conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (before, after, conserved): the sum of the values, exactly."""
    total = lambda df, name: df.agg(F.coalesce(F.sum(F.col("value").cast("decimal(20,2)")), F.lit(0)).alias(name))
    both = total(before, "before").join(total(after, "after"), F.lit(True))
    return both.withColumn("conserved", F.col("before") == F.col("after"))


def _after(ops: list[dict], starts: set, left: list[int]) -> set:
    """The values that a register may have after ``ops``, sorted by invoke, if it had one of ``starts`` before; none if
    no order is allowed. An operation that did not complete may be left out. ``left`` is the budget of steps."""
    must = sum(1 << i for i, o in enumerate(ops) if o["completed"])
    end = [o["ret"] if o["completed"] else float("inf") for o in ops]
    seen: set[tuple[int, object]] = set()
    stack: list[tuple[int, object]] = [(0, v) for v in starts]
    ends = set()
    while stack:
        placed, value = stack.pop()
        if (placed, value) in seen:
            continue
        seen.add((placed, value))
        left[0] -= 1
        if left[0] < 0:
            return ends
        if placed & must == must:
            ends.add(value)
            if must + 1 < 1 << len(ops):
                return ends  # something never completed, so this is the end of the history
            continue
        open_ = [i for i in range(len(ops)) if not placed >> i & 1]
        first_end = min(end[i] for i in open_)
        for i in open_:
            o = ops[i]
            if o["invoke"] >= first_end:
                break
            if o["kind"] == "get":
                if o["completed"] and o["observed"] != value:
                    continue
                after = value
            elif o["kind"] == "put":
                after = o["value"]
            else:
                hit = value == o["expected"]
                if o["completed"] and (o["applied"] != hit or (not hit and o["observed"] != value)):
                    continue
                after = o["value"] if hit else value
            stack.append((placed | 1 << i, after))
    return ends


class _Register:
    """One key's history, judged piece by piece: it is cut at each moment at which no operation is open."""

    def __init__(self, budget: int) -> None:
        self.values, self.open, self.end, self.left, self.ops = {None}, [], float("-inf"), [budget], 0

    def add(self, op: dict) -> None:
        """The next operation by invoke and ret."""
        if op["invoke"] >= self.end and self.open:
            self._judge()
        self.open.append(op)
        self.ops += 1
        self.end = max(self.end, op["ret"] if op["completed"] else float("inf"))

    def _judge(self) -> None:
        if self.values and self.left[0] >= 0:
            self.values = _after(self.open, self.values, self.left)
        self.open = []

    def verdict(self) -> bool | None:
        self._judge()
        return None if self.left[0] < 0 else bool(self.values)


def linearizable(ops: list[dict], budget: int = 5_000_000) -> bool | None:
    """Whether one key's operations have an order that a single register allows; None beyond the budget.

    Each has kind (put, get, cas), value, expected, completed, observed, applied, invoke and ret. An
    operation that did not complete may have happened, at any time from its start, or not at all. One that
    starts when another ends comes after it.
    """
    register = _Register(budget)
    for op in sorted(ops, key=lambda o: (o["invoke"], o["ret"])):
        register.add(op)
    return register.verdict()


def check_history(history: DataFrame, budget: int = 5_000_000) -> DataFrame:
    """(key, ops, linearizable) of a history; keys are independent.

    A task reads its keys' operations in order and holds those that are open at a moment, not a key's whole history.
    """
    columns = ("key", "kind", "value", "expected", "completed", "observed", "applied", "invoke", "ret")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, register, done = None, None, []
        for batch in batches:
            for op in batch.to_pylist():
                if register is None or op["key"] != key:
                    if register is not None:
                        done.append((key, register.ops, register.verdict()))
                    key, register = op["key"], _Register(budget)
                register.add(op)
            yield _verdicts(done)
            done = []
        if register is not None:
            yield _verdicts([(key, register.ops, register.verdict())])

    ordered = history.select(*columns).repartition("key").sortWithinPartitions("key", "invoke", "ret")
    return ordered.mapInArrow(check, "key string, ops long, linearizable boolean")


def _verdicts(rows: list[tuple]) -> pa.RecordBatch:
    types = {"key": pa.string(), "ops": pa.int64(), "linearizable": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))


def describe(history: DataFrame) -> DataFrame:
    """(key, text): the operations of a key in order of their start, for a failure report."""
    line = F.format_string("t%d %s %s [%d,%d]", "thread", "kind", F.coalesce("value", F.lit("-")), "invoke", "ret")
    ordered = F.array_sort(F.collect_list(F.struct("invoke", "thread", line.alias("line"))))
    return history.groupBy("key").agg(F.array_join(ordered["line"], "\n").alias("text"))


def generated_history(spark, threads: int = 5, keys: int = 5, rounds: int = 40, seed: int = 0) -> DataFrame:
    """A workload of puts, gets and swaps (2:2:1) that a register answered one at a time, hence linearizable."""
    plan = spark.range(threads * rounds).select(
        F.col("id").alias("at"), (F.col("id") % threads).cast("int").alias("thread"),
        F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(keys)).cast("string")).alias("key"),
        F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5)).alias("dice"),
        F.concat(F.lit("t"), (F.col("id") % threads).cast("string"), F.lit("-"), F.floor(F.col("id") / threads).cast("string")).alias("fresh"),
    )

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        value, rows = None, []
        for r in frame.sort_values("at").itertuples():
            kind = "put" if r.dice < 2 else "get" if r.dice < 4 else "cas"
            expected = value if kind == "cas" and r.at % 2 else None
            hit = kind == "cas" and value == expected
            observed = value if kind == "get" or (kind == "cas" and not hit) else None
            rows.append((r.thread, kind, r.key, None if kind == "get" else r.fresh, expected, True, observed, hit if kind == "cas" else True, r.at * 10, r.at * 10 + 25))
            value = r.fresh if kind == "put" or hit else value
        return pd.DataFrame(rows, columns=[c.split()[0] for c in HISTORY.split(", ")])

    return plan.groupBy("key").applyInPandas(answer, HISTORY)


HISTORY = "thread int, kind string, key string, value string, expected string, completed boolean, observed string, applied boolean, invoke long, ret long"

