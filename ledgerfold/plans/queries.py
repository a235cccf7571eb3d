"""Queries over the command log, the transactions and the audits, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.operators import apply, audits, metrics, reads, shards, state, transactions, writes
from ledgerfold.sources import commands
from ledgerfold.sources.commands import table

Query = Callable[[SparkSession, str], DataFrame]
STARTS: list[tuple[int, str | None]] = [(1, None), (2, "u000030"), (3, "u000070")]
SPLITS: list[tuple[int, str | None]] = [(1, None), (2, "000000000700"), (3, "000000001400")]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.log_from_events(table(spark, sf_dir, "events"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.lines(table(spark, sf_dir, "lineitem"))


def _locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lock for each transaction and part; of a part's several lines the smallest kind counts."""
    lines = _lines(spark, sf_dir)
    primary = lines.groupBy("txid").agg(F.min("key").alias("primary_key"))
    return lines.groupBy("txid", "key").agg(F.min("kind").alias("kind"), F.min("l_quantity").cast("string").alias("value")).join(primary, "txid")


def _positioned(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("txid").orderBy("l_linenumber", "key", "l_suppkey", "l_shipdate")
    return lines.withColumn("pos", F.row_number().over(order) - 1)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed state: the size of each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("value"))


def full_state(spark, sf_dir):
    return state.full_state(_log(spark, sf_dir))


def latest(spark, sf_dir):
    return state.latest(_log(spark, sf_dir))


def asof(spark, sf_dir):
    return state.as_of(_log(spark, sf_dir), 5000)


def lookup(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(commands.padded("u", F.col("c_custkey"), 6).alias("key"))
    return state.lookup(_log(spark, sf_dir), users, as_of=600)


def scan_page(spark, sf_dir):
    return state.page(_log(spark, sf_dir), "u000003", "u000090", 10)


def scan_all(spark, sf_dir):
    """All orders as a log of puts, read back in the order of their keys."""
    orders = table(spark, sf_dir, "orders")
    log = orders.select(F.col("o_orderkey").alias("seq"), commands.padded("o", F.col("o_orderkey"), 12).alias("key"), F.lit("put").alias("op"), F.col("o_orderpriority").alias("value"))
    return state.scan(log)


def next_page(spark, sf_dir):
    return state.next_page(_log(spark, sf_dir), "u000005", None, 5)


def state_pages(spark, sf_dir):
    return state.pages(state.full_state(_log(spark, sf_dir)).select("key"), 7)


def snapshot_diff(spark, sf_dir):
    log = _log(spark, sf_dir)
    return state.diff(state.as_of(log, 500), state.full_state(log))


def advanced_state(spark, sf_dir):
    log = _log(spark, sf_dir)
    return state.advance(state.as_of(log, 400), log).select("key", "value")


def cas_create(spark, sf_dir):
    return writes.create_verdicts(_log(spark, sf_dir))


def cas_fold(spark, sf_dir):
    return writes.compare_and_swap(commands.conditional_from_events(table(spark, sf_dir, "events")))


def cas_outcomes(spark, sf_dir):
    return writes.cas_outcomes(commands.conditional_from_events(table(spark, sf_dir, "events")))


def session(spark, sf_dir):
    judged = writes.session_verdicts(commands.sessions_from_events(table(spark, sf_dir, "events")))
    return judged.select("idx", "client", "seq", "cmd", "verdict")


def session_answers(spark, sf_dir):
    judged = writes.session_verdicts(commands.sessions_from_events(table(spark, sf_dir, "events")))
    results = judged.where("verdict = 'applied'").select("idx", F.when(F.col("cmd") == "error", "MISMATCH").otherwise("OK").alias("code"))
    return writes.cached_results(judged, results)


def batch(spark, sf_dir):
    lines = _positioned(_lines(spark, sf_dir)).select(F.col("txid").alias("batch"), "pos", "key")
    ok = lines.join(_parts(spark, sf_dir), "key", "left").select("batch", "pos", (F.coalesce("value", F.lit(99)) <= 40).alias("ok"))
    return writes.verdicts_of(ok).fillna(-1, ["failed_check"])


def batch_checks(spark, sf_dir):
    lines = _positioned(_lines(spark, sf_dir))
    checks = lines.select(F.col("txid").alias("batch"), "pos", "key", F.col("l_quantity").cast("int").alias("expected"))
    return writes.batch_verdicts(checks, _parts(spark, sf_dir)).fillna(-1, ["failed_check"])


def batch_normalised(spark, sf_dir):
    role = F.when(F.col("kind") == "LOCK_ONLY", "check").otherwise("write")
    ops = _positioned(_lines(spark, sf_dir)).select(F.col("txid").alias("batch"), "pos", "key", role.alias("role"), F.col("l_quantity").alias("value"))
    return writes.normalised(ops)


def route(spark, sf_dir):
    placed = shards.route(state.full_state(_log(spark, sf_dir)).select("key", "value"), shards.create(spark, STARTS))
    return placed.select("key", "value", "shard_id")


def overlap(spark, sf_dir):
    return shards.overlapping(shards.create(spark, STARTS), "u000020", "u000031").select("shard_id")


def split_route(spark, sf_dir):
    catalog = shards.split(shards.create(spark, STARTS), "u000005", 9)
    placed = shards.route(state.full_state(_log(spark, sf_dir)).select("key"), catalog)
    return placed.groupBy("shard_id").agg(F.count("*").alias("n"))


def verdict(spark, sf_dir):
    lit = lambda x: F.lit(x).cast("string")
    one = shards.verdict(
        F.col("key"), lit("u000002"), lit("u000100"), lit("u000008"), lit(None), F.lit(True), F.col("op") != "delete", F.lit(True)
    )
    return _log(spark, sf_dir).select("seq", one.alias("verdict"))


def command_verdict(spark, sf_dir):
    lit = lambda x: F.lit(x).cast("string")
    lines = _lines(spark, sf_dir).select(F.col("txid").alias("command"), F.lpad(F.col("key").cast("string"), 12, "0").alias("key"), "kind")
    one = shards.verdict(
        F.col("key"), lit(None), lit("000000001900"), lit("000000001500"), lit(None), F.lit(True), F.col("kind") != "LOCK_ONLY", F.lit(True)
    )
    return shards.command_verdict(lines.withColumn("verdict", one))


def purge_pages(spark, sf_dir):
    return shards.purge_pages(state.full_state(_log(spark, sf_dir)), None, "u000005", 4)


def balance_plan(spark, sf_dir):
    return shards.balance_plan(state.full_state(_log(spark, sf_dir)), shards.create(spark, STARTS), 10, 4)


def txn_paths(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("txid", F.lpad(F.col("key").cast("string"), 12, "0").alias("key"))
    return transactions.commit_paths(shards.route(lines, shards.create(spark, SPLITS)))


def txn_resolve(spark, sf_dir):
    found = transactions.resolve(_locks(spark, sf_dir), commands.decisions(table(spark, sf_dir, "orders")))
    return found.select("txid", "key", "action")


def txn_effects(spark, sf_dir):
    done = transactions.effects(_locks(spark, sf_dir), commands.decisions(table(spark, sf_dir, "orders")))
    return done.groupBy("key", "op").agg(F.count("*").alias("n"))


def txn_remaining(spark, sf_dir):
    left = transactions.remaining(_locks(spark, sf_dir), commands.decisions(table(spark, sf_dir, "orders")))
    return left.select("txid", "key", "kind")


def blocking_lock(spark, sf_dir):
    return transactions.blocking_in_span(_locks(spark, sf_dir), 100, 200).select("key", "txid", "kind")


def _held(spark, sf_dir):
    """The lock of each part: that of the first undecided transaction which has one of its lines."""
    undecided = transactions.remaining(_locks(spark, sf_dir), commands.decisions(table(spark, sf_dir, "orders")))
    return undecided.groupBy("key").agg(F.min(F.struct("txid", "primary_key", "kind")).alias("l")).select("key", "l.*")


def locked_writes(spark, sf_dir):
    """Plain commands, one for each decided transaction, against the locks of the undecided ones."""
    decided = commands.decisions(table(spark, sf_dir, "orders")).where("decision is not null").select("txid")
    touched = _positioned(_lines(spark, sf_dir)).join(decided, "txid", "left_semi").select(F.col("txid").alias("command"), "pos", "key")
    hit = transactions.locked_writes(touched, _held(spark, sf_dir))
    return hit.select("command", F.col("lock.key").alias("key"), F.col("lock.txid").alias("holder"))


def _write_sets(spark, sf_dir):
    expected = F.when(F.col("key") % 7 != 0, F.col("value")).otherwise(F.col("value") + 1)
    lines = _positioned(_lines(spark, sf_dir)).join(_parts(spark, sf_dir), "key", "left")
    return lines.select("txid", "pos", "key", "kind", expected.alias("expected"), (F.col("kind") != "PUT").alias("validate"))


def validate_occ(spark, sf_dir):
    return transactions.validate(_write_sets(spark, sf_dir), _parts(spark, sf_dir)).fillna(-1, ["failed"])


def prewrite(spark, sf_dir):
    """All transactions prewrite against the locks of the undecided ones; those that were rolled back are known."""
    aborted = commands.decisions(table(spark, sf_dir, "orders")).where("decision = 'A'")
    held = _held(spark, sf_dir).select("key", "txid")
    return transactions.prewrite(_write_sets(spark, sf_dir), held, _parts(spark, sf_dir), aborted).fillna(-1, ["failed"])


def txn_commit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return transactions.commit(_locks(spark, sf_dir), orders.select(F.col("o_orderkey").alias("txid")), commands.decisions(orders).where("decision is not null"))


def txn_rollback(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return transactions.rollback(orders.select(F.col("o_orderkey").alias("txid")), commands.decisions(orders))


def batch_codes(spark, sf_dir):
    """A batch for each order: lines that only lock are checks, the others writes; six of both at most."""
    lines = _positioned(_lines(spark, sf_dir)).withColumnRenamed("txid", "batch")
    checks = lines.where("kind = 'LOCK_ONLY'").select("batch", "pos", "key", F.col("l_quantity").cast("int").alias("expected"))
    ops = lines.where("kind <> 'LOCK_ONLY'").select("batch", "pos", "key", F.lower("kind").alias("op"), F.col("l_quantity").alias("value"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"))
    return writes.batch_codes(orders, checks, ops, _parts(spark, sf_dir), most=6).fillna(-1, ["failed_check"])


def sessions(spark, sf_dir):
    return writes.sessions(commands.sessions_from_events(table(spark, sf_dir, "events")))


def command_codes(spark, sf_dir):
    """What every command of a log is answered, by all rules in their order."""
    cmds, touched = commands.requests_from_events(table(spark, sf_dir, "events"))
    customers = table(spark, sf_dir, "customer")
    key = commands.padded("u", F.col("c_custkey"), 6)
    known = customers.select(key.alias("key"), F.col("c_mktsegment").alias("value"))
    locks = customers.where("c_acctbal < 0").select(key.alias("key"))
    found = apply.decide(cmds, touched, known, locks, F.col("key") < "u000140", F.col("key").between("u000120", "u000129") & (F.col("op") != "delete"), applied=100)
    return found.fillna(-1, ["failed_check"])


def _customer_locks(spark, sf_dir):
    """A lock on each customer in debt; those of the automobile segment are read-only."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "LOCK_ONLY").otherwise("PUT")
    return customers.select(commands.padded("u", F.col("c_custkey"), 6).alias("key"), F.col("c_custkey").alias("txid"), kind.alias("kind"))


def guarded_scan(spark, sf_dir):
    """Three scans over all shards but the last: one that is free, one that meets a lock, one that leaves what is owned."""
    now, locks = state.full_state(_log(spark, sf_dir)), _customer_locks(spark, sf_dir)
    owned = shards.create(spark, STARTS).where("shard_id <> 3")
    first = locks.where("kind <> 'LOCK_ONLY'").agg(F.min("key")).first()[0]
    scans = {"free": (None, first), "locked": (None, "u000070"), "foreign": ("u000060", "u000080")}
    out = None
    for name, (start, end) in scans.items():
        one = reads.guarded_scan(now, owned, locks, start, end).withColumn("scan", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def guarded_get(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(commands.padded("u", F.col("c_custkey"), 6).alias("key"))
    owned = shards.create(spark, STARTS).where("shard_id <> 2")
    return reads.guarded_get(users, state.full_state(_log(spark, sf_dir)), owned, _customer_locks(spark, sf_dir))


def purge(spark, sf_dir):
    kept, _ = shards.purge(state.full_state(_log(spark, sf_dir)), "u000020", "u000090", 30)
    return kept.select("key", "value")


def span_verdict(spark, sf_dir):
    """Whether one shard owns all that lies between a transaction's smallest and largest key."""
    spans = _lines(spark, sf_dir).groupBy("txid").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    return spans.select("txid", shards.span_verdict(F.col("first"), F.col("last"), F.lit(200), F.lit(1700), F.lit(True)).alias("verdict"))


def quorum(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    matches = lines.groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("peer")).agg(F.max("l_partkey").alias("match_index"))
    return audits.commit_candidate(matches)


def election_safety(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return audits.two_leaders(lines.select(F.col("l_partkey").alias("term"), F.col("l_linenumber").alias("leader")))


def log_diverge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    log = lines.select((F.col("l_suppkey") % 50).alias("grp"), F.col("l_linenumber").alias("node"), F.col("l_orderkey").alias("idx"), (F.col("l_partkey") % 3).alias("term"), F.col("l_returnflag").alias("payload"))
    return audits.first_divergence(log)


def log_matching(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    log = lines.select((F.col("l_suppkey") % 50).alias("grp"), F.col("l_linenumber").alias("node"), (F.col("l_orderkey") % 500).alias("idx"), (F.col("l_partkey") % 40).alias("term"), F.col("l_returnflag").alias("payload"))
    return audits.unmatched(log)


def machine_safety(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return audits.applied_twice(lines.select(F.col("l_orderkey").alias("idx"), F.col("l_shipdate").cast("string").alias("payload")))


def _entries(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_suppkey") % 5).alias("grp"), F.col("l_linenumber").alias("node"), F.col("l_orderkey").alias("idx"), (F.col("l_partkey") % 3).alias("term"), F.col("l_returnflag").alias("payload"))


def prefix_mismatches(spark, sf_dir):
    """One entry a node and index, the smallest of those the lines give."""
    one = _entries(spark, sf_dir).groupBy("grp", "node", "idx").agg(F.min(F.struct("term", "payload")).alias("e"))
    return audits.prefix_mismatches(one.select("grp", "node", "idx", "e.*"))


def up_to_date(spark, sf_dir):
    return audits.more_up_to_date(_entries(spark, sf_dir))


def commit_index(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    matches = lines.groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("peer")).agg(F.max("l_partkey").alias("match_index"))
    log = lines.groupBy(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("idx")).agg(F.min(F.col("l_suppkey") % 3).alias("term"))
    return audits.commit_index(matches, log, orders.select(F.col("o_orderkey").alias("grp"), (F.col("o_custkey") % 3).alias("term"))).fillna(-1, ["commit_index"])


def check_quorum(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    heard = events.select(F.col("event_type").alias("grp"), (F.col("user_id") % 7).alias("peer"), F.col("event_id").alias("at"))
    return audits.check_quorum(heard, leader=0, now=900, window=12, members=7)


def incomplete_leaders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    entries = lines.select(F.col("l_suppkey").alias("term_led"), F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("term"))
    committed = lines.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("term"))
    return audits.incomplete_leaders(committed, entries, entries.select("term_led"))


def term_runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    log = orders.select((F.col("o_custkey") % 20).alias("grp"), F.col("o_orderpriority").alias("term"), F.col("o_orderkey").alias("idx"))
    return audits.term_runs(log)


def stale_reads(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    commits = events.where("event_type = 'purchase'").select(F.col("event_id").alias("at"), F.col("event_id").alias("commit_index"))
    reads = events.where("event_type = 'view'").select(F.col("event_id").alias("read_id"), F.col("event_id").alias("at"), (F.col("event_id") - F.col("user_id") % 9).alias("read_index"))
    return audits.stale_reads(reads, commits)


def conservation(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    before = customers.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    moved = F.when(F.col("key") == 1, -5).when(F.col("key") == 2, 5).otherwise(0)
    return audits.conserved(before, before.withColumn("value", F.col("value") + moved)).select(F.col("conserved"))


def percentiles(spark, sf_dir):
    return metrics.percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def repeats(spark, sf_dir):
    return metrics.repeats(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")


def linearizability(spark, sf_dir):
    """Every user's events as a register's history, one operation after another. Sign-ups swap; a read of a small value
    saw the write before the last one, so the histories of some users are not legal."""
    events = table(spark, sf_dir, "events")
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    writes_ = F.when(F.col("event_type") != "view", F.col("event_id").cast("string"))
    with_last = events.withColumn("last", F.last(writes_, ignorenulls=True).over(upto))
    before_last = F.last(F.when(F.col("event_type") != "view", F.col("last")), ignorenulls=True).over(upto)
    kind = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "signup", "cas").otherwise("put")
    history = with_last.withColumns({"kind": kind, "before_last": before_last}).select(
        F.lit(0).alias("thread"), "kind", F.col("user_id").cast("string").alias("key"),
        F.when(F.col("kind") != "get", F.col("event_id").cast("string")).alias("value"), F.when(F.col("kind") == "cas", F.col("last")).alias("expected"), F.lit(True).alias("completed"),
        F.when(F.col("kind") == "get", F.when(F.col("value") < 0.8, F.col("before_last")).otherwise(F.col("last"))).alias("observed"), F.lit(True).alias("applied"),
        (F.col("event_id") * 10).alias("invoke"), (F.col("event_id") * 10 + 10).alias("ret"),
    )
    return audits.check_history(history)


# SQL pieces.
_LOG = """log AS (SELECT event_id + 1 AS seq, concat('u', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS key,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'put' END AS op, CAST(event_id AS VARCHAR) AS value FROM events)"""


def _state_sql(name: str, where: str = "TRUE", log: str = "log") -> str:
    return f"""{name}_p AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS prev FROM {log} WHERE {where}),
{name}_e AS (SELECT * FROM {name}_p WHERE op <> 'create' OR prev IS NULL OR prev = 'delete'),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {name}_e),
{name} AS (SELECT key, value, seq FROM {name}_r WHERE rn = 1 AND op <> 'delete')"""


_SESSION = """a AS (SELECT event_id * 10 AS idx, user_id AS client, event_id AS seq, event_type AS cmd FROM events
  UNION ALL SELECT event_id * 10 + 1, user_id, event_id, event_type FROM events WHERE event_id % 7 = 0
  UNION ALL SELECT event_id * 10 + 2, user_id, event_id, 'other' FROM events WHERE event_id % 11 = 0
  UNION ALL SELECT event_id * 10 + 100003, user_id, event_id, event_type FROM events WHERE event_id % 13 = 0),
w AS (SELECT *, max(seq) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq,
  first_value(cmd) OVER (PARTITION BY client, seq ORDER BY idx) AS first_cmd FROM a),
j AS (SELECT idx, client, seq, cmd, CASE WHEN last_seq IS NULL OR seq > last_seq THEN 'applied' WHEN seq < last_seq THEN 'stale'
  WHEN cmd = first_cmd THEN 'replayed' ELSE 'reused' END AS verdict FROM w)"""
_LINES = """li AS (SELECT l_orderkey AS txid, l_partkey AS key, CASE l_returnflag WHEN 'A' THEN 'PUT' WHEN 'R' THEN 'DELETE' ELSE 'LOCK_ONLY' END AS kind,
  l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS pos FROM lineitem),
lk AS (SELECT txid, key, min(kind) AS kind FROM li GROUP BY txid, key),
de AS (SELECT o_orderkey AS txid, CASE o_orderstatus WHEN 'F' THEN 'C' WHEN 'O' THEN 'A' END AS decision FROM orders)"""
_SETS = """ws AS (SELECT txid, pos, key, kind, CASE WHEN key % 7 <> 0 THEN p_size ELSE p_size + 1 END AS expected, kind <> 'PUT' AS validate, p_size AS cur
  FROM li LEFT JOIN part ON p_partkey = key)"""
_CATALOG = "c(shard_id, lo, hi) AS (VALUES (1, '', 'u000030'), (2, 'u000030', 'u000070'), (3, 'u000070', NULL))"
_CAS = """cmds AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id AS seq, event_type AS value,
  event_id % 3 = 0 AS swap, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM events),
f(key, rn, now, seq, swap, applied, observed) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), FALSE, FALSE, CAST(NULL AS VARCHAR) FROM cmds
  UNION ALL SELECT c.key, c.rn, CASE WHEN NOT c.swap OR f.now IS NOT DISTINCT FROM c.expected THEN c.value ELSE f.now END, c.seq, c.swap,
    f.now IS NOT DISTINCT FROM c.expected, CASE WHEN f.now IS DISTINCT FROM c.expected THEN f.now END FROM f JOIN cmds c ON c.key = f.key AND c.rn = f.rn + 1)"""

_HELD = "h AS (SELECT key, min(txid) AS holder FROM lk JOIN de USING (txid) WHERE decision IS NULL GROUP BY key)"
_ENTRIES = "en AS (SELECT l_suppkey % 5 AS grp, l_linenumber AS node, l_orderkey AS idx, l_partkey % 3 AS term, l_returnflag AS payload FROM lineitem)"
# Commands, what sessions, owners and locks make of them, and the fold of what is left.
_REQUESTS = """cm AS (SELECT event_id AS idx, CASE WHEN value >= 5 THEN CAST(user_id AS VARCHAR) END AS client, CAST(floor((event_id - floor(value)) / 100) AS BIGINT) AS seq, event_type AS digest,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'cas' WHEN 'purchase' THEN 'batch' ELSE 'put' END AS op, value >= 200 AS malformed,
  concat('u', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS key, CASE WHEN value >= 50 THEN 'click' END AS expected FROM events),
al AS (SELECT *, client IS NOT NULL AND idx > 100 AND NOT malformed AS alive FROM cm),
se AS (SELECT *, max(CASE WHEN alive THEN seq END) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq,
  first_value(CASE WHEN alive THEN idx END IGNORE NULLS) OVER (PARTITION BY client, seq ORDER BY idx) AS first_idx, first_value(CASE WHEN alive THEN digest END IGNORE NULLS) OVER (PARTITION BY client, seq ORDER BY idx) AS first_digest FROM al),
ve AS (SELECT *, CASE WHEN NOT alive OR last_seq IS NULL OR seq > last_seq THEN NULL WHEN seq < last_seq THEN 'stale' WHEN digest = first_digest THEN 'replayed' ELSE 'reused' END AS sess FROM se),
cu AS (SELECT concat('u', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS key, c_mktsegment AS value, c_acctbal < 0 AS locked FROM customer),
pr AS (SELECT ve.*, cu.value AS stored, CASE WHEN idx <= 100 THEN 'OK' WHEN malformed OR sess IN ('stale', 'reused') THEN 'INVALID' WHEN sess = 'replayed' THEN 'REPLAYED' WHEN ve.key >= 'u000140' THEN 'WRONG_SHARD'
  WHEN ve.key >= 'u000120' AND ve.key <= 'u000129' AND op <> 'delete' THEN 'MOVING' WHEN locked THEN 'LOCKED' WHEN op = 'batch' THEN CASE WHEN cu.value IS NOT DISTINCT FROM 'BUILDING' THEN 'OK' ELSE 'MISMATCH' END END AS pre FROM ve LEFT JOIN cu ON cu.key = ve.key),
ru AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS rn FROM pr WHERE pre IS NULL),
fo(key, rn, now, idx, code, observed) AS (SELECT DISTINCT key, CAST(0 AS BIGINT), stored, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM ru
  UNION ALL SELECT r.key, r.rn, CASE r.op WHEN 'put' THEN r.digest WHEN 'delete' THEN NULL ELSE CASE WHEN f.now IS NOT DISTINCT FROM r.expected THEN r.digest ELSE f.now END END, r.idx,
    CASE WHEN r.op <> 'cas' OR f.now IS NOT DISTINCT FROM r.expected THEN 'OK' ELSE 'MISMATCH' END, CASE WHEN r.op = 'cas' AND f.now IS DISTINCT FROM r.expected THEN f.now END FROM fo f JOIN ru r ON r.key = f.key AND r.rn = f.rn + 1),
dn AS (SELECT pr.*, coalesce(pr.pre, fo.code) AS code, fo.observed, CASE WHEN pr.op = 'batch' AND pr.pre = 'MISMATCH' THEN 0 ELSE -1 END AS failed_check FROM pr LEFT JOIN fo ON fo.idx = pr.idx)
SELECT d.idx, CASE WHEN d.sess = 'replayed' AND d.idx > 100 THEN f.code ELSE d.code END AS code, coalesce(d.sess = 'replayed', FALSE) OR d.idx <= 100 AS deduplicated,
  CASE WHEN d.sess = 'replayed' THEN f.observed ELSE d.observed END AS observed, CASE WHEN d.sess = 'replayed' THEN f.failed_check ELSE d.failed_check END AS failed_check FROM dn d LEFT JOIN dn f ON f.idx = d.first_idx"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        full_state, latest, asof, lookup, scan_all, scan_page, next_page, state_pages, snapshot_diff, advanced_state, cas_create, cas_fold,
        cas_outcomes, session, session_answers, batch, batch_checks, batch_normalised, route, overlap, split_route, verdict,
        command_verdict, purge_pages, balance_plan, txn_paths, txn_resolve, txn_effects, txn_remaining, blocking_lock, locked_writes,
        validate_occ, prewrite, quorum, election_safety, log_diverge, log_matching, machine_safety, term_runs, stale_reads,
        conservation, percentiles, repeats, linearizability, txn_commit, txn_rollback, batch_codes, sessions, command_codes, guarded_scan,
        guarded_get, purge, span_verdict, prefix_mismatches, up_to_date, commit_index, check_quorum, incomplete_leaders,
    )
}

ORACLE_SQL: dict[str, str] = {
    "full_state": f"WITH {_LOG}, {_state_sql('s')} SELECT key, value, seq FROM s",
    "latest": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE op <> 'create') SELECT key, value, seq FROM r WHERE rn = 1 AND op = 'put'",
    "asof": f"WITH {_LOG}, {_state_sql('s', 'seq <= 5000')} SELECT key, value, seq FROM s",
    "lookup": f"""WITH {_LOG}, {_state_sql('s', 'seq <= 600')}, k AS (SELECT concat('u', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS key FROM customer),
n AS (SELECT DISTINCT key FROM log WHERE seq <= 600)
SELECT k.key, CASE WHEN s.key IS NOT NULL THEN 'put' WHEN n.key IS NOT NULL THEN 'delete' END AS kind, s.value FROM k LEFT JOIN n ON n.key = k.key LEFT JOIN s ON s.key = k.key""",
    "scan_page": f"""WITH {_LOG}, {_state_sql('s')}, r AS (SELECT key, value, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM s WHERE key >= 'u000003' AND key < 'u000090')
SELECT key, value, n > 10 AS more FROM r WHERE rn <= 10""",
    "scan_all": "SELECT concat('o', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1",
    "next_page": f"""WITH {_LOG}, {_state_sql('s')}, r AS (SELECT key, value, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM s WHERE key > 'u000005')
SELECT key, value, n > 5 AS more FROM r WHERE rn <= 5""",
    "state_pages": f"WITH {_LOG}, {_state_sql('s')} SELECT key, CAST(floor((row_number() OVER (ORDER BY key) - 1) / 7) AS BIGINT) AS page FROM s",
    "snapshot_diff": f"""WITH {_LOG}, {_state_sql('x', 'seq <= 500')}, {_state_sql('y')}
SELECT coalesce(x.key, y.key) AS key, x.value AS left_value, y.value AS right_value FROM x FULL JOIN y ON x.key = y.key WHERE x.value IS DISTINCT FROM y.value""",
    "advanced_state": f"""WITH {_LOG}, {_state_sql('b', 'seq <= 400')}, both_ AS (SELECT seq, key, 'put' AS op, value FROM b UNION ALL SELECT seq, key, op, value FROM log),
{_state_sql('s')} SELECT key, value FROM s""",
    "cas_create": f"WITH {_LOG}, p AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS prev FROM log) SELECT seq, key, prev IS NULL OR prev = 'delete' AS applied FROM p WHERE op = 'create'",
    "cas_fold": f"WITH RECURSIVE {_CAS} SELECT key, arg_max(now, rn) AS value FROM f GROUP BY key",
    "cas_outcomes": f"WITH RECURSIVE {_CAS} SELECT seq, key, applied, observed FROM f WHERE swap",
    "session": f"WITH {_SESSION} SELECT idx, client, seq, cmd, verdict FROM j",
    "session_answers": f"""WITH {_SESSION}, r AS (SELECT client, seq, CASE WHEN cmd = 'error' THEN 'MISMATCH' ELSE 'OK' END AS first_code FROM j WHERE verdict = 'applied')
SELECT idx, client, seq, CASE WHEN verdict IN ('stale', 'reused') THEN 'INVALID' ELSE first_code END AS code, verdict = 'replayed' AS deduplicated FROM j LEFT JOIN r USING (client, seq)""",
    "batch": f"WITH {_LINES} SELECT txid AS batch, bool_and(coalesce(p_size, 99) <= 40) AS applied, coalesce(min(CASE WHEN coalesce(p_size, 99) > 40 THEN pos END), -1) AS failed_check FROM li LEFT JOIN part ON p_partkey = key GROUP BY txid",
    "batch_checks": f"""WITH {_LINES}, k AS (SELECT txid, pos, CAST(l_quantity AS INT) IS NOT DISTINCT FROM p_size AS ok FROM li LEFT JOIN part ON p_partkey = key)
SELECT txid AS batch, bool_and(ok) AS applied, coalesce(min(CASE WHEN NOT ok THEN pos END), -1) AS failed_check FROM k GROUP BY txid""",
    "batch_normalised": f"""WITH {_LINES} SELECT txid AS batch, key, bool_or(kind = 'LOCK_ONLY') AS checked, arg_min(l_quantity, CASE WHEN kind = 'LOCK_ONLY' THEN pos END) AS expected,
bool_or(kind <> 'LOCK_ONLY') AS written, arg_max(l_quantity, CASE WHEN kind <> 'LOCK_ONLY' THEN pos END) AS value FROM li GROUP BY txid, key""",
    "route": f"WITH {_LOG}, {_state_sql('s')}, {_CATALOG} SELECT key, value, shard_id FROM s JOIN c ON key >= lo AND (hi IS NULL OR key < hi)",
    "overlap": f"WITH {_CATALOG} SELECT shard_id FROM c WHERE lo < 'u000031' AND (hi IS NULL OR hi > 'u000020')",
    "split_route": f"""WITH {_LOG}, {_state_sql('s')}, d(shard_id, lo, hi) AS (VALUES (1, '', 'u000005'), (9, 'u000005', 'u000030'), (2, 'u000030', 'u000070'), (3, 'u000070', NULL))
SELECT shard_id, count(*) AS n FROM s JOIN d ON key >= lo AND (hi IS NULL OR key < hi) GROUP BY shard_id""",
    "verdict": f"WITH {_LOG} SELECT seq, CASE WHEN key < 'u000002' OR key >= 'u000100' THEN 'WRONG_SHARD' WHEN op <> 'delete' AND key >= 'u000008' THEN 'MOVING' ELSE 'OK' END AS verdict FROM log",
    "command_verdict": f"""WITH {_LINES}, v AS (SELECT txid, CASE WHEN key >= 1900 THEN 2 WHEN kind <> 'LOCK_ONLY' AND key >= 1500 THEN 1 ELSE 0 END AS r FROM li)
SELECT txid AS command, CASE max(r) WHEN 2 THEN 'WRONG_SHARD' WHEN 1 THEN 'MOVING' ELSE 'OK' END AS verdict FROM v GROUP BY txid""",
    "purge_pages": f"""WITH {_LOG}, {_state_sql('s')}, r AS (SELECT row_number() OVER (ORDER BY key) - 1 AS i FROM s WHERE key >= 'u000005')
SELECT CAST(floor(i / 4) AS BIGINT) AS page, count(*) AS deleted FROM r GROUP BY 1""",
    "balance_plan": f"""WITH {_LOG}, {_state_sql('s')}, {_CATALOG},
o AS (SELECT shard_id, lo, key, row_number() OVER (PARTITION BY shard_id ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY shard_id) AS n FROM s JOIN c ON key >= lo AND (hi IS NULL OR key < hi)),
q AS (SELECT *, least(n, 12) AS counted, dense_rank() OVER (ORDER BY lo) AS d FROM o WHERE n > 10)
SELECT shard_id, key AS split_key, counted AS keys_counted FROM q WHERE d = 1 AND i = CAST(floor(counted / 2) AS BIGINT)""",
    "txn_paths": f"""WITH {_LINES} SELECT txid, CASE WHEN count(DISTINCT CASE WHEN key < 700 THEN 1 WHEN key < 1400 THEN 2 ELSE 3 END) = 1 THEN 'batch' ELSE '2pc' END AS path,
lpad(CAST(min(key) AS VARCHAR), 12, '0') AS primary_key FROM li GROUP BY txid""",
    "txn_resolve": f"""WITH {_LINES} SELECT txid, key, CASE decision WHEN 'C' THEN CASE kind WHEN 'LOCK_ONLY' THEN 'release' ELSE concat('apply_', kind) END WHEN 'A' THEN 'rollback' ELSE 'wait' END AS action
FROM lk LEFT JOIN de USING (txid)""",
    "txn_effects": f"WITH {_LINES} SELECT key, lower(kind) AS op, count(*) AS n FROM lk JOIN de USING (txid) WHERE decision = 'C' AND kind <> 'LOCK_ONLY' GROUP BY key, lower(kind)",
    "txn_remaining": f"WITH {_LINES} SELECT txid, key, kind FROM lk WHERE txid NOT IN (SELECT txid FROM de WHERE decision IS NOT NULL)",
    "blocking_lock": f"WITH {_LINES} SELECT key, txid, kind FROM lk WHERE key >= 100 AND key < 200 AND kind <> 'LOCK_ONLY' ORDER BY key, txid LIMIT 1",
    "locked_writes": f"""WITH {_LINES}, {_HELD}
SELECT txid AS command, arg_min(key, pos) AS key, arg_min(holder, pos) AS holder FROM li JOIN h USING (key) JOIN de USING (txid) WHERE decision IS NOT NULL GROUP BY txid""",
    "validate_occ": f"""WITH {_LINES}, {_SETS} SELECT txid, bool_and(expected IS NOT DISTINCT FROM cur) AS valid, coalesce(min(CASE WHEN expected IS DISTINCT FROM cur THEN pos END), -1) AS failed FROM ws WHERE validate GROUP BY txid""",
    "prewrite": f"""WITH {_LINES}, {_SETS}, {_HELD},
x AS (SELECT txid, pos, CASE WHEN holder IS NOT NULL AND holder <> txid THEN 'LOCKED' WHEN validate AND expected IS DISTINCT FROM cur THEN 'VALIDATION_FAILED' END AS code FROM ws LEFT JOIN h USING (key)),
g AS (SELECT txid, arg_min(code, CASE WHEN code IS NOT NULL THEN pos END) AS code, min(CASE WHEN code IS NOT NULL THEN pos END) AS failed FROM x GROUP BY txid)
SELECT txid, CASE WHEN decision = 'A' THEN 'ABORTED' ELSE coalesce(code, 'OK') END AS code, coalesce(CASE WHEN decision = 'A' THEN NULL ELSE failed END, -1) AS failed FROM g LEFT JOIN de USING (txid)""",
    "txn_commit": f"""WITH {_LINES}, n AS (SELECT txid, count(*) AS held FROM lk GROUP BY txid)
SELECT txid, CASE WHEN decision = 'C' OR (decision IS NULL AND coalesce(held, 0) > 0) THEN 'OK' ELSE 'ABORTED' END AS code FROM de LEFT JOIN n USING (txid)""",
    "txn_rollback": f"WITH {_LINES} SELECT txid, CASE WHEN decision = 'C' THEN 'ALREADY_COMMITTED' ELSE 'OK' END AS code FROM de",
    "batch_codes": f"""WITH {_LINES}, k AS (SELECT txid, count(*) AS n, min(CASE WHEN kind = 'LOCK_ONLY' AND CAST(l_quantity AS INT) IS DISTINCT FROM p_size THEN pos END) AS failed FROM li LEFT JOIN part ON p_partkey = key GROUP BY txid)
SELECT o_orderkey AS batch, CASE WHEN n IS NULL OR n > 6 THEN 'INVALID' WHEN failed IS NULL THEN 'OK' ELSE 'MISMATCH' END AS code, CASE WHEN n <= 6 THEN coalesce(failed, -1) ELSE -1 END AS failed_check
FROM orders LEFT JOIN k ON txid = o_orderkey""",
    "sessions": f"WITH {_SESSION} SELECT client, max(seq) AS last_seq, arg_min(cmd, -seq * 1000000000 + idx) AS cmd FROM a GROUP BY client",
    "command_codes": f"WITH RECURSIVE {_REQUESTS}",
    "guarded_scan": f"""WITH {_LOG}, {_state_sql('s')}, lo AS (SELECT concat('u', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS key, c_custkey AS txid FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'AUTOMOBILE'),
f AS (SELECT min(key) AS key FROM lo), g AS (SELECT arg_min(txid, key) AS txid, min(key) AS key FROM lo WHERE key < 'u000070')
SELECT 'OK' AS code, s.key, s.value, CAST(NULL AS VARCHAR) AS holder, 'free' AS scan FROM s, f WHERE s.key < f.key
UNION ALL SELECT 'LOCKED', key, NULL, CAST(txid AS VARCHAR), 'locked' FROM g WHERE key IS NOT NULL
UNION ALL SELECT 'OK', s.key, s.value, NULL, 'locked' FROM s, g WHERE g.key IS NULL AND s.key < 'u000070'
UNION ALL SELECT 'WRONG_SHARD', NULL, NULL, NULL, 'foreign'""",
    "guarded_get": f"""WITH {_LOG}, {_state_sql('s')}, k AS (SELECT concat('u', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS key, c_acctbal < 0 AND c_mktsegment <> 'AUTOMOBILE' AS held FROM customer),
x AS (SELECT k.key, CASE WHEN k.key >= 'u000030' AND k.key < 'u000070' THEN 'WRONG_SHARD' WHEN held THEN 'LOCKED' WHEN s.value IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS code, s.value FROM k LEFT JOIN s ON s.key = k.key)
SELECT key, code, CASE WHEN code = 'OK' THEN value END AS value FROM x""",
    "purge": f"""WITH {_LOG}, {_state_sql('s')}, o AS (SELECT key FROM s WHERE key < 'u000020' OR key >= 'u000090' ORDER BY key LIMIT 30)
SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM o)""",
    "span_verdict": f"WITH {_LINES} SELECT txid, CASE WHEN min(key) >= 200 AND max(key) <= 1700 THEN 'OK' ELSE 'WRONG_SHARD' END AS verdict FROM li GROUP BY txid",
    "prefix_mismatches": f"""WITH {_ENTRIES}, o AS (SELECT grp, node, idx, min(struct_pack(term := term, payload := payload)) AS e FROM en GROUP BY grp, node, idx),
x AS (SELECT grp, idx, e.term AS term, md5(string_agg(concat(idx, ',', e.term, ',', e.payload), ';' ORDER BY idx) OVER (PARTITION BY grp, node ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS prefix FROM o)
SELECT grp, idx, term FROM x GROUP BY grp, idx, term HAVING count(DISTINCT prefix) > 1""",
    "up_to_date": f"""WITH {_ENTRIES}, r AS (SELECT grp, node, row_number() OVER (PARTITION BY grp ORDER BY term DESC, idx DESC, node DESC) AS rn FROM en) SELECT grp, node FROM r WHERE rn = 1""",
    "commit_index": """WITH m AS (SELECT l_orderkey AS grp, l_linenumber AS peer, max(l_partkey) AS match_index FROM lineitem GROUP BY 1, 2),
r AS (SELECT grp, match_index, row_number() OVER (PARTITION BY grp ORDER BY match_index DESC, peer) AS i, count(*) OVER (PARTITION BY grp) AS n FROM m),
c AS (SELECT grp, match_index FROM r WHERE i = CAST(floor(n / 2) AS BIGINT) + 1), e AS (SELECT l_orderkey AS grp, l_partkey AS idx, min(l_suppkey % 3) AS term FROM lineitem GROUP BY 1, 2)
SELECT c.grp, CASE WHEN e.term = o_custkey % 3 THEN c.match_index ELSE -1 END AS commit_index FROM c JOIN orders ON o_orderkey = c.grp LEFT JOIN e ON e.grp = c.grp AND e.idx = c.match_index""",
    "check_quorum": """WITH q AS (SELECT event_type AS grp, 1 + count(DISTINCT CASE WHEN event_id > 888 AND user_id % 7 <> 0 THEN user_id % 7 END) AS active FROM events GROUP BY 1)
SELECT grp, active, active >= 4 AS keeps FROM q""",
    "incomplete_leaders": """WITH c AS (SELECT DISTINCT l_orderkey AS idx, l_linenumber AS term FROM lineitem WHERE l_returnflag = 'N'), l AS (SELECT DISTINCT l_suppkey AS term_led FROM lineitem),
t AS (SELECT term, count(*) AS n FROM c GROUP BY term), d AS (SELECT term_led, CAST(sum(CASE WHEN term < term_led THEN n ELSE 0 END) AS BIGINT) AS due FROM l, t GROUP BY term_led),
g AS (SELECT DISTINCT l_suppkey AS term_led, l_orderkey AS idx, l_linenumber AS term FROM lineitem WHERE l_linenumber < l_suppkey), h AS (SELECT term_led, count(*) AS held FROM g JOIN c USING (idx, term) GROUP BY term_led)
SELECT term_led, due, coalesce(held, 0) AS held FROM d LEFT JOIN h USING (term_led) WHERE coalesce(held, 0) < due""",
    "quorum": """WITH m AS (SELECT l_orderkey AS grp, l_linenumber AS peer, max(l_partkey) AS match_index FROM lineitem GROUP BY 1, 2),
r AS (SELECT grp, match_index, row_number() OVER (PARTITION BY grp ORDER BY match_index DESC, peer) AS i, count(*) OVER (PARTITION BY grp) AS n FROM m)
SELECT grp, match_index AS commit_candidate FROM r WHERE i = CAST(floor(n / 2) AS BIGINT) + 1""",
    "election_safety": "SELECT l_partkey AS term, count(DISTINCT l_linenumber) AS leaders FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1",
    "log_diverge": """WITH l AS (SELECT l_suppkey % 50 AS grp, l_linenumber AS node, l_orderkey AS idx, l_partkey % 3 AS term, l_returnflag AS payload FROM lineitem)
SELECT a.grp, min(a.idx) AS idx FROM l a JOIN l b ON a.grp = b.grp AND a.idx = b.idx AND (a.term <> b.term OR a.payload <> b.payload) GROUP BY a.grp""",
    "log_matching": """SELECT l_suppkey % 50 AS grp, l_orderkey % 500 AS idx, l_partkey % 40 AS term FROM lineitem GROUP BY 1, 2, 3 HAVING count(DISTINCT l_returnflag) > 1""",
    "machine_safety": "SELECT l_orderkey AS idx FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate) > 1",
    "term_runs": "SELECT o_custkey % 20 AS grp, o_orderpriority AS term, min(o_orderkey) AS first_idx, max(o_orderkey) AS last_idx FROM orders GROUP BY 1, 2",
    "stale_reads": """SELECT r.event_id AS read_id, r.event_id - r.user_id % 9 AS read_index, max(c.event_id) AS known FROM events r JOIN events c ON c.event_type = 'purchase' AND c.event_id <= r.event_id
WHERE r.event_type = 'view' GROUP BY r.event_id, r.user_id HAVING max(c.event_id) > r.event_id - r.user_id % 9""",
    "conservation": "SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(20,2))) AS DECIMAL(30,2)) = sum(CAST(c_acctbal + CASE c_custkey WHEN 1 THEN -5 WHEN 2 THEN 5 ELSE 0 END AS DECIMAL(20,2))) AS conserved FROM customer",
    "percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = least(n - 1, CAST(floor(0.50 * n) AS BIGINT)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) THEN value END) AS p95,
max(CASE WHEN i = least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) THEN value END) AS p99 FROM r GROUP BY event_type""",
    "repeats": """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
m AS (SELECT l_returnflag, max(CASE WHEN i = CAST(floor(n / 2) AS BIGINT) THEN v END) AS median, max(v) - min(v) AS width FROM r GROUP BY 1)
SELECT l_returnflag, median, width / median AS spread FROM m""",
    "linearizability": """WITH w AS (SELECT *, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER u AS last FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, last_value(CASE WHEN event_type <> 'view' THEN struct_pack(v := last) END IGNORE NULLS) OVER u AS b FROM w WINDOW u AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS ops, bool_and(event_type <> 'view' OR value >= 0.8 OR b.v IS NOT DISTINCT FROM last) AS linearizable FROM x GROUP BY 1""",
}
