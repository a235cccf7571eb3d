from ledgerfold.operators import transactions as t

LOCKS = "key string, txid int, primary_key string, kind string, value string"
WRITES = "txid int, pos int, key string, kind string, value string, expected string, validate boolean"


def frames(spark):
    locks = spark.createDataFrame(
        [("a", 1, "a", "PUT", "new-a"), ("b", 1, "a", "DELETE", None), ("r", 1, "a", "LOCK_ONLY", None), ("z", 2, "z", "PUT", "new-z"), ("y", 3, "y", "PUT", "new-y")], LOCKS
    )
    decisions = spark.createDataFrame([(1, "C"), (2, "A"), (3, None)], "txid int, decision string")
    return locks, decisions


def test_readers_and_writers_meet_locks(spark):
    locks, _ = frames(spark)
    keys = spark.createDataFrame([("a",), ("r",), ("q",)], "key string")
    assert [r["key"] for r in t.blocking(keys, locks).collect()] == ["a"]
    assert t.blocking_in_span(locks, "b", "zz").first()["key"] == "b"
    assert t.blocking_in_span(locks, "r", "s").count() == 0
    touched = spark.createDataFrame([(7, 0, "q"), (7, 1, "r"), (7, 2, "a"), (8, 0, "q")], "command int, pos int, key string")
    assert [(r["command"], r["lock"]["key"]) for r in t.locked_writes(touched, locks).collect()] == [(7, "r")]


def test_commit_effects_and_resolution(spark):
    locks, decisions = frames(spark)
    assert {(r["key"], r["op"], r["value"]) for r in t.effects(locks, decisions).collect()} == {("a", "put", "new-a"), ("b", "delete", None)}
    assert {r["key"] for r in t.remaining(locks, decisions).collect()} == {"y"}
    got = {r["key"]: r["action"] for r in t.resolve(locks, decisions).collect()}
    assert got == {"a": "apply_PUT", "b": "apply_DELETE", "r": "release", "z": "rollback", "y": "wait"}
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "txid int")
    assert {r["txid"]: r["code"] for r in t.commit(locks, ids, decisions).collect()} == {1: "OK", 2: "ABORTED", 3: "OK", 4: "ABORTED"}
    assert {r["txid"]: r["code"] for r in t.rollback(ids, decisions).collect()} == {1: "ALREADY_COMMITTED", 2: "OK", 3: "OK", 4: "OK"}


def test_prewrite(spark):
    locks = spark.createDataFrame([("k", 1)], "key string, txid int")
    state = spark.createDataFrame([("s", "now")], "key string, value string")
    decisions = spark.createDataFrame([(9, "A")], "txid int, decision string")
    rows = [
        (2, 0, "free", "PUT", "v", None, True), (2, 1, "k", "PUT", "v", None, True), (3, 0, "none", "PUT", "v", None, True),
        (3, 1, "s", "PUT", "v", "stale", True), (4, 0, "s", "PUT", "v", "now", True), (1, 0, "k", "PUT", "v", None, False), (9, 0, "q", "PUT", "v", None, False),
    ]
    writes = spark.createDataFrame(rows, WRITES)
    got = {r["txid"]: (r["code"], r["failed"]) for r in t.prewrite(writes, locks, state, decisions).collect()}
    assert got == {2: ("LOCKED", 1), 3: ("VALIDATION_FAILED", 1), 4: ("OK", None), 1: ("OK", None), 9: ("ABORTED", None)}
    valid = {r["txid"]: (r["valid"], r["failed"]) for r in t.validate(writes, state).collect()}
    assert valid == {2: (True, None), 3: (False, 1), 4: (True, None)}


def test_merge_and_paths(spark):
    reads = spark.createDataFrame([(1, "a", "x"), (1, "b", None)], "txid int, key string, seen string")
    writes = spark.createDataFrame([(1, "a", "PUT", "y"), (1, "c", "DELETE", None)], "txid int, key string, kind string, value string")
    got = {r["key"]: (r["kind"], r["validate"], r["expected"]) for r in t.merged(reads, writes).collect()}
    assert got == {"a": ("PUT", True, "x"), "b": ("LOCK_ONLY", True, None), "c": ("DELETE", False, None)}
    routed = spark.createDataFrame([(1, "b", 1), (1, "a", 1), (2, "a", 1), (2, "z", 2)], "txid int, key string, shard_id int")
    assert {r["txid"]: (r["path"], r["primary_key"]) for r in t.commit_paths(routed).collect()} == {1: ("batch", "a"), 2: ("2pc", "a")}
