import random

from ledgerfold.operators import writes

CMD = "seq long, key string, op string, expected string, value string"


def test_cas_cases(spark):
    rows = [
        (1, "k", "cas", None, "first"), (2, "k", "cas", None, "second"), (3, "s", "put", None, "old"), (4, "s", "cas", "old", "new"),
        (5, "m", "put", None, "actual"), (6, "m", "cas", "guessed", "new"), (7, "absent", "cas", "something", "new"),
        (8, "d", "put", None, "x"), (9, "d", "delete", None, None), (10, "d", "cas", None, "again"),
    ]
    df = spark.createDataFrame(rows, CMD)
    assert {r["key"]: r["value"] for r in writes.compare_and_swap(df).collect()} == {
        "k": "first", "s": "new", "m": "actual", "absent": None, "d": "again",
    }
    got = {r["seq"]: (r["applied"], r["observed"]) for r in writes.cas_outcomes(df).collect()}
    assert got == {1: (True, None), 2: (False, "first"), 4: (True, None), 6: (False, "actual"), 7: (False, None), 10: (True, None)}


def test_batches(spark):
    state = spark.createDataFrame([("taken", "mine")], "key string, value string")
    checks = spark.createDataFrame(
        [(1, 0, "free", None), (1, 1, "taken", None), (2, 0, "taken", "mine"), (3, 0, "free", None)],
        "batch int, pos int, key string, expected string",
    )
    got = {r["batch"]: (r["applied"], r["failed_check"]) for r in writes.batch_verdicts(checks, state).collect()}
    assert got == {1: (False, 1), 2: (True, None), 3: (True, None)}
    effects = spark.createDataFrame(
        [(1, 0, "free", "put", "x"), (2, 0, "k", "put", "first"), (2, 1, "k", "put", "second"), (3, 0, "j", "put", "a"), (3, 1, "j", "delete", None)],
        "batch int, pos int, key string, op string, value string",
    )
    from pyspark.sql import functions as F

    out = writes.batch_effects(effects, writes.batch_verdicts(checks, state), F.col("batch"))
    assert {(r["seq"], r["key"], r["op"], r["value"]) for r in out.collect()} == {(2, "k", "put", "second"), (3, "j", "delete", None)}


def test_normalised_keeps_first_check_and_last_write(spark):
    ops = spark.createDataFrame(
        [(1, 0, "k", "check", "a"), (1, 1, "k", "check", "b"), (1, 2, "k", "write", "c"), (1, 3, "k", "write", "d"), (1, 4, "j", "check", "e")],
        "batch int, pos int, key string, role string, value string",
    )
    got = {r["key"]: (r["checked"], r["expected"], r["written"], r["value"]) for r in writes.normalised(ops).collect()}
    assert got == {"k": (True, "a", True, "d"), "j": (True, "e", False, None)}


def test_sessions(spark):
    rows = [
        (1, "c1", 1, "put k original"), (2, "c2", 1, "put k changed"), (3, "c1", 1, "put k original"), (4, "c1", 2, "x"),
        (5, "c1", 1, "put k original"), (6, "c2", 1, "another"), (7, "", 0, "x"), (8, "", 0, "x"), (9, None, 0, "x"),
    ]
    df = spark.createDataFrame(rows, "idx long, client string, seq long, cmd string")
    judged = writes.session_verdicts(df)
    assert [r["verdict"] for r in judged.orderBy("idx").collect()] == [
        "applied", "applied", "replayed", "applied", "stale", "reused", "applied", "applied", "applied",
    ]
    results = spark.createDataFrame([(1, "MISMATCH"), (2, "OK"), (4, "OK")], "idx long, code string")
    answers = {r["idx"]: (r["code"], r["deduplicated"]) for r in writes.cached_results(judged.where("client <> ''"), results).collect()}
    assert answers == {1: ("MISMATCH", False), 2: ("OK", False), 3: ("MISMATCH", True), 4: ("OK", False), 5: ("INVALID", False), 6: ("INVALID", False)}
    assert writes.after_high_water(df, 6).count() == 3


def test_cas_runs_of_a_hot_key(spark):
    rng, rows, now, want = random.Random(2), [], None, {}
    for i in range(600):
        op, value, expected = rng.choice(("put", "delete", "cas", "cas", "cas", "cas")), f"v{rng.randrange(4)}", rng.choice((None, "v0", "v1"))
        rows.append((i, "hot", op, expected, None if op == "delete" else value))
        if op == "cas":
            want[i] = (now == expected, None if now == expected else now)
            now = value if now == expected else now
        else:
            now = None if op == "delete" else value
    df = spark.createDataFrame(rows, CMD)
    assert {r["seq"]: (r["applied"], r["observed"]) for r in writes.cas_outcomes(df.repartition(5)).collect()} == want


def test_batch_codes(spark):
    state = spark.createDataFrame([("taken", "mine")], "key string, value string")
    checks = spark.createDataFrame([(1, 0, "taken", None), (2, 0, "taken", "mine"), (5, 0, "a", None), (5, 1, "b", None), (5, 2, "c", None)], "batch int, pos int, key string, expected string")
    ops = spark.createDataFrame([(3, 0, "k", "put", "v")], "batch int, pos int, key string, op string, value string")
    known = spark.createDataFrame([(i,) for i in range(1, 6)], "batch int")
    got = {r["batch"]: (r["code"], r["failed_check"]) for r in writes.batch_codes(known, checks, ops, state, most=2).collect()}
    assert got == {1: ("MISMATCH", 0), 2: ("OK", None), 3: ("OK", None), 4: ("INVALID", None), 5: ("INVALID", None)}


def test_sessions_of_clients(spark):
    df = spark.createDataFrame([(1, "c", 1, "a"), (2, "c", 4, "b"), (3, "c", 4, "x"), (4, "c", 2, "y"), (5, "", 9, "z"), (6, "d", 1, "q")], "idx long, client string, seq long, cmd string")
    assert {tuple(r) for r in writes.sessions(df).collect()} == {("c", 4, "b"), ("d", 1, "q")}
    assert [tuple(r) for r in writes.session_of(df, "d").collect()] == [("d", 1, "q")]
