import pytest

from ledgerfold.__main__ import main
from ledgerfold.sources import versions
from ledgerfold.store import Conflict, Store

KV = "key string, value string"


def rows(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_store_moves_by_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    assert rows(s.state()) == {} and s.version() is None
    s.write(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "")], KV))
    s.write(spark.createDataFrame([("b", None), ("d", "4")], KV))
    assert rows(s.scan("a", "d")) == {"a": "1", "c": ""} and rows(s.state(0)) == {"a": "1", "b": "2", "c": ""}
    assert rows(s.get(spark.createDataFrame([("a",), ("b",)], "key string"))) == {"a": "1", "b": None}
    swaps = spark.createDataFrame([("a", "1", "9"), ("b", None, "new"), ("d", "wrong", "x")], "key string, expected string, value string")
    got = {r["key"]: (r["applied"], r["observed"]) for r in s.cas(swaps).collect()}
    assert got == {"a": (True, None), "b": (True, None), "d": (False, "4")}
    assert rows(s.state()) == {"a": "9", "b": "new", "c": "", "d": "4"}


def test_batches_and_transactions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.write(spark.createDataFrame([("acct-a", "100"), ("acct-z", "100")], KV))
    checks = spark.createDataFrame([(1, 0, "acct-a", "100"), (2, 0, "zz", "x")], "batch int, pos int, key string, expected string")
    ops = spark.createDataFrame([(1, 0, "k", "put", "v"), (2, 0, "q", "put", "v"), (3, 0, "r", "put", "v")], "batch int, pos int, key string, op string, value string")
    assert {r["batch"]: r["applied"] for r in s.batch(checks, ops).collect()} == {1: True, 2: False, 3: True}
    assert set(rows(s.state())) == {"acct-a", "acct-z", "k", "r"}
    t, u = s.begin(), s.begin()
    reads = t.get(spark.createDataFrame([("acct-a",), ("acct-z",), ("none",)], "key string"))
    move = spark.createDataFrame([("acct-a", "40"), ("acct-z", "160")], KV)
    assert t.commit(reads, move)
    assert not u.commit(u.get(spark.createDataFrame([("acct-a",)], "key string")), move)
    assert rows(s.scan("acct", "acctz")) == {"acct-a": "40", "acct-z": "160"}
    with pytest.raises(Conflict):
        versions.publish(s.state(), s.root, 0)


def test_transactions_see_their_own_writes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.write(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], KV))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    t = s.begin()
    t.put(spark.createDataFrame([("a", "10"), ("n", "new")], KV))
    t.delete(keys("b"))
    t.put(spark.createDataFrame([("a", "11")], KV))
    assert rows(t.get(keys("a", "b", "c", "n", "z"))) == {"a": "11", "b": None, "c": "3", "n": "new", "z": None}
    # Another writer changes only what this one wrote blindly.
    s.write(spark.createDataFrame([("a", "other")], KV))
    assert rows(t.get(keys("c"))) == {"c": "3"} and t.commit()
    assert rows(s.state()) == {"a": "11", "c": "3", "n": "new"}
    u = s.begin()
    u.get(keys("c", "z"))
    s.write(spark.createDataFrame([("z", "phantom")], KV))
    u.put(spark.createDataFrame([("c", "lost")], KV))
    assert not u.commit() and rows(s.state())["c"] == "3"
    assert s.begin().commit()


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "t")
    run = lambda *a: main([root, *a], spark)
    assert run("put", "k", "v") == 0 and run("get", "k") == 0 and capsys.readouterr().out == "v\n"
    assert run("cas", "k", "-", "x") == 4 and run("cas", "k", "v", "w") == 0 and run("delete", "k") == 0
    assert run("get", "k") == 3 and run("scan") == 0 and run("put", "k") == 2
