import pytest

from ledgerfold.operators import reads, shards
from ledgerfold.sources.directory import Directory
from ledgerfold.splits import PHASES, Cluster, Refused

KV = "key string, value string"


def filled(spark, root):
    c = Cluster(spark, str(root))
    assert c.create([(1, None), (2, "m")]) and not c.create([(1, None)])
    for shard, keys in ((1, "abcdef"), (2, "mnopqrstuvw")):
        c.shard(shard).write(state=spark.createDataFrame([(k, k.upper()) for k in keys], KV))
    return c


@pytest.mark.parametrize("stop", PHASES)
def test_a_split_goes_on_from_any_phase(spark, tmp_path, stop):
    c = filled(spark, tmp_path)
    before = sorted((r["key"], r["value"]) for r in c.state().collect())
    assert c.split("s", "r", 7, stop_after=stop) == stop
    if stop == "fenced":
        assert c.shard(2).range()["fenced"] and not c.shard(7).range()["owns"]
        new = spark.createDataFrame([("a", "A"), ("s", "S"), ("n", "N"), ("b2", None)], KV)
        assert {r["key"]: r["code"] for r in c.put(new).collect()} == {"a": "OK", "s": "MOVING", "n": "OK", "b2": "OK"}
    if stop == "published":  # the catalog names a shard that does not own its range yet
        assert [r["code"] for r in c.scan("q", "t").collect()] == ["WRONG_SHARD"]
    assert c.resume("s") == "done" and c.resume("s") == "done"
    assert sorted((r["key"], r["value"]) for r in c.state().collect()) == before
    assert sorted(r["key"] for r in c.shard(2).state().collect()) == list("mnopq")
    assert sorted(r["key"] for r in c.shard(7).state().collect()) == list("rstuvw")
    _, catalog = c.directory.load()
    assert sorted((r["shard_id"], r["lo"], r["hi"], r["epoch"]) for r in catalog.collect()) == [(1, None, "m", 2), (2, "m", "r", 2), (7, "r", None, 2)]
    assert (c.shard(2).range()["hi"], c.shard(2).range()["fenced"], c.shard(7).range()["lo"]) == ("r", False, "r")
    assert [(r["code"], r["key"]) for r in c.scan("e", "o").collect()] == [("OK", k) for k in "efmn"]
    assert [r["key"] for r in c.scan("p", None, 3).collect()] == list("pqr")
    with pytest.raises(KeyError):
        c.resume("other")


def test_a_lock_or_an_old_epoch_refuses(spark, tmp_path):
    c = filled(spark, tmp_path)
    c.shard(2).write(locks=spark.createDataFrame([("s", 1, "s", "PUT", "x")], "key string, txid long, primary_key string, kind string, value string"))
    assert {r["key"]: r["code"] for r in c.put(spark.createDataFrame([("s", "x"), ("zz", "y")], KV)).collect()} == {"s": "LOCKED", "zz": "OK"}
    assert [tuple(r)[:2] for r in c.scan("a", None).collect()] == [("LOCKED", "s")]
    with pytest.raises(Refused):
        c.split("s", "r", 7)
    assert c.directory.record("split/s")["phase"] == "started"
    c.shard(2).write(locks=c.shard(2).locks().limit(0))
    assert c.resume("s") == "done"
    with pytest.raises(Refused):
        c.shard(2).set_owned("m", None, 1)


def test_balancing_splits_the_first_large_shard(spark, tmp_path):
    c = filled(spark, tmp_path)
    assert c.balance(most=8, size=3) and not c.balance(most=8, size=3)
    _, catalog = c.directory.load()
    assert {r["shard_id"] for r in catalog.collect()} == {1, 2, 3} and c.directory.record("split/auto-1-2")["phase"] == "done"


def test_directory_replaces_only_what_was_read(spark, tmp_path):
    d = Directory(spark, str(tmp_path))
    assert d.load() == (None, None) and d.record("x") is None
    d.put_record("x", {"a": 1})
    one = shards.create(spark, [(1, None)])
    assert d.compare_and_publish(None, one) and not d.compare_and_publish(None, one)
    token, _ = d.load()
    d.put_record("y", {"b": 2})
    assert d.compare_and_publish(token, shards.split(one, "k", 2)) and not d.compare_and_publish(token, one)
    assert d.record("x") == {"a": 1} and d.load()[1].count() == 2
    d.delete_record("x")
    assert d.record("x") is None and d.record("y") == {"b": 2}


def test_guarded_reads(spark):
    state = spark.createDataFrame([(k, k) for k in "abcdefgh"], KV)
    owned = shards.create(spark, [(1, None), (2, "c"), (3, "f")])
    locks = spark.createDataFrame([("b", 1, "LOCK_ONLY"), ("e", 2, "PUT"), ("g", 3, "DELETE")], "key string, txid long, kind string")
    rows = lambda *a, **k: [(r["code"], r["key"], r["holder"]) for r in reads.guarded_scan(state, *a, **k).collect()]
    assert rows(owned, locks, "a", "e") == [("OK", k, None) for k in "abcd"] and rows(owned, locks, "a", "e", 2) == [("OK", "a", None), ("OK", "b", None)]
    assert rows(owned, locks, "d", None) == [("LOCKED", "e", "2")]
    assert rows(owned.where("shard_id <> 2"), locks, "b", "g") == [("WRONG_SHARD", None, None)]
    assert rows(owned.where("shard_id = 2"), locks, "c", "e") == [("OK", "c", None), ("OK", "d", None)]
    assert rows(owned.where("shard_id = 2"), locks, "x", "x") == []
    assert not reads.span_owned(owned.where("shard_id <> 3"), "a", None) and reads.span_owned(owned, None, None)
    asked = spark.createDataFrame([(k,) for k in "abegz"], "key string")
    got = {r["key"]: (r["code"], r["value"]) for r in reads.guarded_get(asked, state, owned.where("shard_id <> 1"), locks).collect()}
    assert got == {"a": ("WRONG_SHARD", None), "b": ("WRONG_SHARD", None), "e": ("LOCKED", None), "g": ("LOCKED", None), "z": ("NOT_FOUND", None)}
