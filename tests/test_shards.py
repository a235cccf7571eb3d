import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import shards, state

STARTS = [(1, None), (2, "g"), (3, "p")]


def routed(spark, catalog, keys):
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    return {r["key"]: r["shard_id"] for r in shards.route(df, catalog).collect()}


def test_lookup(spark):
    got = routed(spark, shards.create(spark, STARTS), ["", "apple", "fzzz", "g", "moon", "p", "zebra", "é"])
    assert got == {"": 1, "apple": 1, "fzzz": 1, "g": 2, "moon": 2, "p": 3, "zebra": 3, "é": 3}


@pytest.mark.parametrize(
    "span, ids",
    [(("a", "c"), {1}), (("a", "g"), {1}), (("a", "h"), {1, 2}), (("h", None), {2, 3}), ((None, None), {1, 2, 3}), (("m", "m"), set()), (("z", "a"), set())],
)
def test_overlap(spark, span, ids):
    assert {r["shard_id"] for r in shards.overlapping(shards.create(spark, STARTS), *span).collect()} == ids


def test_split_and_catalog_rules(spark):
    first = shards.create(spark, STARTS)
    after = shards.split(first, "k", 9)
    assert {r["epoch"] for r in after.collect()} == {2}
    assert routed(spark, after, ["h", "k", "o", "p"]) == {"h": 2, "k": 9, "o": 9, "p": 3}
    for key in ("g", ""):
        with pytest.raises(ValueError):
            shards.split(first, key, 9)
    for bad in ([], [(1, "a")], [(1, None), (1, "b")], [(1, None), (2, "c"), (3, "b")]):
        with pytest.raises(ValueError):
            shards.create(spark, bad)
    both = after.union(shards.create(spark, STARTS))
    assert {r["epoch"] for r in shards.newest(both).collect()} == {2}


def test_verdicts(spark):
    rows = [("h", True), ("a", True), ("p", True), ("k", True), ("k", False), ("h", False)]
    df = spark.createDataFrame(rows, "key string, write boolean")
    lit = lambda x: F.lit(x).cast("string")
    got = df.select(shards.verdict(F.col("key"), lit("g"), lit("p"), lit("j"), lit(None), F.lit(True), F.col("write"), F.lit(True)).alias("v"))
    assert [r["v"] for r in got.collect()] == ["OK", "WRONG_SHARD", "WRONG_SHARD", "MOVING", "OK", "OK"]
    span = lambda s, e: spark.range(1).select(shards.span_verdict(lit(s), lit(e), lit(None), lit("m"), F.lit(True)).alias("v")).first()["v"]
    assert [span(None, None), span(None, "m"), span("a", "z")] == ["WRONG_SHARD", "OK", "WRONG_SHARD"]
    by_key = spark.createDataFrame([(1, "OK"), (1, "MOVING"), (2, "MOVING"), (2, "WRONG_SHARD"), (3, "OK")], "command int, verdict string")
    assert {r["command"]: r["verdict"] for r in shards.command_verdict(by_key).collect()} == {1: "MOVING", 2: "WRONG_SHARD", 3: "OK"}


def test_epochs_and_fences(spark):
    now = spark.createDataFrame([("a", "m", 5, True)], "lo string, hi string, epoch int, fenced boolean")
    old = shards.set_owned(now, "b", "c", 3).first()
    assert not old["accepted"] and old["lo"] == "a"
    assert shards.set_owned(now, "b", "c", 5).first()["accepted"]
    locks = spark.createDataFrame([("m",)], "key string")
    free = {"lo": "a", "hi": "z", "epoch": 1, "owns": True, "fenced": False, "fence_lo": None, "fence_hi": None}
    one = lambda **x: spark.createDataFrame([tuple((free | x).values())], "lo string, hi string, epoch int, owns boolean, fenced boolean, fence_lo string, fence_hi string")
    refused, taken, nobody, unset = (shards.fence(one(**x), locks, *span).first() for x, span in (({}, ("k", None)), ({}, ("a", "k")), ({"owns": False}, ("a", "k")), ({"owns": None}, ("a", "k"))))
    assert (refused["accepted"], refused["fenced"], refused["fence_lo"]) == (False, False, None)
    assert (taken["accepted"], taken["fenced"], taken["fence_lo"], taken["fence_hi"]) == (True, True, "a", "k")
    assert not nobody["accepted"] and unset["accepted"] and unset["owns"]


def test_catalogs_of_many_shards(spark, monkeypatch):
    starts = [(1, None)] + [(i, f"k{i:04d}") for i in range(2, 400)]
    catalog = shards.create(spark, starts)
    keys = ["", "k", "k0002", "k0002x", "k0003", "k0398", "k0399", "z", "é"]
    want = {k: max((i for i, lo in starts if lo is None or lo.encode() <= k.encode()), default=1) for k in keys}
    assert routed(spark, catalog, [*keys, None]) == want
    monkeypatch.setattr(shards, "_TREE", 8)
    assert routed(spark, catalog, [*keys, None]) == want
    plan = shards.route(spark.createDataFrame([("a",)], "key string"), shards.create(spark, STARTS))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_purge_and_balance(spark):
    kept, gone = shards.purge(spark.createDataFrame([(c, c) for c in "abcdefgh"], "key string, value string"), "c", "f", 3)
    assert sorted(r["key"] for r in kept.collect()) == list("cdegh") and gone.first()["deleted"] == 3
    kept, gone = shards.purge(kept, "c", "f")
    assert sorted(r["key"] for r in kept.collect()) == list("cde") and gone.first()["deleted"] == 2
    letters = spark.createDataFrame([(chr(97 + i), str(i)) for i in range(26)], "key string, value string")
    assert [r["deleted"] for r in shards.purge_pages(letters, "a", "m", 5).orderBy("page").collect()] == [5, 5, 4]
    many = spark.createDataFrame([(f"k{i:03d}", "v") for i in range(160)], "key string, value string")
    one = shards.create(spark, [(1, None)])
    assert shards.balance_plan(many.limit(60), one, 100, 50).count() == 0
    plan = shards.balance_plan(many, one, 100, 50).first()
    assert (plan["split_key"], plan["keys_counted"]) == ("k075", 150)
    after = shards.split(one, plan["split_key"], 2)
    assert shards.route(many, after).groupBy("shard_id").count().count() == 2 and shards.route(many, after).count() == 160
    assert state.diff(many, shards.route(many, after)).count() == 0
