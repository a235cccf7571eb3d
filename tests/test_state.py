import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import ordering
from ledgerfold.operators import state
from ledgerfold.sources import versions

LOG = "seq long, key string, op string, value string"


def log(spark, *rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], LOG)


def as_dict(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_newest_wins_and_tombstone_hides(spark):
    df = log(spark, ("a", "put", "old"), ("b", "put", "keep"), ("c", "put", "gone"), ("a", "put", "new"), ("c", "delete", None))
    assert as_dict(state.full_state(df)) == {"a": "new", "b": "keep"}
    again = df.union(spark.createDataFrame([(6, "c", "put", "back"), (7, "e", "put", "")], LOG))
    assert as_dict(state.full_state(again)) == {"a": "new", "b": "keep", "c": "back", "e": ""}


def test_create_only_if_absent(spark):
    df = log(
        spark, ("k", "create", "first"), ("k", "create", "second"), ("d", "put", "x"), ("d", "delete", None), ("d", "create", "y"),
        ("d", "create", "z"), ("p", "put", "1"), ("p", "create", "2"),
    )
    assert as_dict(state.full_state(df)) == {"k": "first", "d": "y", "p": "1"}


def test_fold_equals_sequential_replay(spark, sf_dir):
    from ledgerfold.sources import commands

    df = commands.log_from_events(commands.table(spark, sf_dir, "events"))
    now = {}
    for r in df.orderBy("seq").collect():
        if r["op"] == "put" or (r["op"] == "create" and r["key"] not in now):
            now[r["key"]] = r["value"]
        elif r["op"] == "delete":
            now.pop(r["key"], None)
    assert as_dict(state.full_state(df)) == now


def test_snapshot_hides_later_writes(spark):
    df = log(spark, ("a", "put", "1"), ("b", "put", "1"), ("a", "put", "2"), ("b", "delete", None), ("c", "put", "2"))
    assert as_dict(state.as_of(df, 2)) == {"a": "1", "b": "1"}
    assert as_dict(state.full_state(df)) == {"a": "2", "c": "2"}
    assert {(r["key"], r["left_value"], r["right_value"]) for r in state.diff(state.as_of(df, 2), state.full_state(df)).collect()} == {
        ("a", "1", "2"), ("b", "1", None), ("c", None, "2"),
    }


def test_lookup_tells_tombstone_from_no_record(spark):
    df = log(spark, ("a", "put", "1"), ("b", "put", "1"), ("b", "delete", None))
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    got = {r["key"]: (r["kind"], r["value"]) for r in state.lookup(df, keys).collect()}
    assert got == {"a": ("put", "1"), "b": ("delete", None), "z": (None, None)}


def test_scan_bounds_limits_and_pages(spark):
    df = log(spark, *((f"k{i:04d}", "put", str(i)) for i in range(50)))
    keys = lambda d: [r["key"] for r in d.collect()]
    assert keys(state.scan(df, "k0010", "k0015")) == [f"k{i:04d}" for i in range(10, 15)]
    assert len(keys(state.scan(df, "k0045"))) == 5
    assert keys(state.scan(df, limit=3)) == ["k0000", "k0001", "k0002"]
    assert keys(state.scan(df, "m", "m")) == []
    assert keys(state.scan_namespace(df, "k00", "4", limit=3)) == ["40", "41", "42"] and len(keys(state.scan_namespace(df, "k000"))) == 10
    assert keys(state.scan_namespace(df, "k", "0001", "0003")) == ["0001", "0002"]
    page = state.page(df, None, None, 20).collect()
    assert len(page) == 20 and all(r["more"] for r in page)
    rest = state.next_page(df, "k0044", None, 20).collect()
    assert len(rest) == 5 and not any(r["more"] for r in rest)
    paged = {r["key"]: r["page"] for r in state.pages(state.full_state(df).select("key"), 7).collect()}
    assert paged == {f"k{i:04d}": i // 7 for i in range(50)}


def test_advancing_a_state_equals_folding_the_whole_log(spark):
    rows = [("a", "put", "1"), ("b", "create", "2"), ("a", "delete", None), ("b", "create", "3"), ("a", "create", "4")]
    df = log(spark, *rows)
    whole = as_dict(state.full_state(df))
    for n in range(6):
        stored = state.as_of(df, n)
        assert as_dict(state.advance(stored, df.where(f"seq > {n}"))) == whole


def test_range_reaches_the_scan(spark, tmp_path):
    log(spark, *((f"k{i}", "put", "v") for i in range(9))).write.parquet(str(tmp_path / "log"))
    df = spark.read.parquet(str(tmp_path / "log"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    ranged, stamped = plan(state.scan(df, "k2", "k5")), plan(state.as_of(df, 7))
    assert "GreaterThanOrEqual(key,k2)" in ranged and "LessThan(key,k5)" in ranged
    assert "LessThanOrEqual(seq,7)" in stamped


def test_versions_publish_atomically(spark, tmp_path):
    root = str(tmp_path / "table")
    df = spark.range(10).withColumnRenamed("id", "key")
    assert versions.publish(df, root, None, ("key",)) == 0
    assert versions.publish(df.where("key < 5"), root, 0) == 1
    try:
        versions.publish(df, root, 0)
        raise AssertionError("a stale writer published")
    except versions.Conflict:
        pass
    assert versions.read(spark, root).count() == 5 and versions.read(spark, root, 0).count() == 10
    assert versions.vacuum(spark, root) == [0] and versions.versions(spark, root) == [1]


def test_only_one_of_two_writers_publishes(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    first, second = (spark.createDataFrame([(w,)], "key string") for w in ("first", "second"))
    look, looked = versions.versions, []

    def stale(spark, root):
        # The second writer looks before the first has published.
        looked.append(None)
        return [] if len(looked) == 2 else look(spark, root)

    monkeypatch.setattr(versions, "versions", stale)
    assert versions.publish(first, root, None) == 0
    with pytest.raises(versions.Conflict):
        versions.publish(second, root, None)
    monkeypatch.undo()
    assert [r["key"] for r in versions.read(spark, root).collect()] == ["first"] and versions.versions(spark, root) == [0]
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("data-")]) == 1


def test_writers_at_once(spark, tmp_path):
    root, done = str(tmp_path / "table"), []

    def write(k):
        for _ in range(3):
            known = versions.versions(spark, root)
            try:
                done.append((k, versions.publish(spark.createDataFrame([(k,)], "key int"), root, known[-1] if known else None)))
            except versions.Conflict:
                pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for _, v in done) == versions.versions(spark, root) == list(range(len(done)))
    assert all(versions.read(spark, root, v).first()["key"] == k for k, v in done)


def test_tables_and_facts_of_one_version(spark, tmp_path):
    root = str(tmp_path / "table")
    a, b = spark.range(3).withColumnRenamed("id", "key"), spark.range(5)
    assert versions.publish({"a": a, "b": b}, root, None, ("key",), {"mark": 7}) == 0
    folder = versions.manifest(spark, root)["tables"]["b"]
    assert versions.publish({"a": a.limit(1), "b": folder}, root, 0, facts={"mark": 8}) == 1
    assert versions.vacuum(spark, root) == [0]
    assert versions.read(spark, root, table="a").count() == 1 and versions.read(spark, root, table="b").count() == 5
    assert versions.manifest(spark, root)["facts"] == {"mark": 8}
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, table="c")


def test_log_ranges(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = log(spark, *(("k", "put", str(i)) for i in range(30)))
    seqs = lambda after=0: sorted(r["seq"] for r in versions.read_log(spark, path, after).collect())
    versions.append_log(rows.where("seq <= 12"), path, 10)
    versions.append_log(rows.where("seq > 12"), path, 10)
    assert seqs(25) == list(range(26, 31)) and seqs() == list(range(1, 31))
    versions.truncate_log(spark, path, 13)
    assert seqs() == list(range(1, 14)) and seqs(12) == [13] and seqs(13) == []
    # What is appended after a cut stands in the place of what was cut off.
    versions.append_log(rows.where("seq between 14 and 15").withColumn("value", F.lit("new")), path, 10)
    assert seqs() == list(range(1, 16)) and {r["value"] for r in versions.read_log(spark, path, 13).collect()} == {"new"}
    versions.compact_log(spark, path, 12)
    assert seqs() == [13, 14, 15] and seqs(14) == [15]
    versions.vacuum(spark, path)
    assert seqs() == [13, 14, 15]
    versions.compact_log(spark, path, 15)
    assert seqs() == [] and versions.read_log(spark, path).columns == rows.columns


def test_running_totals_cross_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40), None if i % 7 == 0 else rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, o int, v int").repartition(5)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for how in ("max", "sum"):
        want, held = {}, []
        for i, _, v in order:
            held += [] if v is None else [v]
            want[i] = (max(held) if how == "max" else sum(held)) if held else None
        assert {r["id"]: r["running"] for r in ordering.running(df, "v", "o", "id", how=how).collect()} == want
