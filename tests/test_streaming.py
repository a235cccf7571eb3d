from pyspark.sql import functions as F

from ledgerfold.operators import state, writes
from ledgerfold.sources import commands, versions
from ledgerfold.streaming import fold, sessions


def stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_sessions_match_the_batch_form(spark, tmp_path):
    rows = [(1, "c", 1, "a"), (2, "c", 1, "a"), (3, "c", 1, "b"), (4, "c", 2, "x"), (5, "c", 1, "a"), (6, "", 0, "y")]
    df = spark.createDataFrame(rows, "idx long, client string, seq long, cmd string").coalesce(1)
    got = drain(sessions.session_verdicts(stream(spark, df, str(tmp_path / "in"), 1)), "session_verdicts")
    want = writes.session_verdicts(df)
    assert sorted((r["idx"], r["verdict"]) for r in got.collect()) == sorted((r["idx"], r["verdict"]) for r in want.collect())


def test_fold_follows_the_log_and_ignores_redelivery(spark, tmp_path, sf_dir):
    log = commands.log_from_events(commands.table(spark, sf_dir, "events"))
    root = str(tmp_path / "state")
    for k, part in enumerate((log.where("seq <= 300"), log.where("seq <= 600"), log)):
        source = stream(spark, part, str(tmp_path / f"in{k}"), 1)
        fold.follow(source, root, str(tmp_path / f"c{k}")).awaitTermination()
    live = {r["key"]: r["value"] for r in fold.live(versions.read(spark, root)).collect()}
    assert live == {r["key"]: r["value"] for r in state.full_state(log).collect()}


def test_windows_and_bounded_dedup(spark, tmp_path, sf_dir):
    events = commands.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("op"), F.col("user_id").alias("client"), F.col("event_id").alias("seq"))
    counted = drain(fold.windowed_counts(stream(spark, events, str(tmp_path / "w"), 1)), "windowed", "complete")
    assert counted.agg(F.sum("n")).first()[0] == events.count()
    twice = events.union(events)
    assert drain(sessions.distinct_commands(stream(spark, twice, str(tmp_path / "d"), 1), "365 days"), "deduped").count() == events.count()


def test_abandoned_locks_time_out(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "k", 1, "lock"), ("2024-01-01 00:00:00", "j", 2, "lock"), ("2024-01-01 00:00:00", "j", 2, "release")]
    later = [("2024-01-01 01:00:00", "other", 3, "lock")]
    schema = "ts string, key string, txid long, event string"
    path = str(tmp_path / "in")
    for part in (rows, later):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("ts timestamp, key string, txid long, event string").option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(sessions.abandoned_locks(source), "abandoned")
    assert [(r["key"], r["txid"]) for r in got.where("key <> 'other'").collect()] == [("k", 1)]


def test_fold_keeps_sessions_and_mark_with_the_state(spark, tmp_path):
    cols = "seq long, key string, op string, value string, client string, number long, cmd string"
    parts = [
        [(1, "k", "put", "a", "c", 1, "x"), (2, "k", "put", "b", "c", 1, "x"), (3, "j", "put", "q", None, None, "y")],
        [(3, "j", "put", "again", None, None, "y"), (4, "k", "put", "c", "c", 1, "x"), (5, "k", "delete", None, "c", 2, "z")],
        [(6, "k", "create", "d", "c", 2, "z"), (7, "k", "create", "e", "d", 1, "z")],
    ]
    root, logs = str(tmp_path / "state"), str(tmp_path / "log")
    states = []
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, cols)
        versions.append_log(df.select("seq", "key", "op", "value").where(f"seq > {(0, 3, 5)[k]}"), logs)
        fold.follow(stream(spark, df, str(tmp_path / f"in{k}"), 1), root, str(tmp_path / f"c{k}")).awaitTermination()
        states.append({r["key"]: r["value"] for r in fold.live(versions.read(spark, root)).collect()})
    assert states == [{"k": "a", "j": "q"}, {"j": "q"}, {"k": "e", "j": "q"}]
    assert {(r["client"], r["last_seq"]) for r in versions.read(spark, root, table="sessions").collect()} == {("c", 2), ("d", 1)}
    assert fold.compact(spark, logs, root) == 0 and versions.read_log(spark, logs).count() == 7
    assert fold.compact(spark, logs, root, threshold=5) == 7 and versions.read_log(spark, logs).count() == 0


def test_several_locks_of_a_key_time_out_alone(spark, tmp_path):
    at = "2024-01-01 00:00:00"
    rows = [(at, "k", 1, "lock"), (at, "k", 2, "lock"), (at, "k", 1, "release"), (at, "j", 5, "release"), (at, "j", 5, "lock")]
    schema, path = "ts string, key string, txid long, event string", str(tmp_path / "in")
    for part in (rows, [("2024-01-01 01:00:00", "other", 3, "lock")]):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("ts timestamp, key string, txid long, event string").option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(sessions.abandoned_locks(source), "abandoned_several")
    assert [(r["key"], r["txid"]) for r in got.where("key <> 'other'").collect()] == [("k", 2)]
