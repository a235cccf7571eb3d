"""Tables that outlive the executors that made them, and connected components over them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, tempfile.TemporaryDirectory] = {}


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the folder that driver and executors share.

    That is spark.checkpoint.dir, else the context's checkpoint folder. Where neither is set, one machine
    may use a folder of its own, which goes when Python ends; a cluster has to name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.TemporaryDirectory(prefix="checkpoint-", ignore_cleanup_errors=True)
        shared = _OWN["dir"].name
    return f"{shared.rstrip('/')}/ledgerfold-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that are not written yet need them."""
    at, fs = _path(spark, work_dir(spark))
    fs.delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts that are read within go to Python in smaller Arrow batches than the default of 10,000 rows.

    A batch of long texts is held by the JVM, by Arrow and by Python at once. A smaller setting of the
    user's stays, and afterwards the session has its own again.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lists of those who record what is written.
_RECORDS: list[list[str]] = []


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    path = fresh(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    for record in _RECORDS:
        record.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are written within."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not made]


def discard_but_for(df: DataFrame, paths: list[str]) -> list[str]:
    """Delete those of the tables from which ``df`` is not read; returns the others."""
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()} if paths else set()
    kept = [p for p in paths if p.rsplit("/", 1)[-1] in folders]
    for path in set(paths) - set(kept):
        at, fs = _path(df.sparkSession, path)
        fs.delete(at, True)
    return kept


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no plan needs any more."""
    for file in df.inputFiles()[:1]:
        at, fs = _path(df.sparkSession, file)
        fs.delete(at.getParent(), True)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, share: int = 1000) -> DataFrame:
    """Left join of many rows with few facts a key, in which no key's rows all meet in one task.

    A key of more than 1/``share`` of the rows is dealt to pieces by a hash of ``by``, and its facts go to
    each of them. There are fewer than ``share`` such keys, so the list of them may be broadcast.
    ``rows`` is read twice and should be a written table.
    """
    total = rows.count()
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") * share > total)
    hot = F.broadcast(materialize(counts.select(key, F.ceil(F.col("_rows") * share / max(total, 1)).alias("_pieces")), "hot-keys"))
    piece = F.coalesce(F.pmod(F.xxhash64(by), F.col("_pieces")), F.lit(0)).alias("_piece")
    left = rows.join(hot, key, "left").select(*rows.columns, piece)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1)).alias("_piece")
    return left.join(facts.join(hot, key, "left").select(*facts.columns, every), [key, "_piece"], "left").drop("_piece")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every node that has an edge, as (node, component).

    Alternates the large-star and the small-star step of Kiveris et al. (2014), each one a shuffle of
    the edges, until nothing changes; the number of rounds grows with the logarithm of the
    component's size. A hot centre is aggregated before the shuffle, and its neighbours meet only
    its minimum. Self edges and repeated edges are allowed; edges with a null end are ignored.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        # Large star: every larger neighbour of u is hung to the smallest of u's neighbourhood.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are hung to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if state == before:
            break
        before = state
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(now.select("v", "v").distinct())
