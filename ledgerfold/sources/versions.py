"""Versioned tables: immutable Parquet folders, and for each version one manifest that names them.

A writer stages its folders and then claims the next version by giving the manifest its name, which fails
if another writer has given that name first; folders are never moved. A reader picks a manifest and keeps
reading the folders it names, whatever is published later; ``vacuum`` removes what no kept manifest names.
A version holds several tables and some facts (bounds, marks, records), which change together.

Paths can be in any store that Spark reads and in which renaming a file never replaces another.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFESTS = "_manifests"


class Conflict(Exception):
    """Another writer published the version first."""


def _fs(spark: SparkSession, path: str):
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), Path


def _claim(spark: SparkSession, path: str, content: str) -> bool:
    """Whether this call, and no other, gave ``path`` its content."""
    fs, Path = _fs(spark, path)
    staged = f"{path}.{uuid.uuid4().hex}"
    fs.mkdirs(Path(path).getParent())
    out = fs.create(Path(staged), False)
    out.write(bytearray(content.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        # Renaming replaces on a local disk; a link does not.
        here, there = (str(Path(p).toUri().getPath()) for p in (staged, path))
        try:
            os.link(here, there)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(Path(staged), False)
    if fs.rename(Path(staged), Path(path)):
        return True
    fs.delete(Path(staged), False)
    return False


def versions(spark: SparkSession, root: str) -> list[int]:
    at = f"{root}/{_MANIFESTS}"
    fs, Path = _fs(spark, at)
    if not fs.exists(Path(at)):
        return []
    return sorted(int(n) for s in fs.listStatus(Path(at)) if (n := s.getPath().getName()).isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """{"tables": folder by name, "facts": ...} of a version, the newest by default; empty if there is none."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return {"tables": {}, "facts": {}}
        version = known[-1]
    path = f"{root}/{_MANIFESTS}/{version}"
    fs, Path = _fs(spark, path)
    stream = fs.open(Path(path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(
    tables: DataFrame | dict[str, DataFrame | str], root: str, expected: int | None,
    sort_by: tuple[str, ...] = (), facts: dict | None = None, spark: SparkSession | None = None,
) -> int:
    """Write the next version; ``expected`` is the version that the writer has read (None: none yet).

    A table is a DataFrame, or the folder of an earlier version that stays as it is. Rows are
    range-partitioned and sorted by those of ``sort_by`` that a table has, so that row groups have narrow bounds and a
    range scan skips the rest. Raises Conflict, and leaves nothing, if the version has moved on.
    """
    named = {"": tables} if isinstance(tables, DataFrame) else tables
    spark = spark or next(t for t in named.values() if isinstance(t, DataFrame)).sparkSession
    fs, Path = _fs(spark, root)
    number = 0 if expected is None else expected + 1
    folders, staged = {}, []
    for name, table in named.items():
        if isinstance(table, str):
            folders[name] = table
            continue
        folders[name] = f"data-{uuid.uuid4().hex}"
        staged.append(f"{root}/{folders[name]}")
        by = [c for c in sort_by if c in table.columns]
        out = table.repartitionByRange(*by).sortWithinPartitions(*by) if by else table
        out.write.parquet(staged[-1])
    known = versions(spark, root)
    current = known[-1] if known else None
    claimed = current == expected and _claim(spark, f"{root}/{_MANIFESTS}/{number}", json.dumps({"tables": folders, "facts": facts or {}}))
    if not claimed:
        for path in staged:
            fs.delete(Path(path), True)
        raise Conflict(f"{root} is not at version {expected} any more")
    return number


def read(spark: SparkSession, root: str, version: int | None = None, table: str = "") -> DataFrame:
    found = manifest(spark, root, version)["tables"]
    if table not in found:
        raise FileNotFoundError(f"{root} {table}")
    return spark.read.parquet(f"{root}/{found[table]}")


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[int]:
    """Delete all but the newest ``keep`` versions and the folders that only they name; returns those versions.

    Folders of writers that have not published yet are not named by any version, and stay.
    """
    fs, Path = _fs(spark, root)
    known = versions(spark, root)
    old, kept = known[:-keep], known[-keep:]
    used = {f for v in kept for f in _folders(manifest(spark, root, v))}
    for v in old:
        for folder in _folders(manifest(spark, root, v)) - used:
            fs.delete(Path(f"{root}/{folder}"), True)
        fs.delete(Path(f"{root}/{_MANIFESTS}/{v}"), False)
    return old


def _folders(found: dict) -> set[str]:
    return {*found["tables"].values(), *(s["folder"] for s in found["facts"].get("segments", ()))}


# A log is a versioned list of segments, each with the bounds of seq that still count.


def _log_facts(spark: SparkSession, root: str) -> tuple[int | None, dict]:
    known = versions(spark, root)
    facts = manifest(spark, root, known[-1])["facts"] if known else {}
    return (known[-1] if known else None), {"segments": [], "compacted": 0} | facts


def append_log(log: DataFrame, root: str, bucket: int = 100_000) -> int:
    """Append commands as a segment, partitioned by ranges of seq, so that replay prunes whole ranges."""
    spark = log.sparkSession
    at, facts = _log_facts(spark, root)
    folder = f"segment-{uuid.uuid4().hex}"
    ranged = log.withColumn("seq_range", F.floor(F.col("seq") / bucket))
    ranged.repartition("seq_range").sortWithinPartitions("seq").write.partitionBy("seq_range").parquet(f"{root}/{folder}")
    first, last = log.agg(F.min("seq"), F.max("seq")).first()
    if first is None:
        return -1 if at is None else at
    segment = {"folder": folder, "first": first, "last": last, "bucket": bucket}
    return publish({}, root, at, facts=facts | {"segments": [*facts["segments"], segment]}, spark=spark)


def read_log(spark: SparkSession, root: str, after: int = 0) -> DataFrame:
    """Commands after ``after`` that were neither truncated nor compacted; earlier segments and ranges are not opened."""
    _, facts = _log_facts(spark, root)
    after = max(after, facts["compacted"])
    out = None
    for s in facts["segments"]:
        if s["last"] > after:
            rows = spark.read.parquet(f"{root}/{s['folder']}").where(
                (F.col("seq_range") >= after // s["bucket"]) & (F.col("seq") > after) & (F.col("seq") <= s["last"])
            ).drop("seq_range")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        folders = [s["folder"] for s in facts["segments"]]
        if not folders:
            raise FileNotFoundError(root)
        return spark.read.parquet(f"{root}/{folders[0]}").drop("seq_range").limit(0)
    return out


def truncate_log(spark: SparkSession, root: str, after: int) -> int:
    """Drop the commands after ``after``: a new version in which segments end there. Nothing is rewritten."""
    at, facts = _log_facts(spark, root)
    kept = [s | {"last": min(s["last"], after)} for s in facts["segments"] if s["first"] <= after]
    return publish({}, root, at, facts=facts | {"segments": kept}, spark=spark)


def compact_log(spark: SparkSession, root: str, upto: int) -> int:
    """Drop the commands up to and with ``upto``, once a stored state holds what they did."""
    at, facts = _log_facts(spark, root)
    kept = [s for s in facts["segments"] if s["last"] > upto]
    # One segment stays even if it is used up: its schema is that of the log.
    return publish({}, root, at, facts={"segments": kept or facts["segments"][-1:], "compacted": max(upto, facts["compacted"])}, spark=spark)
