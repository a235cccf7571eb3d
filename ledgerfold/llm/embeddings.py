"""Embedding near-duplicates by one navigable small-world graph for each shard.

Equal vectors form a class and are indexed once. Vectors are dealt to shards by a hash; every shard
has its own graph, and every vector is searched in every shard. In each task an audit compares some
queries with brute force over the shard and doubles the beam until recall passes; beams that are full of
links widen by themselves, so no number of partners is cut off. Links are verified by cosine in
double precision, and components are unions of links. A task gives no pairs: it counts the links of each
query and unites what it has linked, so its result has a row for each vector at most, however large a
group is.

A graph is one row of bytes and the vectors are packed into blocks of queries. Tasks read both from the
shared folder and take one graph and one block at a time, so neither is shuffled, and a task holds as much
of a large table as of a small one. A shard grows to ``shard_rows`` vectors or ``shard_bytes`` of single-precision
components before there are more than the least number of shards, a block to ``part_rows`` or ``shard_bytes``.

A vector that is null, empty or zero, or holds null or non-finite components links with nothing;
vectors of different lengths do not link. Repeated rows count as vectors of their own, also where
an id comes with several vectors. Rows without
an id link with nothing and are components of no id. Without rows the result is empty. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ledgerfold.llm import _hnsw
from ledgerfold.llm._store import connected_components, materialize, small_batches

#: A vector's similarity in single precision may be off by less than this.
_SLACK = 1e-4
#: Components that are held in double precision at once.
_DOUBLES = 1 << 19


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of an array."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _doubles(raw: np.ndarray) -> np.ndarray:
    """Vectors in double precision, by a power of two small enough that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions in single precision, and lengths of ``_doubles``."""
    x, norm, step = np.empty(raw.shape, np.float32), np.empty(len(raw)), max(1, _DOUBLES // raw.shape[1])
    for at in range(0, len(raw), step):
        part = _doubles(raw[at : at + step])
        norm[at : at + step] = np.sqrt(np.einsum("kd,kd->k", part, part))
        x[at : at + step] = part / norm[at : at + step, None]
    return x, norm


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the smallest of a component) after a and b, pairwise, have been united."""
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _bytes(array: np.ndarray) -> pa.Array:
    """One binary value that is the array's memory."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, array.nbytes], np.int32)), pa.py_buffer(np.ascontiguousarray(array))])


def links(
    vectors: DataFrame, cosine: float, width: int, recall: float, audited: int, shard_rows: int, part_rows: int, shard_bytes: int = 16 << 20
) -> DataFrame:
    """(key, root, links) of (key, dim, embedding, n) rows: ``links`` sums up the ``n`` of partners whose cosine is
    ``cosine`` or more, and ``root`` is a vector that links connect with ``key``. Several rows may tell of a key."""
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = np.dtype(np.float32 if single else np.float64)
    vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<float>" if single else "array<double>"))
    n, size = vectors.agg(F.count("*"), F.coalesce(4 * F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    shards, parts = max(8, -(-n // shard_rows), -(-size // shard_bytes)), max(1, -(-n // part_rows), -(-size // shard_bytes))
    shard, part = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)).cast("int")

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        raw = _matrix(table["embedding"])
        levels = [_bytes(a) for a in _hnsw.build(_unit(raw)[0])]
        ends = pa.array([0, len(levels)], pa.int32())
        return pa.table(
            {
                "shard": table["shard"][:1], "dim": table["dim"][:1], "keys": _bytes(table["key"].to_numpy()), "n": _bytes(table["n"].to_numpy()),
                "held": _bytes(raw), "levels": pa.ListArray.from_arrays(ends, pa.concat_arrays(levels)),
            }
        )

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        return pa.table({"dim": table["dim"][:1], "asked": _bytes(table["key"].to_numpy()), "raw": _bytes(_matrix(table["embedding"]))})

    # A row group for each row: neither readers nor writers hold more than one graph.
    alone = {"compression": "none", "parquet.block.row.count.limit": "1"}
    built = vectors.withColumn("shard", shard).groupBy("shard", "dim").applyInArrow(
        index, "shard int, dim int, keys binary, n binary, held binary, levels array<binary>"
    )
    packed = vectors.drop("n").withColumn("part", part).groupBy("part", "dim").applyInArrow(block, "dim int, asked binary, raw binary")
    graphs, blocks = materialize(built, "graphs", **alone), materialize(packed, "blocks", **alone)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = x = norm = None
        least = np.float32(cosine - _SLACK)
        for batch, at in ((b, k) for b in batches for k in range(b.num_rows)):
            shard, dim = batch["shard"][at].as_py(), batch["dim"][at].as_py()
            array = lambda name, dtype: np.frombuffer(batch[name][at].as_buffer(), dtype)  # noqa: B023, E731
            keys, weight, held = array("keys", np.int64), array("n", np.int64), array("held", kind).reshape(-1, dim)
            lists = [np.frombuffer(a.as_buffer(), np.int32) for a in batch["levels"][at].values]
            levels = [a.reshape(-1, 2 * _hnsw.LINKS + _hnsw.SPARE if k == 0 else _hnsw.LINKS) for k, a in enumerate(lists)]
            if last != (shard, dim):
                x = norm = None
                last, (x, norm) = (shard, dim), _unit(held)
            q_keys, raw = array("asked", np.int64), array("raw", kind).reshape(-1, dim)
            q, q_norm = _unit(raw)
            sample = np.unique(np.linspace(0, len(q) - 1, min(audited, len(q))).astype(np.int64))
            # A vector's match with itself tells nothing, and a query of few links counts like one of many.
            true = (q[sample] @ x.T >= least) & (q_keys[sample][:, None] != keys[None])
            now = width
            while now < len(x):
                got = np.zeros(len(sample), np.int64)
                for r, c in _hnsw.search(x, levels, q[sample], now, least):
                    got += np.bincount(r[true[r, c]], minlength=len(sample))
                if (got >= recall * true.sum(1)).all():
                    break
                now = 2 * now if 32 * now < len(x) else len(x)
            every = np.concatenate([q_keys, keys])
            count, root, linked = np.zeros(len(every), np.int64), np.arange(len(every)), np.zeros(len(every), bool)
            step = max(1, _DOUBLES // dim)
            for r, c in _hnsw.search(x, levels, q, now, least):
                other = keys[c] != q_keys[r]
                r, c = r[other], c[other]
                good = np.zeros(len(r), bool)
                for k in range(0, len(r), step):
                    u, v = r[k : k + step], c[k : k + step]
                    good[k : k + step] = np.einsum("kd,kd->k", _doubles(raw[u]), _doubles(held[v])) / (q_norm[u] * norm[v]) >= cosine
                r, c = r[good], c[good]
                np.add.at(count, r, weight[c])
                root = _united(root, r, len(q) + c)
                linked[r] = linked[len(q) + c] = True
            of = np.flatnonzero(linked)
            yield pa.record_batch({"key": every[of], "root": every[root[of]], "links": count[of]})

    # Every graph meets every block of its length; a batch is one pair of them.
    pairs = graphs.hint("shuffle_replicate_nl").join(blocks, "dim")
    with small_batches(spark, 1):
        return materialize(pairs.mapInArrow(find, "key long, root long, links long"), "links")


def near_duplicates(
    rows: DataFrame, cosine: float = 0.95, width: int = 48, recall: float = 0.99, audited: int = 64,
    shard_rows: int = 100_000, part_rows: int = 8192, shard_bytes: int = 16 << 20,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding)."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.exists("embedding", lambda v: v != 0) & ~bad & F.col("vec_id").isNotNull()
    same = F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256)
    own = materialize(rows.select("vec_id", "embedding", F.when(good, same).alias("class")), "vectors")
    classes = own.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("embedding").alias("embedding")
    )
    # Each class is named by 56 bits of its digest and its place among the classes that have the same.
    bits = F.conv(F.substring("class", 1, 14), 16, 10).cast("long")
    place = F.row_number().over(Window.partitionBy(F.substring("class", 1, 14)).orderBy("class")) - 1
    classes = materialize(classes.withColumn("key", F.shiftleft(bits, 6) + place), "classes")
    vectors = classes.select("key", F.size("embedding").alias("dim"), "embedding", "n")
    found = links(vectors, cosine, width, recall, audited, shard_rows, part_rows, shard_bytes)
    partners = found.groupBy("key").agg(F.sum("links").alias("others"))
    joined = connected_components(found, "key", "root")
    named = materialize(
        classes.select("class", "key", "first", "n").join(joined.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key")),
        "class-components",
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = (
        named.join(partners, "key", "left").join(smallest, "component")
        .select("class", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    )
    out = own.select("vec_id", "class").join(by_class, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
