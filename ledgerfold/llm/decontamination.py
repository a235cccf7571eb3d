"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at six words of at most eleven and ignore the rest, so a passage with single words
replaced still agrees with the test item under some mask at some place. The masks were searched for so
that every way of replacing three of 15 words, or fewer of fewer, leaves a hit. Hashes of test items are
joined with hashes of documents; around each hit the words are compared along the diagonal, and the
best run that starts and ends with equal words and keeps ``identity`` of them counts as overlap.

A bitmap of fixed largest size, made of all test hashes, is the only thing broadcast: it drops
document windows that can match nothing, and what passes it goes to an ordinary equi-join, which is
right for a test set of any size. A passage that a third of all documents share adds hits in
proportion to those documents, never pairs of documents.

Words further than ``around`` from every hit are not compared: parts of a passage that lie further apart
than twice that, with no hit between them, count as passages of their own. Items of under ``least_words``
words, down to ``fewest``, have to be found whole and unchanged; shorter ones overlap with nothing, as do
null and empty texts. Very long texts are read whole. Rows that repeat a document id are separate documents
with one id, and their findings are merged; the same for items. Ids may be of any type, and null. Without
documents or items the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerfold.llm._store import materialize, small_batches, spread_join
from ledgerfold.llm._text import mix, slices, word_hashes

#: Positions that a mask looks at.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 5, 6, 8), (0, 1, 3, 7, 9, 10))
SPAN = 1 + max(map(max, MASKS))
_LARGEST_BITMAP = 1 << 27
_SALT = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (len(MASKS), 6), np.uint64) | np.uint64(1)


def _windows(words: np.ndarray) -> list[np.ndarray]:
    """Hashes by mask of every place where the mask fits into the words."""
    out = []
    for mask, salt in zip(MASKS, _SALT, strict=True):
        n = max(0, len(words) - max(mask))
        h = np.full(n, salt[0], np.uint64)
        for at, s in zip(mask, salt, strict=True):
            h += words[at : at + n] * s
        out.append(mix(h))
    return out


def _test_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column("item_id").to_pylist(), [[], [], []]
        for item, words in zip(ids, word_hashes(batch.column("text").to_pylist()), strict=True):
            for h in _windows(words):
                rows[0] += [item] * len(h)
                rows[1] += range(len(h))
                rows[2] += h.view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], batch.column("item_id").type), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())],
            ["item_id", "item_at", "hash"],
        )


def _bitmap(tests: DataFrame) -> np.ndarray:
    """Two bits for each test hash, in 64-bit words; at most _LARGEST_BITMAP bits."""
    n = tests.count()
    bits = 1 << 16
    while bits < min(1024 * n, _LARGEST_BITMAP):
        bits *= 2
    low = F.expr(f"hash & {bits - 1}")
    high = F.expr(f"shiftrightunsigned(hash, 32) & {bits - 1}")
    words = (
        tests.select(F.explode(F.array(low, high)).alias("bit"))
        .groupBy(F.expr("cast(shiftright(bit, 6) as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may be test hashes."""
    top, one = np.uint64(len(bitmap) * 64 - 1), np.uint64(1)
    at = h & top
    found = np.flatnonzero(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & one)
    at = (h[found] >> np.uint64(32)) & top
    return found[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & one).astype(bool)]


def _document_hits(bitmap: np.ndarray, id_type: pa.DataType, around: int):
    schema = pa.schema(
        [("doc_id", id_type), ("start", pa.int32()), ("words", pa.list_(pa.int64())),
         ("hits", pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64())])))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, words in zip(batch.column("doc_id").to_pylist(), word_hashes(batch.column("text").to_pylist()), strict=True):
                got = [(at, h[at]) for h in _windows(words) if len(at := _in_bitmap(bitmap, h))]
                if not got:
                    continue
                at = np.concatenate([a for a, _ in got])
                hashes = np.concatenate([h for _, h in got])
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                # Hits whose surroundings meet form one stretch.
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * around) + 1):
                    first = max(0, at[part[0]] - around)
                    stretch = words[first : at[part[-1]] + SPAN + around]
                    hits = [{"at": int(a), "hash": int(h)} for a, h in zip(at[part], hashes[part].view(np.int64), strict=True)]
                    rows.append({"doc_id": doc, "start": int(first), "words": stretch.view(np.int64), "hits": hits})
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return work


def _overlap(equal: np.ndarray, identity: float) -> tuple[int, int, int]:
    """Of runs that start and end equal and keep ``identity``, the most equal words: (equal, first, length)."""
    at = np.flatnonzero(equal)
    best = (0, 0, 0)
    if len(at):
        # Run i..j of equal places is good if (j - i + 1) >= identity * (at[j] - at[i] + 1).
        gain = np.arange(len(at)) - identity * at
        lowest = np.minimum.accumulate(gain)
        for j in range(len(at)):
            i = int(np.searchsorted(-lowest[: j + 1], -(gain[j] + 1 - identity + 1e-9)))
            while i <= j and gain[i] > gain[j] + 1 - identity + 1e-9:
                i += 1
            if j - i + 1 > best[0]:
                best = (j - i + 1, int(at[i]), int(at[j] - at[i] + 1))
    return best


def _verify(identity: float, id_type: pa.DataType, item_type: pa.DataType):
    schema = pa.schema(
        [("doc_id", id_type), ("item_id", item_type), ("same_words", pa.int32()), ("length", pa.int32()), ("doc_at", pa.int32()), ("item_at", pa.int32()), ("item_words", pa.int32())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "item_id", "shift")]
            for k, (doc, start, item, shift) in enumerate(zip(*columns, strict=True)):
                text = np.asarray(batch.column("words")[k].values)
                test = np.asarray(batch.column("item_words")[k].values)
                # Place p of the item lies at p + shift of the document.
                low, high = max(0, start - shift), min(len(test), start + len(text) - shift)
                equal = test[low:high] == text[low + shift - start : high + shift - start]
                n, at, length = _overlap(equal, identity)
                rows.append([doc, item, n, length, low + at + shift, low + at, len(test)])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return work


def overlaps(docs: DataFrame, tests: DataFrame, least_words: int = 12, identity: float = 0.8, fewest: int = 10, around: int = 32) -> DataFrame:
    """The best overlap of each document with each test item: one row for each such pair.

    ``docs`` has doc_id and text, ``tests`` item_id and text. An overlap has ``least_words`` equal
    words. Columns: doc_id, item_id, same_words, length, doc_at, item_at, item_words.
    """
    item_type = tests.schema["item_id"].dataType.simpleString()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    doc_arrow, item_arrow = (to_arrow_type(df.schema[c].dataType) for df, c in ((docs, "doc_id"), (tests, "item_id")))
    tests = tests.select("item_id", "text")
    hashes = materialize(tests.mapInArrow(_test_hashes, f"item_id {item_type}, item_at int, hash long").distinct(), "test-hashes")
    bitmap = _bitmap(hashes)
    found = docs.select("doc_id", "text").mapInArrow(
        _document_hits(bitmap, doc_arrow, around),
        f"doc_id {id_type}, start int, words array<long>, hits array<struct<at:int,hash:long>>",
    )
    with small_batches(docs.sparkSession):
        stretches = materialize(found.withColumn("stretch", F.xxhash64("doc_id", "start", "words")), "stretches")
    hits = stretches.select("stretch", F.explode("hits").alias("h")).select("stretch", "h.at", "h.hash")
    # A passage that many documents share is a few hot hashes.
    met = spread_join(hits, hashes, "hash", "stretch").where("item_at is not null")
    lines = met.select("stretch", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.view(np.int64) for w in word_hashes(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.int64()))], ["item_id", "item_words"])

    items = tests.mapInArrow(words_of, f"item_id {item_type}, item_words array<long>")
    to_check = lines.join(items, "item_id").join(stretches.drop("hits"), "stretch")
    checked = to_check.select("doc_id", "start", "words", "item_id", "item_words", "shift").mapInArrow(
        _verify(identity, doc_arrow, item_arrow),
        f"doc_id {id_type}, item_id {item_type}, same_words int, length int, doc_at int, item_at int, item_words int",
    )
    rest = ("same_words", "length", "doc_at", "item_at", "item_words")
    best = F.min_by(F.struct(*rest), F.struct(-F.col("same_words"), "length", "doc_at", "item_at"))
    whole = (F.col("item_words") < least_words) & (F.col("item_words") >= fewest) & (F.col("same_words") == F.col("item_words"))
    return (
        checked.where((F.col("same_words") >= least_words) | whole).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
    )


def clean(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents that overlap with no test item; those without an id stay."""
    found = materialize(overlaps(docs, tests, **options).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
