"""Quality by ordinal cumulative-link regression on graded ratings.

A document is a sparse vector of hashed words and of hashed traits of its words (how they end, how
long they are, whether they repeat the one before). One shared weight vector gives a score, ordered
thresholds turn it into probabilities of grades: P(grade > k) = sigmoid(score - threshold k). The
expected grade ranks documents; the tail probability of the top grade selects them.

The regression is fitted on a bounded sample of rated rows (``sample`` ids, the first by a hash of
the id, and as many different texts at most); every document is scored whole. A null or empty text has
the bias alone as its features. Ratings that are null or whose document is missing are left out; without
ratings, or with a single grade among them, every document gets the same score. Rows that repeat an id
keep a row each; of an id's several ratings the lowest counts, and equal texts are one example with the
lowest of their grades, so the model depends on the rows alone and not on how they are dealt out.
Without documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm._text import mix, slices, utf8, word_hashes

_BITS = 18
_TRAITS = 64


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by bin: hashed words, then traits
    thresholds: np.ndarray


def _features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins and values of each text: words by presence, traits by their share of the words."""
    base = 1 << _BITS
    raws = [utf8(t) for t in texts]
    for raw, words in zip(raws, word_hashes([r.translate(_BARE) for r in raws]), strict=True):
        n = len(words)
        if not n:
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        bins, counts = np.unique((mix(words) >> np.uint64(64 - _BITS)).astype(np.int64), return_counts=True)
        same = np.count_nonzero(words[1:] == words[:-1]) / n
        most = counts.max() / n
        kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) / len(raw)
        traits = np.concatenate([[same, most, len(bins) / n], kinds])
        yield np.concatenate([bins, base + np.arange(len(traits))]), np.concatenate([np.ones(len(bins)), 3 * traits])


# Letters, other bytes of letters, digits, blanks, common marks, and the rest.
_KIND = np.full(256, 5, np.uint8)
_KIND[128:] = 1
for _c in range(128):
    if chr(_c).isalpha():
        _KIND[_c] = 0
    elif chr(_c).isdigit():
        _KIND[_c] = 2
    elif chr(_c).isspace():
        _KIND[_c] = 3
    elif chr(_c) in ".,;:!?'\"-()":
        _KIND[_c] = 4
# Bytes of words as they are, marks and digits as blanks.
_BARE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def grade(quality: Column, toxic: Column) -> Column:
    """Ratings on one scale: 0 toxic, 1 poor, 2 good; null if a rating is.

    Toxic words add up without bound, so what has them belongs at an end of the scale.
    """
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def fit(docs: DataFrame, ratings: DataFrame, sample: int = 6000, rounds: int = 300, decay: float = 1e-4, least_z: float = 3.5) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade from 0)."""
    size = (1 << _BITS) + _TRAITS
    rated = ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = list(_features(frame["text"].tolist()))
            yield pd.DataFrame(
                {"copy": frame["copy"], "grade": frame["grade"], "bins": [b for b, _ in found], "x": [x for _, x in found]}
            )

    examples = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.coalesce(F.sha2("text", 256), F.lit("")).alias("copy"))
        .agg(F.min("grade").cast("int").alias("grade"), F.min("text").alias("text")).orderBy("copy").limit(sample)
    )
    # At most ``sample`` rows on both sides of this line.
    got = examples.mapInPandas(sparse, "copy string, grade int, bins array<int>, x array<float>").toPandas().sort_values("copy")
    y = got["grade"].to_numpy(np.int64)
    top = int(y.max()) if len(y) else 0
    if len(np.unique(y)) < 2:
        return Model(np.zeros(size, np.float32), np.linspace(-1, 0, max(top, 1)))
    row = np.repeat(np.arange(len(y)), [len(b) for b in got["bins"]])
    bins, x = np.concatenate(got["bins"].to_list()).astype(np.int64), np.concatenate(got["x"].to_list()).astype(np.float64)
    # Words enter if documents with them are graded unlike the rest, beyond what chance gives many words.
    df = np.bincount(bins, minlength=size)
    mean = np.bincount(bins, y[row], size) / np.maximum(df, 1)
    z = np.abs(mean - y.mean()) * np.sqrt(df) / max(y.std(), 1e-9)
    enters = (df >= 5) & (z >= least_z)
    enters[1 << _BITS :] = True
    keep = enters[bins]
    row, bins, x = row[keep], bins[keep], x[keep]
    cuts = np.array([np.log((np.sum(y <= k) + 1) / (np.sum(y > k) + 1)) for k in range(top)])
    w, m, v = np.zeros(size), np.zeros(size + top), np.zeros(size + top)
    for t in range(1, rounds + 1):
        score = np.bincount(row, w[bins] * x, len(y))
        above = np.column_stack([np.ones(len(y)), _sigmoid(score[:, None] - cuts), np.zeros(len(y))])
        i = np.arange(len(y))
        p = np.maximum(above[i, y] - above[i, y + 1], 1e-9)
        slope = above * (1 - above)
        d_score = (slope[i, y] - slope[i, y + 1]) / p
        d_cuts = np.array([np.sum(np.where(y == k, slope[:, k + 1], 0) / p - np.where(y == k + 1, slope[:, k + 1], 0) / p) for k in range(top)])
        g = np.concatenate([np.bincount(bins, d_score[row] * x, size) / len(y) - decay * w, d_cuts / len(y)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w += step[:size]
        cuts = np.maximum.accumulate(cuts + step[size:])
    return Model(w.astype(np.float32), cuts)


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability of the top grade, selected) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = np.array([float(model.weights[b] @ x) for b, x in _features(batch.column("text").to_pylist())])
            above = _sigmoid(s[:, None] - model.thresholds)
            tail = np.round(above[:, -1], 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.round(above.sum(1), 6)), pa.array(tail), pa.array(tail >= least)],
                ["doc_id", "expected_grade", "tail_probability", "selected"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {id_type}, expected_grade double, tail_probability double, selected boolean"
    )
