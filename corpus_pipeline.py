"""From raw documents to shards: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. ``run`` writes every stage's result to the shared folder and reads
it back, so a lost executor costs one stage at most. Results are lazy; write one before calling the
next stage, which deletes the intermediate tables of the one before, unless its own documents are read from them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.llm import decontamination, jaccard, langid, mixing, sharding
from ledgerfold.llm._store import discard_but_for, materialize, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage that ran last.
_LEFT: list[str] = []


def _in_turn(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = discard_but_for(docs, _LEFT)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return call


@_in_turn
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an accepted language; the others go."""
    return langid.keep_accepted(docs, langid.fit(docs))


@_in_turn
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of five-word Jaccard 0.8 or more."""
    return jaccard.keep_one(docs)


@_in_turn
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_in_turn
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; a source above its size repeats, one below gives a part."""
    return mixing.mix(docs)


@_in_turn
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of 8 and slot; equal texts share a shard."""
    return sharding.assign(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Trigram scores and hashed shingles have no form in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    out = STAGES[-1][1](spark, docs, sf_dir)
    _LEFT.clear()  # the last result is the caller's to write, whatever runs next
    return out
