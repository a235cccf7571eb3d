"""Exactly-once sessions and abandoned locks over streams of commands."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "idx long, client string, seq long, cmd string, verdict string"
_STATE = "last_seq long, last_cmd string"


def _judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_seq, last_cmd = state.get if state.exists else (None, None)
    # A micro-batch of one client; the stream's maxFilesPerTrigger or the like bounds it.
    rows = pd.concat(list(frames)).sort_values("idx")
    verdicts = []
    for seq, cmd in zip(rows["seq"], rows["cmd"], strict=True):
        if last_seq is None or seq > last_seq:
            verdicts.append("applied")
            last_seq, last_cmd = int(seq), cmd
        elif seq < last_seq:
            verdicts.append("stale")
        else:
            verdicts.append("replayed" if cmd == last_cmd else "reused")
    state.update((last_seq, last_cmd))
    yield rows.assign(client=key[0], verdict=verdicts)[["idx", "client", "seq", "cmd", "verdict"]]


def session_verdicts(commands: DataFrame) -> DataFrame:
    """(idx, client, seq, cmd, verdict) of a stream of (idx, client, seq, cmd).

    State is the last number and command of each client; a command older than that is stale, as is one
    that arrives late. Commands without a client are applied and keep no state.
    """
    typed = commands.select(F.col("idx").cast("long"), F.col("client").cast("string"), F.col("seq").cast("long"), "cmd")
    named = typed.where(F.coalesce("client", F.lit("")) != "")
    judged = named.groupBy("client").applyInPandasWithState(_judge, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    rest = typed.where(F.coalesce("client", F.lit("")) == "").withColumn("verdict", F.lit("applied"))
    return judged.unionByName(rest)


def distinct_commands(commands: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Commands without the repeats that come within the watermark; state is bounded, verdicts are not given."""
    stamped = commands.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.dropDuplicatesWithinWatermark(["client", "seq"])


_NONE = pd.DataFrame({"key": pd.Series([], dtype=str), "txid": pd.Series([], dtype="int64"), "locked_at": pd.Series([], dtype="int64")})


def _expire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, wait = (dict(json.loads(state.get[0])), state.get[1]) if state.exists else ({}, 0)
    if state.hasTimedOut:
        over = {t: at for t, at in held.items() if at + wait <= state.getCurrentWatermarkMs()}
    else:
        over = {}
        rows = pd.concat(list(frames))
        wait = int(rows["wait_ms"].iloc[0])
        # Of what happens at one moment, locks come first.
        for r in rows.sort_values(["ts", "event", "txid"], kind="stable").itertuples():
            if r.event == "lock":
                held[str(r.txid)] = int(r.ts.timestamp() * 1000)
            else:
                held.pop(str(r.txid), None)
    left = {t: at for t, at in held.items() if t not in over}
    if left:
        state.update((json.dumps(sorted(left.items())), wait))
        state.setTimeoutTimestamp(max(min(left.values()) + wait, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if over:
        yield pd.DataFrame({"key": key[0], "txid": [int(t) for t in over], "locked_at": list(over.values())})
    else:
        yield _NONE


def abandoned_locks(events: DataFrame, wait_ms: int = 300, delay: str = "1 second") -> DataFrame:
    """Locks (key, txid, locked_at) that no release followed in event time: their transactions may be rolled back.

    ``events`` is a stream of (ts, key, txid, event), event being lock or release. A key may have locks of several
    transactions; each is released or times out by itself.
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("wait_ms", F.lit(wait_ms))
    return stamped.groupBy("key").applyInPandasWithState(
        _expire, "key string, txid long, locked_at long", "held string, wait_ms long", "append", GroupStateTimeout.EventTimeTimeout
    )
