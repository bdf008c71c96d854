"""Streaming forms of deduplication and admission.

State is per key and small. Rows are taken in time order inside a batch; a row older than one of its
key already judged is answered 'late' and changes nothing. State is released by event time only: once the
watermark has passed the end of its window, however long a stall or backlog lasts. Spark drops rows behind
the watermark and counts them in the query progress, so its delay is the caller's to choose.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.operators.dedup import DAY


def permanent_dedup_stream(captures: DataFrame, keys: list[str]) -> DataFrame:
    """First arrival of each key, for good."""
    return captures.dropDuplicates(keys)


def _sorted(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    frames = list(batches)
    rows = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=columns)
    return rows.sort_values(columns, kind="stable")


def ttl_dedup_stream(captures: DataFrame, keys: list[str], ts: str = "ts", seq: str = "event_id",
                     ttl_seconds: int = DAY, delay: str = "1 hour") -> DataFrame:
    """(keys, us, seq, verdict) with verdict kept, repeat or late, for every capture not behind the watermark."""
    ttl = ttl_seconds * 1_000_000
    rows = captures.select(*keys, F.col(ts).cast("timestamp").alias("at"), F.col(seq).alias("seq"))
    rows = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", delay)
    fields = ", ".join(f"{k} {captures.schema[k].dataType.simpleString()}" for k in keys)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # plain arrays: sorting a frame of a few rows would cost more than all the rest
        frames = list(batches)
        us, seqs = (np.concatenate([f[c].to_numpy() for f in frames] or [np.empty(0, np.int64)]) for c in ("us", "seq"))
        order = np.lexsort((seqs, us))
        us, seqs = us[order], seqs[order]
        until, seen = state.get if state.exists else (None, None)
        verdict = np.full(len(us), "repeat", dtype=object)
        start = 0
        if seen is not None:
            start = int(np.searchsorted(us, seen))
            verdict[:start] = "late"
        at = start if until is None else max(start, int(np.searchsorted(us, until)))
        while at < len(us):
            verdict[at] = "kept"
            until = int(us[at]) + ttl
            at = int(np.searchsorted(us, until))
        if len(us):
            state.update((until, max(int(us[-1]), seen if seen is not None else int(us[-1]))))
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs()) + 1)
        own = {name: [key[position]] * len(us) for position, name in enumerate(keys)}
        yield pd.DataFrame({**own, "us": us, "seq": seqs, "verdict": verdict})

    return rows.groupBy(*keys).applyInPandasWithState(
        judge, f"{fields}, us bigint, seq bigint, verdict string", "until bigint, seen bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(keyed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(seq, key, allowed, used, reset_at, late) of keyed requests (seq, ms, key, most, span); see ratelimit.

    Exempt requests (null key) are allowed.
    """
    timed = keyed.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", delay)
    rows = timed.where(F.col("key").isNotNull())
    free = timed.where(F.col("key").isNull()).select(
        "seq", "key", F.lit(True).alias("allowed"), F.lit(0).alias("used"),
        F.lit(None).cast("bigint").alias("reset_at"), F.lit(False).alias("late"))

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _sorted(batches, ["ms", "seq"])
        log, seen = state.get if state.exists else ([], None)
        log, out, span = deque(log), [], 0
        for seq, ms, most, span in zip(*(rows[c].tolist() for c in ("seq", "ms", "most", "span"))):
            if seen is not None and ms < seen:
                out.append((seq, key[0], None, None, None, True))
                continue
            seen = ms
            while log and log[0] <= ms - span:
                log.popleft()
            used = len(log)
            if used < most:
                log.append(ms)
            out.append((seq, key[0], used < most, used, None if used < most else ms // 1000 + span // 1000, False))
        if out:
            state.update((list(log), seen))
            state.setTimeoutTimestamp(max(seen + int(span), state.getCurrentWatermarkMs()) + 1)
        frame = pd.DataFrame(out, columns=["seq", "key", "allowed", "used", "reset_at", "late"])
        yield frame.astype({"used": "Int32", "reset_at": "Int64", "allowed": "boolean"})

    judged = rows.groupBy("key").applyInPandasWithState(
        judge, "seq bigint, key string, allowed boolean, used int, reset_at bigint, late boolean",
        "log array<bigint>, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return judged.unionByName(free)
