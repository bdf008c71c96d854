"""Sliding-log admission of requests, replayed over a whole request log.

A request is admitted if fewer than ``limit`` admitted requests lie in the window before it; refused
ones leave no trace. Time counts in milliseconds. Only the number of requests per key and millisecond
matters for the state, so requests are first counted; and a key's history is cut wherever the state
is known from the counts alone: if two neighbouring window-long blocks hold no more than ``limit``
requests together, all of the later block are admitted whatever came before. The pieces between cuts
are replayed in parallel, each with a queue no longer than ``limit``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import strings


def limit_columns(bucket: Column, limits: dict[str, tuple[int, int]]) -> tuple[Column, Column]:
    """(limit, window in ms) of a bucket."""
    most, span = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for name, (n, seconds) in limits.items():
        most = F.when(bucket == name, F.lit(n)).otherwise(most)
        span = F.when(bucket == name, F.lit(seconds * 1000).cast("bigint")).otherwise(span)
    return most, span


def keyed_requests(requests: DataFrame, limits: dict[str, tuple[int, int]] = strings.RATE_LIMITS,
                   remote: str | None = None) -> DataFrame:
    """(seq, ms, key, most, span) of a request log (event_id, ts, path, x_forwarded_for); key null = exempt."""
    ip = strings.client_ip(F.col("x_forwarded_for"), F.col(remote) if remote else F.lit("0.0.0.0"))
    most, span = limit_columns(strings.rate_bucket(F.col("path")), limits)
    return requests.select(
        F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"),
        strings.rate_key(F.col("path"), ip).alias("key"), most.alias("most"), span.alias("span"))


def replay(keyed: DataFrame) -> DataFrame:
    """(seq, key, allowed, used, reset_at): verdict of every request, exempt ones always allowed."""
    limited = keyed.where(F.col("key").isNotNull())
    moments = limited.groupBy("key", "most", "span", "ms").agg(F.count("*").alias("n")).withColumn(
        "block", F.floor(F.col("ms") / F.col("span")))
    # cuts, from block counts: as many rows per key as there are windows in its time span
    blocks = moments.groupBy("key", "most", "block").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key").orderBy("block")

    def count_at(back: int) -> Column:
        near = F.lit(0)
        for step in (1, 2):
            near = near + F.when(F.lag("block", step).over(w) == F.col("block") - back, F.lag("n", step).over(w)).otherwise(0)
        return near

    cut = (count_at(1) + count_at(2) <= F.col("most")).cast("int")
    pieces = blocks.withColumn("cut", cut).withColumn("piece", F.sum("cut").over(w)).withColumn(
        "opens", (F.lead("cut").over(w) == 1) & (F.lead("block").over(w) == F.col("block") + 1)).select(
        "key", "block", "piece", "opens")
    # the block before a cut is replayed once more, as the known start of the next piece
    own = F.struct("piece", F.lit(False).alias("warm"))
    next_one = F.struct((F.col("piece") + 1).alias("piece"), F.lit(True).alias("warm"))
    roles = F.when(F.coalesce("opens", F.lit(False)), F.array(own, next_one)).otherwise(F.array(own))
    rows = moments.join(pieces, ["key", "block"]).select("key", "most", "span", "ms", "n", F.inline(roles))
    ordered = rows.repartition("key", "piece").sortWithinPartitions("key", "piece", "ms")
    state = ordered.mapInPandas(_replay_pieces, "key string, ms bigint, used int")
    # verdicts: position among the requests of the same millisecond
    place = F.row_number().over(Window.partitionBy("key", "ms").orderBy("seq")) - 1
    judged = limited.withColumn("place", place).join(state, ["key", "ms"])
    used = F.least(F.col("most"), F.col("used") + F.col("place"))
    allowed = F.col("used") + F.col("place") < F.col("most")
    reset = F.when(~allowed, F.floor(F.col("ms") / 1000) + F.floor(F.col("span") / 1000))
    out = judged.select("seq", "key", allowed.alias("allowed"), used.cast("int").alias("used"), reset.alias("reset_at"))
    exempt = keyed.where(F.col("key").isNull()).select(
        "seq", "key", F.lit(True).alias("allowed"), F.lit(0).alias("used"), F.lit(None).cast("bigint").alias("reset_at"))
    return out.unionByName(exempt)


def _replay_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In-window admissions before each (key, millisecond); rows arrive sorted, state is one queue."""
    where, log, used = None, deque(), 0
    for batch in batches:
        out = []
        for key, piece, most, span, ms, n, warm in zip(*(batch[c].tolist() for c in (
                "key", "piece", "most", "span", "ms", "n", "warm"))):
            if (key, piece) != where:
                where, log, used = (key, piece), deque(), 0
            while log and log[0][0] <= ms - span:
                used -= log.popleft()[1]
            if not warm:
                out.append((key, ms, used))
            admitted = min(n, most - used)
            if admitted > 0:
                log.append((ms, admitted))
                used += admitted
        yield pd.DataFrame(out, columns=["key", "ms", "used"])
