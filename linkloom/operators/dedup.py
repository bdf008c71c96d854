"""Removal of repeated captures: for good, or within a time to live that repeats do not extend.

The time-to-live rule is a chain: the first capture of a key counts, then the first one at least
``ttl`` after the last that counted, and so on. Ordinary keys are folded in one array each. A key
with more captures than ``hot_rows`` is never brought together: time is cut into blocks of one ttl
(each holds at most one kept capture) and each block into cells by the offset inside the block. From
one block to the next a chain's offset can only grow, so inside one (key, cell) column it can be
followed without the rest of the key; where it leaves the column, it enters the next captured cell at
its first capture. Columns are walked in parallel, the chain is then linked over cell entries only
(at most blocks x cells per key, whatever the number of captures), and the visited columns are
walked once more to list what was kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 24 * 3600
HOT_ROWS = 10_000
CELLS = 1440


def permanent_dedup(captures: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """First capture of each key, by a map-side combined aggregate."""
    rest = [c for c in captures.columns if c not in keys]
    return captures.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("row")).select(*keys, "row.*")


def ttl_dedup(captures: DataFrame, keys: list[str], ts: str = "ts", seq: str = "event_id", ttl_seconds: int = DAY,
              hot_rows: int = HOT_ROWS, cells: int = CELLS) -> DataFrame:
    """(keys, ts, seq) of the captures that count."""
    ttl = ttl_seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = captures.select(*keys, us.alias("us"), F.col(seq).alias("seq"))
    hot = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(*keys)
    # null keys are a key like others here, so the comparison is null-safe
    found = reduce(and_, [rows[k].eqNullSafe(hot[k]) for k in keys])
    kept = _fold(rows.join(hot, found, "left_anti"), keys, ttl).unionByName(
        _walk_hot(rows.join(hot, found, "left_semi"), keys, ttl, cells))
    kind = captures.schema[ts].dataType
    return kept.select(*keys, F.timestamp_micros("us").cast(kind).alias(ts), F.col("seq").alias(seq))


def _fold(rows: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Chain of each key over its sorted captures; groups hold at most ``hot_rows`` of them."""
    ordered = F.array_sort(F.collect_list(F.struct("us", "seq")))
    empty = F.array().cast("array<struct<us:bigint,seq:bigint>>")
    start = F.struct(F.lit(None).cast("bigint").alias("until"), empty.alias("kept"))

    def step(state, x):
        free = state["until"].isNull() | (x["us"] >= state["until"])
        return F.when(free, F.struct((x["us"] + ttl).alias("until"), F.concat(state["kept"], F.array(x)).alias("kept"))
                      ).otherwise(state)

    folded = rows.groupBy(*keys).agg(F.aggregate(ordered, start, step)["kept"].alias("kept"))
    return folded.select(*keys, F.inline("kept"))


# ---- hot keys ----------------------------------------------------------------------------------


def _walk_hot(rows: DataFrame, keys: list[str], ttl: int, cells: int) -> DataFrame:
    placed = rows.withColumn("block", F.floor(F.col("us") / F.lit(ttl))).withColumn("off", F.col("us") - F.col("block") * ttl)
    placed = placed.withColumn("cell", F.floor(F.col("off") * cells / F.lit(ttl)))
    placed = placed.select(F.to_json(F.struct(*keys)).alias("_key"), *keys, "cell", "block", "off", "seq")
    order = ["_key", "cell", "block", "off", "seq"]
    columns = placed.select(*order).repartition("_key", "cell").sortWithinPartitions(*order)
    entries = columns.mapInPandas(_column_exits, "_key string, block bigint, cell bigint, exit bigint")
    visited = entries.groupBy("_key").applyInPandas(_linker(cells), "_key string, block bigint, cell bigint")
    marks = visited.select("_key", "cell", "block", F.lit(-1).cast("bigint").alias("off"), F.lit(-1).cast("bigint").alias("seq"))
    again = columns.unionByName(marks).repartition("_key", "cell").sortWithinPartitions(*order)
    kept = again.mapInPandas(_column_kept, "_key string, block bigint, off bigint, seq bigint")
    named = placed.select("_key", *keys).distinct()
    return kept.join(named, "_key").select(*keys, (F.col("block") * ttl + F.col("off")).alias("us"), "seq")


def _records(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in ("_key", "cell", "block", "off", "seq")))


def _column_exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every (key, block, cell) entry: the first block in which a chain begun there finds no capture
    in this cell. State: the offsets that chains hold now, each with the entries they began at."""
    out: list[tuple] = []
    where, block = None, None
    waiting: list[tuple] = []  # (offset, [start blocks]) held in the block before, ascending
    moved: list[tuple] = []  # the same for this block

    def leave(chains, at):
        key, cell = where
        out.extend((key, start, cell, at) for _, starts in chains for start in starts)

    def flush():
        frame = pd.DataFrame(out, columns=["_key", "block", "cell", "exit"])
        out.clear()
        return frame

    for key, cell, b, off, _ in _records(batches):
        if (key, cell) != where or b != block:
            if where is not None:
                leave(waiting, block)
                if (key, cell) != where or b != block + 1:
                    leave(moved, block + 1)
                    moved = []
            waiting, moved = moved, []
            where, block = (key, cell), b
            fresh = [b]
        else:
            fresh = []
        taken = 0
        while taken < len(waiting) and waiting[taken][0] <= off:
            fresh = fresh + waiting[taken][1]
            taken += 1
        if taken:
            waiting = waiting[taken:]
        if fresh:
            moved.append((off, fresh))
        if len(out) > 50_000:
            yield flush()
    if where is not None:
        leave(waiting, block)
        leave(moved, block + 1)
    yield flush()


def _linker(cells: int):
    """Follow one key's chain over its cell entries: a bounded table of blocks x cells rows."""

    def link(entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values(["block", "cell"]).reset_index(drop=True)
        code = (entries["block"] * cells + entries["cell"]).to_numpy()
        target = np.searchsorted(code, (entries["exit"] * cells + entries["cell"] + 1).to_numpy())
        at, seen = 0, []
        while at < len(code):
            seen.append(at)
            at = int(target[at])
        return entries.loc[seen, ["_key", "block", "cell"]]

    return link


def _column_kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """List the captures kept in each column, given marks (off = -1) at the entries the chain takes."""
    out: list[tuple] = []
    where, block, held, enter, done = None, None, None, False, False
    for key, cell, b, off, seq in _records(batches):
        if (key, cell) != where or b != block:
            follows = (key, cell) == where and b == block + 1 and done
            held = held if follows else None
            where, block, enter, done = (key, cell), b, False, False
        if off < 0:
            enter = True
        elif not done and (enter or (held is not None and off >= held)):
            held, done = off, True
            out.append((key, b, off, seq))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["_key", "block", "off", "seq"])
                out.clear()
    yield pd.DataFrame(out, columns=["_key", "block", "off", "seq"])
