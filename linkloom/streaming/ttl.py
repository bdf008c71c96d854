"""Deduplication with a time to live as a state processor: rows are taken as they come, however many a key has.

A key's rows wait in the state store, in parts that follow the batches they came in and in cells of event time, until the
watermark has passed their cell; then the cell is judged in the order of time, so the answer does not depend on the order of
arrival. A key's first FEW waiting rows are kept in one value, as most keys have no more and every call of the state store is
a message; beyond that no list of a key's rows is built but that of one cell and one batch. A timer stands at the end of the next cell and, when
none is left, at the end of the key's last window, where its state is removed.

State lies in RocksDB (``use_state_store``); rows behind the watermark are dropped by Spark and counted in the query progress.
A row is answered once the watermark has passed it: what comes last waits for later rows to move the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkloom.operators.dedup import DAY

FEW = 1000  # waiting rows of a key that are kept in one value
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State processors need a store with several values per key; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class FirstOfWindow(StatefulProcessor):
    """Verdict ``kept`` for the first row of each window of ``ttl`` microseconds, ``repeat`` for the others."""

    def __init__(self, keys: list[str], ttl: int, cell: int, few: int = FEW):
        self.keys, self.ttl, self.cell, self.most = keys, ttl, cell, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until bigint")
        self.few = handle.getValueState("few", "us array<bigint>, seq array<bigint>")
        self.parts = handle.getValueState("parts", "n bigint")
        self.waiting = handle.getMapState("waiting", "cell bigint, part bigint", "us array<bigint>, seq array<bigint>")

    def end(self, cell: int) -> int:
        return (cell + 1) * self.cell // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, few, grown = None, self.few.get() or ([], []), False
        for frame in rows:
            us, seq = frame["us"].to_numpy(), frame["seq"].to_numpy()
            least = int(us.min()) // self.cell
            first = least if first is None else min(first, least)
            if len(few[0]) + len(us) <= self.most:
                few, grown = ([*few[0], *us.tolist()], [*few[1], *seq.tolist()]), True
                continue
            part = (self.parts.get() or (0,))[0]
            self.parts.update((part + 1,))
            for cell, some in frame.groupby(us // self.cell):
                self.waiting.updateValue((int(cell), part), (some["us"].tolist(), some["seq"].tolist()))
        if grown:
            self.few.update(few)
        if first is not None:
            self.handle.registerTimer(self.end(first))
        return iter(())

    def judged(self, key, us, seq, until) -> tuple[int, pd.DataFrame]:
        us, seq = np.array(us, np.int64), np.array(seq, np.int64)
        order = np.lexsort((seq, us))
        us, seq = us[order], seq[order]
        verdict = np.full(len(us), "repeat", object)
        at = 0 if until is None else int(np.searchsorted(us, until))
        while at < len(us):
            verdict[at] = "kept"
            until = int(us[at]) + self.ttl
            at = int(np.searchsorted(us, until))
        own = {name: [key[place]] * len(us) for place, name in enumerate(self.keys)}
        return until, pd.DataFrame({**own, "us": us, "seq": seq, "verdict": verdict})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        parts: dict[int, list[int]] = {}
        if self.parts.exists():
            for cell, part in self.waiting.keys():
                parts.setdefault(cell, []).append(part)
        few = self.few.get() or ([], [])
        cells = np.array(few[0], np.int64) // self.cell
        until = (self.until.get() or (None,))[0]
        ready = [c for c in sorted({*parts, *cells.tolist()}) if self.end(c) <= watermark]
        # cell by cell where parts wait; the few rows of an ordinary key all at once
        for some in [[c] for c in ready] if parts else [ready] if ready else []:
            places = np.flatnonzero(np.isin(cells, some)).tolist()
            us, seq = [few[0][i] for i in places], [few[1][i] for i in places]
            for cell in some:
                for part in parts.pop(cell, ()):
                    more = self.waiting.getValue((cell, part))
                    us += more[0]
                    seq += more[1]
                    self.waiting.removeKey((cell, part))
            until, frame = self.judged(key, us, seq, until)
            yield frame
        left = np.flatnonzero(~np.isin(cells, ready)).tolist()
        if ready:
            self.until.update((until,))
            if left:
                self.few.update(([few[0][i] for i in left], [few[1][i] for i in left]))
            elif len(cells):
                self.few.clear()
        if left or parts:
            self.handle.registerTimer(self.end(min([*parts, *cells[left].tolist()])))
        elif until is None or until // 1000 <= watermark:
            self.until.clear()
            self.parts.clear()
        else:
            self.handle.registerTimer(until // 1000 + 1)

    def close(self) -> None:
        pass


def ttl_dedup_processor(captures: DataFrame, keys: list[str], ts: str = "ts", seq: str = "event_id", ttl_seconds: int = DAY,
                        delay: str = "1 hour", cell_seconds: int = 60, few: int = FEW) -> DataFrame:
    """(keys, us, seq, verdict) of every capture that the watermark has passed; ``seq`` is a whole number and breaks ties."""
    rows = captures.select(*keys, F.col(ts).cast("timestamp").alias("at"), F.col(seq).cast("long").alias("seq"))
    rows = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", delay)
    fields = ", ".join(f"`{k}` {captures.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(
        FirstOfWindow(keys, ttl_seconds * 1_000_000, cell_seconds * 1_000_000, few),
        f"{fields}, us bigint, seq bigint, verdict string", "Append", "EventTime")
