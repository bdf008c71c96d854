"""Event-time counts on a stream: rows per 15-second slot.

Sliding rates are taken from these rows with metrics.sliding_from_slots. In append mode a slot comes once, when the
watermark closes it; in update mode every batch gives the slots it changed, the last ones too, and the largest count of
a slot is its final one. Events later than the watermark are counted by Spark as dropped rows
(numRowsDroppedByWatermark in the query progress).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.metrics import SLOT


def slot_counts_stream(events: DataFrame, by: list[str] | None = None, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    by = by or []
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counts = timed.groupBy(*by, F.window("_ts", f"{SLOT} seconds").alias("w")).agg(F.count("*").alias("c"))
    return counts.select(*by, F.floor(F.unix_seconds("w.start") / SLOT).alias("slot"), "c")


def final_counts(updates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per slot from the rows of an update-mode stream."""
    return updates.groupBy(*(by or []), "slot").agg(F.max("c").alias("c"))
