"""Operating numbers from event tables: rates, ratios, backlog, counters.

Rates over sliding windows are taken from counts per slot (15 s), so an event is counted once and not
copied into every window; slots are windowed day by day, each day also seeing the end of the day
before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = 15  # seconds
PER_DAY = 24 * 3600 // SLOT


def slot_of(ts: str) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / SLOT)


def slot_end(slot: Column) -> Column:
    return F.timestamp_seconds((slot + 1) * SLOT).cast("timestamp_ntz")


def slot_counts(events: DataFrame, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """(by, slot, c): events per slot; on a stream this is the state to keep."""
    return events.groupBy(*(by or []), slot_of(ts).alias("slot")).agg(F.count("*").alias("c"))


def sliding_counts(events: DataFrame, width_seconds: int, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """(by, at, n): for each slot with events, how many events the window that ends with it holds."""
    return sliding_from_slots(slot_counts(events, by, ts), width_seconds, by)


def sliding_from_slots(counts: DataFrame, width_seconds: int, by: list[str] | None = None) -> DataFrame:
    by = by or []
    width = width_seconds // SLOT
    day = F.floor(F.col("slot") / PER_DAY)
    reach = F.floor((F.col("slot") + width - 1) / PER_DAY)
    seen = counts.withColumn("own", day).withColumn("day", F.explode(F.sequence(day, reach)))
    w = Window.partitionBy(*by, "day").orderBy("slot").rangeBetween(-(width - 1), 0)
    return seen.withColumn("n", F.sum("c").over(w)).where(F.col("day") == F.col("own")).select(
        *by, slot_end(F.col("slot")).alias("at"), "n")


def links_per_hour(attempts: DataFrame) -> DataFrame:
    return sliding_counts(attempts.where(F.col("kind") == "link_created"), 3600).withColumnRenamed("n", "links")


def failure_rates(attempts: DataFrame) -> DataFrame:
    """Failures per second over five minutes, by type."""
    rates = sliding_counts(attempts.where(F.col("failure_type").isNotNull()), 300, ["failure_type"])
    return rates.select("failure_type", "at", F.round(F.col("n") / 300, 6).alias("per_second"))


def export_success_pct(attempts: DataFrame) -> DataFrame:
    """Share of successful exports per day and its level (below 80 red, below 95 yellow)."""
    ok = F.count_if(F.col("kind") == "export_success")
    bad = F.count_if(F.col("kind") == "export_failed")
    daily = attempts.groupBy(F.to_date("ts").alias("day")).agg(F.round(ok * 100 / F.nullif(ok + bad, F.lit(0)), 6).alias("pct"))
    level = F.when(F.col("pct") < 80, "red").when(F.col("pct") < 95, "yellow").when(F.col("pct").isNotNull(), "green")
    return daily.withColumn("level", level)


def queue_depth(changes: DataFrame) -> DataFrame:
    """Backlog after each slot from changes (ts, change), and its level (10 yellow, 50 red).

    Two-step running sum: inside days, shifted by the total of the days before. The one window
    without a key runs over days, so its size is that of the calendar.
    """
    slots = changes.groupBy(slot_of("ts").alias("slot")).agg(F.sum("change").alias("c")).withColumn(
        "day", F.floor(F.col("slot") / PER_DAY))
    days = slots.groupBy("day").agg(F.sum("c").alias("total"))
    before = F.sum("total").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    shifts = days.select("day", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("c").over(Window.partitionBy("day").orderBy("slot"))
    depth = slots.withColumn("inside", inside).join(shifts, "day").select(
        slot_end(F.col("slot")).alias("at"), (F.col("inside") + F.col("before")).alias("depth"))
    return depth.withColumn("level", F.when(F.col("depth") >= 50, "red").when(F.col("depth") >= 10, "yellow").otherwise("green"))


def index_gap(links: DataFrame) -> DataFrame:
    return links.agg((F.count("*") - F.count("indexed_at")).alias("gap"))


def job_counters(attempts: DataFrame) -> DataFrame:
    """Started, completed and failed parse and export jobs per hour.

    Every finished or failed job was started; a failed parse of type export is an export failure.
    """
    kind, why = F.col("kind"), F.col("failure_type")
    stage = F.when(kind.startswith("export") | (why == "export"), "export").otherwise("parse")
    outcome = F.when(kind.isin("link_created", "export_success"), "completed").otherwise("failed")
    rows = attempts.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"),
                           stage.alias("stage"), outcome.alias("outcome"))
    return rows.groupBy("hour", "stage").agg(
        F.count("*").alias("started"), F.count_if(F.col("outcome") == "completed").alias("completed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"))
