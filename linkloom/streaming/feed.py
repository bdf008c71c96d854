"""Queue and feed ends of the streams: link ids in, messages out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def link_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """Link ids of text entries; entries that are no number are skipped."""
    return lines.select(F.expr(f"try_cast({column} AS bigint)").alias("link_id")).where(F.col("link_id").isNotNull())


def read_queue(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of queued link ids from a folder of text files (parse, export and delete queues alike)."""
    return link_ids(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def read_kafka_queue(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from a Kafka topic, where the connector is on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return link_ids(rows.select(F.col("value").cast("string").alias("value")))


def feed_messages(parsed: DataFrame) -> DataFrame:
    """One JSON message per parsed link (link_id)."""
    return parsed.select(F.to_json(F.struct(F.lit("link_parsed").alias("type"), F.col("link_id").alias("linkId"))).alias("value"))
