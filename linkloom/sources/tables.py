"""Readers: entity tables from files or a database, and the page corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.schemas import ENTITIES


def read_entity(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One entity from parquet under its declared schema (nothing is inferred)."""
    return spark.read.schema(ENTITIES[name]).parquet(f"{folder}/{name}")


def read_entity_jdbc(spark: SparkSession, url: str, name: str, low: int, high: int, parts: int,
                     **options: str) -> DataFrame:
    """One entity from a database, split on its numeric key so that executors read in parallel."""
    key = "link_id" if name == "link_tags" else "id"
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high,
                 numPartitions=parts, fetchsize=10000, **options)
        .load()
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored page corpus (page_id, url, html) from parquet."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_page_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Page corpus from raw HTML files; the file path is the address."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    return files.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html")
    )
