"""Batch operators driven by a stream: capture to note, and the incremental index.

Every batch writes its own partition (batch=N) of each output table, overwriting what an interrupted
attempt left there, so a repeated batch gives the same tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators import changes, pages, search, vault
from linkloom.operators.segments import SearchIndex
from linkloom.session import ensure_checkpoint_dir
from linkloom.streaming.feed import feed_messages


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Process everything that has arrived, batch by batch, then stop."""
    stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()


def collect_batches(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table, and read it back."""
    spark = stream.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={epoch}")

    run_available(stream, step, folder, mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").drop("batch")


LINK_ROWS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("url_hash", T.StringType()),
    T.StructField("user_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("saved_at", T.TimestampType()), T.StructField("status", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("content_md", T.StringType()),
    T.StructField("reading_time_min", T.IntegerType()), T.StructField("parsed_at", T.TimestampType()),
])


class CaptureFlow:
    """Captures (seq, user_id, url, saved_at) to links, search documents, feed messages and notes."""

    def __init__(self, spark: SparkSession, page_corpus: DataFrame, folder: str, as_of: Column):
        self.spark, self.corpus, self.folder, self.as_of = spark, page_corpus, folder, as_of

    def table(self, name: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}")
        rows = rows.schema(T.StructType(LINK_ROWS.fields + [T.StructField("batch", T.LongType())])) if name == "links" else rows
        read = rows.text if name == "feed" else rows.parquet
        found = read(f"{self.folder}/{name}")
        return found if before is None else found.where(F.col("batch") < before)

    def _links_before(self, epoch: int) -> DataFrame:
        if epoch == 0:
            return self.spark.createDataFrame([], LINK_ROWS)
        return self.table("links", epoch).drop("batch")

    def step(self, batch: DataFrame, epoch: int) -> None:
        """One batch: refuse known (url, user), insert, parse once per address, then index, announce, render."""
        known = self._links_before(epoch)
        new = changes.link_insert(known.select("id", "url_hash", "user_id"), batch)
        asked = self.corpus.join(new.select("url"), "url", "left_semi")
        parsed = pages.parse_pages(asked, self.as_of).select(
            "url", F.col("status").alias("parse_status"), "title", "content_md", "reading_time_min", "parsed_at")
        links = new.join(parsed, "url", "left").withColumn("status", F.coalesce("parse_status", F.lit("failed")))
        links = links.select(*[F.col(f.name).cast(f.dataType) for f in LINK_ROWS.fields])
        links.write.mode("overwrite").parquet(f"{self.folder}/links/batch={epoch}")
        # read back: the pages are parsed once, the outputs below only read columns
        done = self.spark.read.schema(LINK_ROWS).parquet(f"{self.folder}/links/batch={epoch}").where("status = 'parsed'")
        docs = done.select("id", "user_id", "url", F.coalesce("title", F.lit("")).alias("title"),
                           F.coalesce("content_md", F.lit("")).alias("content"), F.lit("unsorted").alias("collection"), "saved_at")
        docs.write.mode("overwrite").parquet(f"{self.folder}/docs/batch={epoch}")
        feed_messages(done.select(F.col("id").alias("link_id"))).write.mode("overwrite").text(f"{self.folder}/feed/batch={epoch}")
        none = F.lit(None).cast("string")
        ready = done.withColumns({
            "content": F.col("content_md"), "minutes": F.coalesce("reading_time_min", F.lit(1)), "collection": F.lit("unsorted"),
            "tags": F.array().cast("array<string>"), "related": F.array().cast("array<string>"),
            "export_directory": none, "export_file_name": none})
        vault.render_notes(ready, self.as_of).write.mode("overwrite").parquet(f"{self.folder}/notes/batch={epoch}")

    def run(self, captures: DataFrame) -> None:
        run_available(captures, self.step, self.folder)


class IncrementalIndex:
    """Keeps a stored search index and the links' index times up to date from a stream of parsed link ids.

    A batch writes one segment and reads no other batch but the id partitions that it touches; a repeated batch changes nothing.
    """

    def __init__(self, links: DataFrame, collections: DataFrame, link_tags: DataFrame, tags: DataFrame, folder: str, **settings: int):
        self.inputs, self.folder = (links, collections, link_tags, tags), folder
        self.index = SearchIndex(links.sparkSession, f"{folder}/index", **settings)

    def step(self, batch: DataFrame, epoch: int) -> None:
        links, *others = self.inputs
        asked = links.join(batch.select(F.col("link_id").alias("id")).distinct(), "id", "left_semi")
        self.index.apply(search.resync_docs(asked, *others), epoch=epoch)

    def documents(self) -> DataFrame:
        """One document per link: that of the last batch that wrote it."""
        return self.index.documents()

    def marked_links(self, at: Column) -> DataFrame:
        """The links, those with a written document marked as indexed."""
        return search.mark_indexed(self.inputs[0], self.documents(), at)

    def run(self, ids: DataFrame) -> None:
        run_available(ids, self.step, self.folder)


def page_captures(rows: DataFrame) -> DataFrame:
    """Captures of a page stream (page_id, url): users take turns, one capture per minute."""
    return rows.select(
        F.col("page_id").alias("seq"), (F.col("page_id") % 50).alias("user_id"), "url",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60).alias("saved_at"))
