"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed size. Equal blocks get equal integer names, different blocks different ones: the
blocks that share a 64-bit hash are sorted, and a name is the hash with the block's rank among them. Adjacent names are
then named in pairs the same way, level by level, until one name is left for each text. Texts are equal exactly if they
have the same number of blocks and the same last name; no text is compared with another one.

The text itself is shuffled once, after equal blocks have met inside each task; the levels move integers. Only a block
whose hash another block has needs its rank from outside, so a block that a third of all texts share is no burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import keyed, numbered, read_from, squeezed, stored


def _named(rows: DataFrame, key: str) -> DataFrame:
    """Replace column ``key`` by its name, the columns ``h`` and ``r``."""
    rows = rows.withColumn("h", F.xxhash64(key))
    # equal keys meet in the tasks that read them; more than one key for a hash is next to never seen
    clashes = stored(rows.groupBy("h").agg(F.array_sort(F.collect_set(key)).alias("keys")).where("size(keys) > 1"))
    rank = F.coalesce(F.array_position("keys", F.col(key)), F.lit(1)).cast("int")
    return rows.join(clashes, "h", "left").withColumn("r", rank).drop(key, "keys")


def text_names(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 4096) -> DataFrame:
    """The identity of every row's text without white space.

    Returns row, key, n_chars (code points of the whole text), sha256 (of the text without white space), blocks, h, r.
    Two rows have equal (blocks, h, r) exactly if their texts are equal without white space. A null text is empty, and
    empty texts are equal; a text of any length is read whole. Rows may repeat keys or have none. An empty table gives
    an empty table. Other columns of the input are not looked at.
    """
    return _text_names(keyed(docs, key, text).withColumnRenamed(text, "text"), block_bytes)


def _text_names(rows: DataFrame, block_bytes: int) -> DataFrame:
    rows = rows.select("row", "key", F.length("text").alias("n_chars"), squeezed(F.col("text")).cast("binary").alias("body"))
    rows = rows.select("row", "key", "n_chars", F.sha2("body", 256).alias("sha256"), "body",
                       F.greatest(F.ceil(F.length("body") / block_bytes), F.lit(1)).cast("int").alias("blocks"))
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                      lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    first = F.col("pos") == 0
    rows = rows.select("row", "blocks", "key", "n_chars", "sha256", F.posexplode(cut).alias("pos", "block"))
    # what belongs to a row travels with its first block only
    level = stored(_named(rows.select("row", "blocks", "pos", "block", *[
        F.when(first, F.col(c)).alias(c) for c in ("key", "n_chars", "sha256")]), "block"))
    heads = level.where("pos = 0").select("row", "key", "n_chars", "sha256", "blocks")
    done = level.where("blocks = 1").select("row", "h", "r")
    most = level.agg(F.max("blocks")).first()[0] or 1
    level, span = level.select("row", "blocks", "pos", "h", "r").where("blocks > 1"), 1
    while span < most:  # as many rounds as the longest text has doublings
        span *= 2
        name = F.struct("h", "r")
        pairs = level.groupBy("row", "blocks", F.floor(F.col("pos") / 2).alias("pos")).agg(F.struct(
            F.max(F.when(F.col("pos") % 2 == 0, name)).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, name)).alias("right")).alias("pair"))
        level = stored(_named(stored(pairs), "pair"))
        done = done.unionByName(level.where(F.col("blocks") <= span).select("row", "h", "r"))
        level = level.where(F.col("blocks") > span)
    return heads.join(done, "row")


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per input row: row, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest key (null last), then the first row.
    """
    return _marked(text_names(docs, key, text, block_bytes))


def _marked(names: DataFrame) -> DataFrame:
    names = stored(names)
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("key").isNull().alias("no_key"), "key", "row")).alias("best")
    # a group of one needs no answer from elsewhere
    groups = stored(names.groupBy("blocks", "h", "r").agg(F.count(F.lit(1)).alias("size"), best).where("size > 1"))
    rows = names.join(groups, ["blocks", "h", "r"], "left")
    alone = F.col("size").isNull()
    return rows.select("row", F.col("key").alias("doc_id"),
                       F.when(alone, F.col("key")).otherwise(F.col("best.key")).alias("keep_id"),
                       F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                       (alone | (F.col("row") == F.col("best.row"))).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 4096) -> DataFrame:
    """The input rows that stay, with all their columns."""
    rows = numbered(docs)
    names = _text_names(read_from(rows, key, text).withColumnRenamed(text, "text"), block_bytes)
    return rows.join(_marked(names).where("kept").select("row"), "row", "left_semi").select("doc.*")
