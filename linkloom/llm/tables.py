"""Reading input rows, and storing what several jobs read."""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import ensure_checkpoint_dir

# The class of white space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SPACE_RUN = r"[\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    """A column name as a reference to that very column, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def keyed(docs: DataFrame, key: str, *texts: str) -> DataFrame:
    """Columns ``row``, ``key`` and the named texts (null: empty) of a table, whatever else it has.

    ``row`` tells rows with equal or null keys apart. It follows the place of a row in its input and is made anew in every
    scan, which may cut the input elsewhere: what reads it more than once takes ``numbered``.
    """
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(key)).alias("key"),
                       *[F.coalesce(F.col(quoted(t)), F.lit("")).alias(t) for t in texts])


def keyed_once(docs: DataFrame, key: str, *texts: str, copy: bool = False) -> DataFrame:
    """``keyed`` with rows numbered once: the same row has the same number in all scans."""
    return read_from(numbered(docs, key, *texts, copy=copy), key, *texts)


def read_from(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """``keyed`` from the rows of ``numbered``."""
    field = lambda name: F.col(f"doc.{quoted(name)}")
    return rows.select("row", field(key).alias("key"), *[F.coalesce(field(t), F.lit("")).alias(t) for t in texts])


def numbered(docs: DataFrame, *columns: str, copy: bool = False) -> DataFrame:
    """The input rows as ``doc`` (these columns, or all) with a number ``row`` that is the same in all scans.

    Rows of Parquet files are numbered by file and place in it, and nothing is copied. Other rows, and all with ``copy``, are
    stored once with a number that follows their place: small numbers, which pack better where they travel much.
    """
    number = None if copy else _place(docs)
    doc = F.struct(*[F.col(quoted(c)) for c in dict.fromkeys(columns or docs.columns)]).alias("doc")
    rows = docs.select((F.monotonically_increasing_id() if number is None else number).alias("row"), doc)
    return stored(rows) if number is None else rows


def _place(docs: DataFrame) -> Column | None:
    """A number from the file of a row and its place there, different for all rows; None if rows are not plainly read from Parquet.

    The upper bits are a hash of the file's name, under a seed for which no two files of the table share them.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "_metadata" in docs.columns:
        return None
    try:
        places = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return None
    files = places.groupBy("file").agg(F.max("place").alias("last"))
    count, last = files.agg(F.count(F.lit(1)), F.max("last")).first()
    bits = max(1, (last or 0).bit_length())
    head = lambda seed, file: F.shiftrightunsigned(F.xxhash64(F.lit(seed), file), bits + 1)
    found = files.agg(*[F.count_distinct(head(seed, F.col("file"))) for seed in range(4)]).first()
    for seed, heads in enumerate(found):
        if heads == count:
            return F.shiftleft(head(seed, F.col("_metadata.file_path")), bits).bitwiseOR(F.col("_metadata.row_index"))
    return None


# Spark then removes the shuffle files of an execution when it has ended; asking again for the same rows makes them anew.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame) -> DataFrame:
    """Write rows to the folder that all machines share and read them again: cuts the lineage and outlives executors.

    What was shuffled to make them is no longer needed and does not stay on the executors' disks.
    """
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(rows.schema).parquet(path)


def squeezed(text: Column) -> Column:
    """A text without its white space."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without white space."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def with_fixed(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a plain computed column is pushed below it, and the expression is then repeated wherever the filter
    mentions it, inside lambdas too. What a generator gives is taken as it is.
    """
    made = F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
    return rows.select("*", F.inline(F.array(made)))
