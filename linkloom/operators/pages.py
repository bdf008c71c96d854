"""Page corpus to parsed links: HTML parts from an Arrow UDF, everything else in columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import notes, strings

PARTS = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "og_title", "title_tag", "h1", "description", "og_image", "main_place", "markdown", "error")]
    + [T.StructField("removed", T.IntegerType()), T.StructField("images", T.ArrayType(T.StringType())),
       T.StructField("languages", T.ArrayType(T.StringType()))])

# characters of HTML whose parts leave Python at once
PARSED_CHARS = 1 << 20


@F.pandas_udf(PARTS)
def html_parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import sys

    from linkloom.functions.html import parse_page

    sys.setrecursionlimit(20000)
    blank = {name: None for name in PARTS.fieldNames()}
    for batch in batches:
        rows, size = [], 0
        for html in batch:
            try:
                # one bad page must not fail the job: it becomes a failed row
                rows.append({**blank, **parse_page(html)})
            except Exception as exc:  # noqa: BLE001
                rows.append({**blank, "error": f"{type(exc).__name__}: {exc}"})
            size += len(html or "")
            if size >= PARSED_CHARS:
                yield pd.DataFrame(rows, columns=PARTS.fieldNames())
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=PARTS.fieldNames())


# a filter on what the function gives must not run it a second time
html_parts = html_parts.asNondeterministic()


def page_parts(pages: DataFrame) -> DataFrame:
    """(page_id, url, parts...): a narrow job, one Arrow pass per split."""
    return pages.select("page_id", "url", html_parts("html").alias("p")).select("page_id", "url", "p.*")


def title_of(parts: DataFrame) -> Column:
    """og:title, else <title>, else the first h1 (even an empty one), else the address."""
    return F.coalesce("og_title", "title_tag", "h1", "url")


def parse_pages(pages: DataFrame, as_of: Column) -> DataFrame:
    """Whole parse stage: state, title, Markdown, minutes, description, image and time of each page."""
    parts = page_parts(pages)
    content = notes.clean_markdown(F.col("markdown"))
    ok = F.col("error").isNull()
    return parts.select(
        "page_id", "url", F.when(ok, "parsed").otherwise("failed").alias("status"),
        F.when(ok, title_of(parts)).alias("title"), content.alias("content_md"),
        F.when(ok, strings.reading_minutes(content)).alias("reading_time_min"), "description", "og_image",
        F.when(ok, as_of).alias("parsed_at"), "error")


def page_images(pages: DataFrame) -> DataFrame:
    """(page_id, pos, image_url): absolute addresses, each once, at most 50 per page, in page order."""
    return page_parts(pages).select("page_id", F.posexplode("images").alias("pos", "image_url"))


# fixed value: largest image kept, in bytes
MAX_IMAGE_BYTES = 10 * 1024 * 1024


def image_size_filter(assets: DataFrame) -> DataFrame:
    """Assets within the limit by declared and by real size (an unknown declared size passes)."""
    declared = F.coalesce("declared_bytes", F.lit(-1))
    return assets.where((declared <= MAX_IMAGE_BYTES) & (F.col("real_bytes") <= MAX_IMAGE_BYTES))


# ---- Markdown to block rows --------------------------------------------------------------------

BLOCK_KINDS = ("paragraph", "list", "quote", "code", "heading")  # in the order in which blocks at one place come
END = 2**31 - 1  # the place of blocks that only the end of the text flushes
# per kind of block: the kinds of line that flush it, and what joins its lines
FLUSHED = {
    "paragraph": (("fence", "heading", "list", "quote", "blank"), " "), "list": (("fence", "heading", "quote", "blank"), "\n"),
    "quote": (("fence", "heading", "list", "blank"), " "), "code": (("fence",), "\n")}
LINE_KINDS = ("paragraph", "list", "quote", "code", "heading", "fence", "blank")


def markdown_blocks(notes_df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, rank, kind, level, text): the blocks of each Markdown text in order of (at, rank).

    Three buffers (paragraph, list, quote) and the code fence fill up side by side and each is emitted at the next line
    that flushes it, which names the block. So the lines of a block are those of its kind with the same next flushing line,
    found for all lines of some texts at once. Lines of a text stay in the task that reads it: no shuffle, and the work
    grows with the number of lines.
    """
    space = f"[{strings.BROWSER_SPACE}]"
    heading, item, quote = rf"^(#{{1,6}}){space}+(.*)$", rf"^[-*+]{space}+(.*)$", rf"^>{space}?(.*)$"
    rows = notes_df.where(F.col(text) != "").select(
        F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.replace(F.col(text), F.lit("\r"), F.lit("")).alias("text"))
    rows = rows.select("key", "row", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.withColumn("trimmed", strings.browser_trim(F.col("line")))
    number = {kind: F.lit(i) for i, kind in enumerate(LINE_KINDS)}
    # what a line is outside code
    rows = rows.withColumn(
        "kind", F.when(F.startswith("trimmed", F.lit("```")), number["fence"]).when(F.rlike("line", F.lit(heading)), number["heading"])
        .when(F.rlike("line", F.lit(item)), number["list"]).when(F.rlike("line", F.lit(quote)), number["quote"])
        .when(F.col("trimmed") == "", number["blank"]).otherwise(number["paragraph"]).cast("tinyint"))
    value = F.when(F.col("kind") == number["heading"], F.regexp_extract("line", heading, 2)).when(
        F.col("kind") == number["list"], F.regexp_extract("line", item, 1)).when(
        F.col("kind") == number["quote"], F.regexp_extract("line", quote, 1)).otherwise(F.col("trimmed"))
    level = F.when(F.col("kind") == number["heading"], F.length(F.regexp_extract("line", heading, 1)))
    kind = dict(rows.dtypes)["key"]
    return rows.select("key", "row", "n", "line", "kind", value.alias("value"), level.alias("level")).mapInArrow(
        _whole_texts, f"key {kind}, at int, rank int, kind string, level int, text string").withColumnRenamed("key", key)


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the texts whose last line has come; the lines of the last text wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        row = batch.column("row").to_numpy(zero_copy_only=False)
        if held and len(row) and held[-1].column("row")[-1].as_py() != row[0]:
            yield _blocks(held)
            held = []
        new = np.flatnonzero(row[1:] != row[:-1])
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut:
            yield _blocks([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if any(len(b) for b in held):
        yield _blocks(held)


def _blocks(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    lines = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: lines.column(name).chunk(0)
    row, n, kind = (column(c).to_numpy(zero_copy_only=False) for c in ("row", "n", "kind"))
    code = {name: i for i, name in enumerate(LINE_KINDS)}
    fence = kind == code["fence"]
    first = np.append(True, row[1:] != row[:-1])
    text = np.cumsum(first) - 1
    fences = np.cumsum(fence)
    inside = (fences - (fences - fence)[first][text]) % 2 == 1
    kind = np.where(inside & ~fence, code["code"], kind)
    ends = np.append(np.flatnonzero(first)[1:], len(row))[text]
    place = np.arange(len(row))
    parts = []
    for block, (flushing, _) in FLUSHED.items():
        some = place[kind == code[block]]
        flush = place[np.isin(kind, [code[k] for k in flushing])]
        after = np.append(flush, len(row))[np.searchsorted(flush, some)]
        at = np.where(after < ends[some], n[np.minimum(after, len(row) - 1)], END)
        parts.append((some, at, np.full(len(some), code[block])))
    heads = place[kind == code["heading"]]
    parts.append((heads, n[heads], np.full(len(heads), code["heading"])))
    some, at, block = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((some, block, at, text[some]))
    some, at, block = some[order], at[order], block[order]
    new = np.append(True, (text[some][1:] != text[some][:-1]) | (at[1:] != at[:-1]) | (block[1:] != block[:-1]))[:len(some)]
    starts = np.flatnonzero(new)
    bounds = np.append(starts, len(some)).astype(np.int64)
    chosen = pc.if_else(pa.array(block == code["code"]), column("line").take(pa.array(some)), column("value").take(pa.array(some)))
    joins = {code[k]: glue for k, (_, glue) in FLUSHED.items()} | {code["heading"]: " "}
    glue = pa.array([joins[b] for b in block[starts].tolist()], pa.large_string())
    listed = pa.LargeListArray.from_arrays(pa.array(bounds), chosen.cast(pa.large_string()))
    of = pa.array(some[starts])
    level = pc.if_else(pa.array(block[starts] == code["heading"]), column("level").take(of), pa.scalar(None, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [column("key").take(of), pa.array(at[starts].astype(np.int32)), pa.array(block[starts].astype(np.int32)),
         pa.array([BLOCK_KINDS[b] for b in block[starts].tolist()], pa.string()), level,
         pc.binary_join(listed, glue).cast(pa.string())], ["key", "at", "rank", "kind", "level", "text"])
