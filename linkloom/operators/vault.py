"""Markdown vault: note files, manifest, tag pages and the index.

A note is one row (path, content). Tag pages and the index have no bound on their length, so they are
tables of ordered lines: the sort key is in columns and a range sort spreads even one huge page over
many tasks. Written out, such a page is a folder of ordered text parts.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import notes, strings
from linkloom.operators import related as rl
from linkloom.operators.notefiles import NoteStore, opened
from linkloom.operators.relational import tags_of, with_collection, with_tags
from linkloom.sources.schemas import MANIFEST

# ---- notes -------------------------------------------------------------------------------------


def related_slugs(links: DataFrame, link_tags: DataFrame, k: int = 5, hot_degree: int = rl.HOT_DEGREE) -> DataFrame:
    """(id, related): the k best slugs of each link in rank order."""
    top = rl.related_top(links, link_tags, k, hot_degree=hot_degree)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "slug"))), lambda x: x["slug"])
    return top.groupBy(F.col("link_id").alias("id")).agg(ordered.alias("related"))


def render_notes(links: DataFrame, as_of: Column, allow_absolute: bool = False) -> DataFrame:
    """Notes of prepared links (id, url, title, content, minutes, collection, tags, related[, images])."""
    title = F.coalesce("title", F.lit(""))
    folder = strings.collection_directory(F.col("collection"))
    path = strings.note_path(F.col("export_directory"), F.col("export_file_name"), title, F.col("collection"), allow_absolute)
    header = notes.frontmatter(title, F.col("url"), F.col("tags"), folder, as_of, F.col("minutes"), F.col("id"))
    body = F.coalesce("content", F.lit(""))
    if "images" in links.columns:
        body = notes.rewrite_images(body, F.col("images"))
    text = notes.note_markdown(header, title, body, notes.related_section(F.col("related")))
    stem = strings.file_stem(F.coalesce("export_file_name", title))
    return links.select(
        F.col("id").alias("link_id"), path.alias("path"), stem.alias("slug"), folder.alias("collection"),
        notes.iso_instant(as_of).alias("updated_at"), text.alias("content"))


def export_notes(links: DataFrame, link_tags: DataFrame, tags: DataFrame, collections: DataFrame, as_of: Column,
                 hot_degree: int = rl.HOT_DEGREE) -> DataFrame:
    """The export stage for all parsed links at once."""
    parsed = links.where(F.col("status") == "parsed")
    # only parsed links have notes, and only they are related to any: tags of others go before they are named or paired
    own = tags_of(link_tags, parsed)
    content = F.col("content_md") if "content_md" in links.columns else F.lit(None).cast("string")
    full = with_tags(with_collection(parsed, collections), own, tags).join(
        related_slugs(links, own, hot_degree=hot_degree), "id", "left")
    ready = full.withColumns({"content": content, "minutes": F.coalesce("reading_time_min", F.lit(1))})
    return render_notes(ready, as_of)


def note_files(exported: DataFrame) -> DataFrame:
    """(path, content) with one row per file: of notes that share a path the last link's stays."""
    return exported.groupBy("path").agg(F.max_by("content", "link_id").alias("content"))


def write_notes(files: DataFrame, root: str) -> None:
    """Write one file per row below ``root``, a folder that all executors share, all of them or none."""
    NoteStore(files.sparkSession, root).write(files)


def remove_files(paths: DataFrame, root: str) -> None:
    NoteStore(paths.sparkSession, root).write(removed=paths)


def downloads(links: DataFrame) -> DataFrame:
    """Stand-alone download of each link: attachment name and text. ``links`` carries tags and content."""
    title = F.coalesce("title", F.lit("untitled"))
    text = notes.download_markdown(title, F.col("url"), F.col("tags"), F.col("saved_at"), F.col("parsed_at"),
                                   F.coalesce("reading_time_min", F.lit(0)), F.coalesce("content", F.lit("")))
    return links.select("id", F.concat(strings.wikilink_slug(title), F.lit(".md")).alias("file_name"), text.alias("content"))


# ---- manifest ----------------------------------------------------------------------------------


def read_manifest(texts: DataFrame, column: str = "value") -> DataFrame:
    """Note rows of manifest JSON texts; an unreadable text has none."""
    parsed = F.from_json(column, MANIFEST)
    entries = F.coalesce(F.map_values(parsed["notes"]), F.array().cast(f"array<{MANIFEST['notes'].dataType.valueType.simpleString()}>"))
    return texts.select(F.explode(entries).alias("n")).select(
        F.col("n.linkId").alias("link_id"), "n.path", "n.slug", "n.collection", F.col("n.updatedAt").alias("updated_at"))


def write_manifest(manifest: DataFrame, folder: str, notes_per_text: int = 1000) -> None:
    """Store the manifest as JSON texts of about ``notes_per_text`` notes each, one per line; ``read_manifest`` reads them."""
    entry = F.struct(F.col("link_id").alias("linkId"), "path", "slug", "collection", F.col("updated_at").alias("updatedAt"))
    texts = F.ceil(F.lit(manifest.count() / notes_per_text)).cast("long")
    part = F.pmod(F.xxhash64("link_id"), F.greatest(texts, F.lit(1)))
    named = F.map_from_entries(F.collect_list(F.struct(F.col("link_id").cast("string"), entry)))
    manifest.groupBy(part.alias("part")).agg(F.to_json(F.struct(named.alias("notes"))).alias("value")).select(
        "value").write.mode("overwrite").text(folder)


def manifest_upsert(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Manifest rows by link after new notes; untouched links keep theirs."""
    fields = ["path", "slug", "collection", "updated_at"]
    new = fresh.select("link_id", F.struct(*fields).alias("new"))
    old = manifest.select("link_id", F.struct(*fields).alias("old"))
    both = old.join(new, "link_id", "full")
    return both.select("link_id", F.coalesce("new", "old").alias("row")).select("link_id", "row.*")


def note_moves(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """(link_id, old_path, path) of notes whose path changed: the old files to remove.

    An old path that is now another note's is not removed.
    """
    old = manifest.select("link_id", F.col("path").alias("old_path"))
    moved = old.join(fresh.select("link_id", "path"), "link_id").where(F.col("old_path") != F.col("path"))
    return moved.join(fresh.select(F.col("path").alias("old_path")), "old_path", "left_anti").select("link_id", "old_path", "path")


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def note_delete(manifest: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest left, files to delete with the pattern of their assets) for links (link_id)."""
    ids = gone.select("link_id").distinct()
    left = manifest.join(ids, "link_id", "left_anti")
    assets = F.concat(parent_dir(F.col("path")), F.lit("/assets/"), F.col("link_id").cast("string"), F.lit("_*"))
    return left, manifest.join(ids, "link_id", "left_semi").select("link_id", "path", assets.alias("assets"))


def delete_exports(jobs: DataFrame, manifest: DataFrame, asked: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, manifest, files to delete) after users delete exports of links (link_id): only finished ones go."""
    ids = asked.select("link_id", F.lit(True).alias("asked")).distinct()
    marked = jobs.join(ids, "link_id", "left")
    hit = F.coalesce(F.col("asked") & (F.col("status") == "done"), F.lit(False))
    files = marked.where(hit & F.col("vault_path").isNotNull()).select("link_id", F.col("vault_path").alias("path"))
    kind = jobs.schema["completed_at"].dataType
    new_jobs = marked.select(
        *[c for c in jobs.columns if c not in ("status", "error_msg", "completed_at")],
        F.when(hit, "deleted").otherwise(F.col("status")).alias("status"),
        F.when(hit, "Deleted by user").otherwise(F.col("error_msg")).alias("error_msg"),
        F.when(hit, at.cast(kind)).otherwise(F.col("completed_at")).alias("completed_at"))
    return new_jobs, manifest.join(files.select("path"), "path", "left_anti"), files


def reexport_notes(jobs: DataFrame, manifest: DataFrame, fresh: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, files to delete) after exporting asked links (link_id) again; ``fresh`` are their new notes.

    The old file goes first, so it is on the list only where the new note has another path.
    """
    ids = asked.select("link_id").distinct()
    done = jobs.join(ids, "link_id", "left_semi").where((F.col("status") == "done") & F.col("vault_path").isNotNull()).select(
        "link_id", F.col("vault_path").alias("path"))
    new = fresh.join(ids, "link_id", "left_semi")
    cleared = manifest.join(done.select("path"), "path", "left_anti")
    return manifest_upsert(cleared, new), done.join(new.select("path"), "path", "left_anti").select("link_id", "path")


def empty_dirs(manifest: DataFrame, deleted: DataFrame) -> DataFrame:
    """Folders of deleted notes in which no note is left."""
    left = manifest.join(deleted.select("link_id"), "link_id", "left_anti").select(parent_dir(F.col("path")).alias("dir"))
    return deleted.select(parent_dir(F.col("path")).alias("dir")).distinct().join(left, "dir", "left_anti")


def vault_dirs(paths: DataFrame) -> DataFrame:
    """Every folder below collections/ that a note path passes through, sorted."""
    inner = paths.where(F.col("path").startswith("collections/")).select(
        F.split(parent_dir(F.expr("substring(path, 13)")), "/").alias("parts"))
    # folders are few next to notes: make them distinct before building their ancestors
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    return inner.distinct().select(F.explode(prefixes).alias("dir")).where("dir <> ''").distinct().orderBy("dir")


def dangling_wikilinks(exported: DataFrame) -> DataFrame:
    """(link_id, target): wikilinks in notes that name no note file."""
    found = F.regexp_extract_all("content", F.lit(r"\[\[([^\]|]+)"), F.lit(1))
    targets = exported.select("link_id", F.explode(F.array_distinct(found)).alias("target"))
    return targets.join(exported.select(F.col("slug").alias("target")).distinct(), "target", "left_anti").select("link_id", "target")


# ---- pages of lines ----------------------------------------------------------------------------

LINE_KEYS = ["page", "part", "key1", "sub", "key2", "link_id"]


def _line(part: int, sub: int, text: Column, page: Column, key1: Column | None = None, key2: Column | None = None,
          link_id: Column | None = None) -> list[Column]:
    empty = F.lit("")
    return [page.alias("page"), F.lit(part).alias("part"), (key1 if key1 is not None else empty).alias("key1"),
            F.lit(sub).alias("sub"), (key2 if key2 is not None else empty).alias("key2"),
            (link_id if link_id is not None else F.lit(0)).cast("bigint").alias("link_id"), text.alias("line")]


def _fixed(rows: DataFrame, part: int, sub: int, texts: list[Column], page: Column, key1: Column | None = None) -> DataFrame:
    """The same few lines for each row, in order."""
    cells = F.posexplode(F.array(*texts)).alias("n", "line")
    k1 = key1 if key1 is not None else F.lit("")
    return rows.select(page.alias("page"), k1.alias("key1"), cells).select(
        "page", F.lit(part).alias("part"), "key1", F.lit(sub).alias("sub"), F.lpad(F.col("n").cast("string"), 3, "0").alias("key2"),
        F.lit(0).cast("bigint").alias("link_id"), "line")


def collection_lines(manifest: DataFrame) -> DataFrame:
    """(collection, slug, link_id, line): the note lines of the index, by collection and slug."""
    line = F.concat(F.lit("- [["), "slug", F.lit("]] — `"), "collection", F.lit("`"))
    return manifest.select("collection", "slug", "link_id", line.alias("line"))


def index_document(manifest: DataFrame, edges: DataFrame, as_of: Column, title: str = "All Links") -> DataFrame:
    """Ordered lines of _index.md: totals, notes by collection, and the backlink graph."""
    page = F.lit("_index.md")
    total = manifest.agg(F.count("*").alias("n")).where("n > 0").withColumn("n", F.col("n").cast("string"))
    head = _fixed(total, 0, 0, [
        F.lit("---"), F.lit(f"title: {title}"), F.concat(F.lit("total: "), "n"),
        F.concat(F.lit("updated: "), notes.iso_instant(as_of)), F.lit("---"), F.lit(""),
        F.concat(F.lit("# 📚 All Saved Links ("), "n", F.lit(")")), F.lit("")], page)
    names = manifest.select("collection").distinct()
    opened = _fixed(names, 1, 0, [F.concat(F.lit("## 📁 "), "collection"), F.lit("")], page, F.col("collection"))
    closed = _fixed(names, 1, 2, [F.lit("")], page, F.col("collection"))
    listed = collection_lines(manifest).select(*_line(1, 1, F.col("line"), page, F.col("collection"), F.col("slug"), F.col("link_id")))
    # the graph section only exists where there is an edge; a count says so without a global limit
    some = edges.agg(F.count("*").alias("n")).where("n > 0")
    graph_head = _fixed(some, 2, 0, [F.lit("## 🔗 Backlinks Graph"), F.lit("")], page)
    graph = rl.graph_lines(edges, ordered=False).select(*_line(3, 0, F.col("line"), page, F.col("target"), F.col("source")))
    chart_head = _fixed(some, 4, 0, [F.lit(""), F.lit("```mermaid"), F.lit("graph LR")], page)
    chart = rl.mermaid_lines(edges, ordered=False).select(*_line(5, 0, F.col("line"), page, F.col("target"), F.col("source")))
    chart_tail = _fixed(some, 6, 0, [F.lit("```"), F.lit("")], page)
    parts = [head, opened, listed, closed, graph_head, graph, chart_head, chart, chart_tail]
    return reduce(DataFrame.unionByName, parts).orderBy(*LINE_KEYS)


def tag_pages(titles: DataFrame, as_of: Column) -> DataFrame:
    """Ordered lines of all tag pages, from (tag, link_id, title, collection).

    Tags with one slug share a file: their sections follow each other, by tag name.
    """
    slug = strings.wikilink_slug(F.col("tag"))
    page = F.concat(F.lit("by-tag/"), slug, F.lit(".md"))
    counts = titles.groupBy("tag").agg(F.count("*").cast("string").alias("n"))
    head = _fixed(counts, 0, 0, [
        F.lit("---"), F.concat(F.lit('title: "Tag: #'), "tag", F.lit('"')), F.concat(F.lit("tag: "), "tag"),
        F.concat(F.lit("count: "), "n"), F.concat(F.lit("updated: "), notes.iso_instant(as_of)), F.lit("---"), F.lit(""),
        F.concat(F.lit("# #"), "tag"), F.lit(""), F.concat(F.lit("**"), "n", F.lit(" links** with this tag:")), F.lit("")],
        page, F.col("tag"))
    line = F.concat(F.lit("- [["), strings.wikilink_slug(F.col("title")), F.lit("|"), "title", F.lit("]] — `"), "collection", F.lit("`"))
    body = titles.select(*_line(0, 1, line, page, F.col("tag"), F.col("title"), F.col("link_id")))
    return head.unionByName(body).orderBy(*LINE_KEYS)


def shared_tag_files(tags: DataFrame) -> DataFrame:
    """(slug, tags): how many tags end up in one file, where it is more than one."""
    return tags.groupBy(strings.wikilink_slug(F.col("name")).alias("slug")).agg(F.count("*").alias("tags")).where("tags > 1")


# characters that Spark writes as %XX in the name of a folder
_ESCAPED = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def page_folder(page: str | None) -> str:
    name = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", page) if page else "__HIVE_DEFAULT_PARTITION__"
    return f"page={name}"


# beside the pages: which files they have and how many lines; Spark's readers pass over the name
FILE_LISTS = "_lists/files"
# lines that a task reads
TASK_LINES = 200_000
# rows and characters of a batch, bytes read at once
BATCH_LINES, BATCH_TEXT, READ_BYTES = 2_000, 1 << 22, 1 << 20
# what ends a line for Spark's text reader
LINE_END = re.compile(rb"\r\n|\n|\r")


def _page_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        part = f"part-{TaskContext.get().partitionId():05d}"
        now, out, aside, written, lines = None, None, None, 0, 0
        lists = posixpath.join(base, FILE_LISTS)
        system.create_dir(lists, recursive=True)
        listed = posixpath.join(lists, f"_{part}.{uuid4().hex}")

        def close() -> None:
            if out:
                out.close()
                system.move(aside, posixpath.join(base, page_folder(now[0]), f"{part}.txt"))
                files.write(f"{json.dumps({'page': now[0], 'file': f'{part}.txt', 'lines': lines})}\n".encode())

        with system.open_output_stream(listed) as files:
            for batch in batches:
                for page, line in zip(batch.column("page").to_pylist(), batch.column("line").to_pylist()):
                    page = page or None  # no page and the empty one, which follow each other, have one folder
                    if now != (page,):
                        close()
                        now, written, lines = (page,), written + 1, 0
                        place = posixpath.join(base, page_folder(page))
                        system.create_dir(place, recursive=True)
                        aside = posixpath.join(place, f"_{part}.{uuid4().hex}")
                        out = system.open_output_stream(aside)
                    text = f"{line or ''}\n".encode()
                    lines += len(LINE_END.findall(text))
                    out.write(text)
            close()
        system.move(listed, posixpath.join(lists, f"{part}.txt"))
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["pages"])
    return write


def write_lines(lines: DataFrame, folder: str) -> None:
    """Write pages of lines as text: one folder per page, its parts in order.

    Pages may be very many, so tasks put their files in place themselves and list them; Spark's writer would move each folder in
    the driver. It only writes where Arrow does not know the file system, without lists. The folder is the caller's to publish when all is written.
    """
    ordered = lines.repartitionByRange(*LINE_KEYS).sortWithinPartitions(*LINE_KEYS)
    try:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        ordered.select("page", F.col("line").alias("value")).write.mode("overwrite").partitionBy("page").text(folder)
        return
    system.delete_dir_contents(base)
    ordered.select("page", "line").mapInArrow(_page_writer(folder), "pages long").agg(F.sum("pages")).collect()


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(page, n, line): lines of written pages with their number, parts in the order of their names, lines as they stand.

    Files come from the lists of the tasks that wrote them and are opened by the tasks that read them: the driver sees none.
    """
    files = spark.read.schema("page string, file string, lines bigint").json(posixpath.join(folder, FILE_LISTS))
    # numbers run on from file to file, so no task sees more of a page than a file
    before = F.sum("lines").over(Window.partitionBy("page").orderBy("file")) - F.col("lines")
    tasks = (files.agg(F.sum("lines")).first()[0] or 0) // TASK_LINES + spark.sparkContext.defaultParallelism
    dealt = files.withColumn("before", before).select("page", "file", "before").repartition(int(tasks), "page", "file")
    return dealt.mapInArrow(_page_reader(folder), "page string, n int, line string")


def _page_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        pages, numbers, lines, size = [], [], [], 0

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(pages, pa.string()), pa.array(numbers, pa.int32()), pa.array(lines, pa.string())], ["page", "n", "line"])

        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(posixpath.join(base, page_folder(row["page"]), row["file"])) as stream:
                    for n, line in enumerate(_lines_of(stream), row["before"] + 1):
                        pages.append(row["page"])
                        numbers.append(n)
                        lines.append(line)
                        size += len(line)
                        if len(lines) >= BATCH_LINES or size >= BATCH_TEXT:
                            yield taken()
                            pages, numbers, lines, size = [], [], [], 0
        if lines:
            yield taken()
    return read


def _lines_of(stream: pa.NativeFile) -> Iterator[str]:
    """Lines as Spark reads text: they end with a line feed, a carriage return or both."""
    rest = b""
    while block := stream.read(READ_BYTES):
        *whole, rest = LINE_END.split(rest + block)
        if not rest and block.endswith(b"\r"):  # the line feed may be next
            whole, rest = whole[:-1], whole[-1] + b"\r"
        for line in whole:
            yield line.decode(errors="replace")
    if rest:
        yield rest.removesuffix(b"\r").decode(errors="replace")
