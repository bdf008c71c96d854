"""Vault queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import relational as rel
from linkloom.operators import related as rl
from linkloom.operators import vault
from linkloom.plans.registry import query
from linkloom.plans.related import _EDGES, _TOP5, doc_link_tags, doc_links
from linkloom.plans.relational import _TAGGED
from linkloom.plans.scalars import (AS_OF, q_dir, q_front, q_iso, q_margin, q_minutes, q_note_path, q_stem, q_tags_yaml,
                                    q_wikilink)
from linkloom.functions import strings
from linkloom.sources.versions import Files, VersionedFolder
from linkloom.streaming.flows import work_folder

NL = "chr(10)"
ISO = "2024-06-01T12:00:00Z"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# ---- notes -------------------------------------------------------------------------------------


def doc_notes(t):
    """Notes of the documents: tags language and source, collection the source, related by shared tags."""
    related = vault.related_slugs(doc_links(t), doc_link_tags(t))
    rows = t.doc_links.withColumns({
        "tags": F.array_sort(F.array(F.col("collection"))), "minutes": strings.reading_minutes(F.col("content")),
        "export_directory": F.lit(None).cast("string"), "export_file_name": F.lit(None).cast("string")})
    return vault.render_notes(rows.join(related, "id", "left"), as_of())


_DOC_REL = f"""
pairs AS (SELECT a.doc_id AS link_id, b.doc_id AS rel_id, (CASE WHEN a.lang = b.lang THEN 1 ELSE 0 END) + (CASE WHEN a.source = b.source THEN 1 ELSE 0 END) AS n
  FROM documents a JOIN documents b ON a.doc_id <> b.doc_id AND (a.lang = b.lang OR a.source = b.source)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY n DESC, rel_id) AS pos FROM pairs) WHERE pos <= 5),
rel AS (SELECT b.link_id, string_agg('[[' || {q_wikilink('d.title')} || ']]', {NL} ORDER BY pos) AS lines FROM best b JOIN v_doc_links d ON d.id = b.rel_id GROUP BY 1)"""


def q_note_text(header, title, body, lines):
    section = f"CASE WHEN {lines} IS NULL THEN '' ELSE {NL} || {NL} || '## Related' || {NL} || {lines} || {NL} END"
    return q_margin(f"{header} || {NL} || '|' || {NL} || '|# ' || {title} || {NL} || '|' || {NL} || '|' || {body} || {NL} || '|' || {section}")


@query("sink_notes", f"""
WITH {_DOC_REL} SELECT d.id AS link_id, {q_note_path('NULL::VARCHAR', 'NULL::VARCHAR', 'd.title', 'd.collection')} AS path,
  {q_note_text(q_front('d.title', 'd.url', '[d.collection]', f"coalesce({q_dir('d.collection')}, 'unsorted')", q_minutes('d.content'), 'd.id'), 'd.title', 'd.content', 'rel.lines')} AS content
FROM v_doc_links d LEFT JOIN rel ON rel.link_id = d.id""")
def sink_notes(t):
    return doc_notes(t).select("link_id", "path", "content")


_LIST = "SELECT lt.link_id, list(t.name ORDER BY t.name) AS tags FROM v_link_tags lt JOIN v_tags t ON t.id = lt.tag_id GROUP BY 1"
_PATH = q_note_path("l.export_directory", "l.export_file_name", "coalesce(l.title, '')", "coalesce(c.slug, 'unsorted')")
_NOTES = _TOP5 + f""", rel AS (SELECT link_id, string_agg('[[' || slug || ']]', {NL} ORDER BY pos) AS lines FROM top5 GROUP BY 1),
notes AS (SELECT l.id AS link_id, {_PATH} AS path, {q_stem("coalesce(l.export_file_name, coalesce(l.title, ''))")} AS slug,
  coalesce({q_dir("coalesce(c.slug, 'unsorted')")}, 'unsorted') AS collection, '{ISO}' AS updated_at,
  {q_note_text(q_front("coalesce(l.title, '')", 'l.url', 'coalesce(g.tags, [])', f"coalesce({q_dir(chr(99) + 'oalesce(c.slug, ' + repr('unsorted') + ')')}, 'unsorted')", 'coalesce(l.reading_time_min, 1)', 'l.id'), "coalesce(l.title, '')", "coalesce(d.text, '')", 'rel.lines')} AS content
  FROM v_links l LEFT JOIN documents d ON d.doc_id = l.id LEFT JOIN v_collections c ON c.id = l.collection_id LEFT JOIN ({_LIST}) g ON g.link_id = l.id
  LEFT JOIN rel ON rel.link_id = l.id WHERE l.status = 'parsed')"""


def link_notes(t):
    return vault.export_notes(t.full_links, t.tag_edges, t.tags, t.collections, as_of())


@query("export_notes", _NOTES + "SELECT link_id, path, slug, collection, content, 'done' AS status FROM notes")
def export_notes(t):
    return link_notes(t).select("link_id", "path", "slug", "collection", "content", F.lit("done").alias("status"))


@query("sink_download", f"""
SELECT l.id, {q_wikilink("coalesce(l.title, 'untitled')")} || '.md' AS file_name,
  '---' || {NL} || 'title: "' || coalesce(l.title, 'untitled') || '"' || {NL} || 'url: "' || l.url || '"' || {NL} || 'tags: ' || {q_tags_yaml('coalesce(g.tags, [])')} || {NL}
  || 'saved_at: ' || {q_iso('l.saved_at')} || {NL} || 'parsed_at: ' || coalesce({q_iso('l.parsed_at')}, '') || {NL} || 'reading_time: ' || l.reading_time_min || 'min' || {NL}
  || '---' || {NL} || {NL} || '# ' || coalesce(l.title, 'untitled') || {NL} || {NL} || coalesce(d.text, '') || {NL} AS content
FROM v_links l LEFT JOIN documents d ON d.doc_id = l.id LEFT JOIN ({_LIST}) g ON g.link_id = l.id""")
def sink_download(t):
    rows = rel.with_tags(t.full_links, t.link_tags, t.tags).withColumnRenamed("content_md", "content")
    return vault.downloads(rows)


# ---- manifest ----------------------------------------------------------------------------------
# the old manifest: finished exports; the new notes: all parsed links


def note_rows(t):
    """Note rows without their text (path, slug, collection) of all parsed links."""
    rows = rel.with_collection(t.links.where(F.col("status") == "parsed"), t.collections)
    title = F.coalesce("title", F.lit(""))
    return rows.select(
        F.col("id").alias("link_id"),
        strings.note_path(F.col("export_directory"), F.col("export_file_name"), title, F.col("collection")).alias("path"),
        strings.file_stem(F.coalesce("export_file_name", title)).alias("slug"),
        strings.collection_directory(F.col("collection")).alias("collection"), F.lit(ISO).alias("updated_at"))


_ROWS = f"""fresh AS (SELECT l.id AS link_id, {_PATH} AS path, {q_stem("coalesce(l.export_file_name, coalesce(l.title, ''))")} AS slug,
  coalesce({q_dir("coalesce(c.slug, 'unsorted')")}, 'unsorted') AS collection, '{ISO}' AS updated_at
  FROM v_links l LEFT JOIN v_collections c ON c.id = l.collection_id WHERE l.status = 'parsed'),
old AS (SELECT link_id, vault_path AS path, 'n' || link_id AS slug, split_part(vault_path, '/', 2) AS collection, 'before' AS updated_at
  FROM v_export_jobs WHERE vault_path IS NOT NULL AND link_id NOT IN (SELECT user_id FROM events)
  UNION ALL SELECT DISTINCT 1000000000 + user_id, 'collections/gone/g' || user_id || '.md', 'g' || user_id, 'gone', 'before' FROM events)"""


def old_manifest(t):
    events = t.base("events").select("user_id").distinct()
    exported = t.export_jobs.where(F.col("vault_path").isNotNull()).join(
        events.withColumnRenamed("user_id", "link_id"), "link_id", "left_anti").select(
        "link_id", F.col("vault_path").alias("path"), F.concat(F.lit("n"), "link_id").alias("slug"),
        F.split_part("vault_path", F.lit("/"), F.lit(2)).alias("collection"), F.lit("before").alias("updated_at"))
    g = F.concat(F.lit("g"), "user_id")
    gone = events.select(
        (F.col("user_id") + 1000000000).alias("link_id"), F.concat(F.lit("collections/gone/"), g, F.lit(".md")).alias("path"),
        g.alias("slug"), F.lit("gone").alias("collection"), F.lit("before").alias("updated_at"))
    return exported.unionByName(gone)


@query("sink_manifest", f"WITH {_ROWS} SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE link_id NOT IN (SELECT link_id FROM fresh)")
def sink_manifest(t):
    # the manifest before, then the one after new notes, made from it
    folder = VersionedFolder(t.spark, work_folder(t.spark, "manifest"))
    first = folder.publish(lambda place: vault.write_manifest(old_manifest(t), place))
    before = vault.read_manifest(t.spark.read.text(folder.current(first)))
    folder.publish(lambda place: vault.write_manifest(vault.manifest_upsert(before, note_rows(t)), place), first)
    return vault.read_manifest(t.spark.read.text(folder.current()))


@query("note_moves", f"WITH {_ROWS} SELECT o.link_id, o.path AS old_path, f.path FROM old o JOIN fresh f ON f.link_id = o.link_id WHERE o.path <> f.path")
def note_moves(t):
    return vault.note_moves(old_manifest(t), note_rows(t))


_GONE = "gone AS (SELECT link_id FROM old WHERE link_id >= 1000000000 OR link_id IN (SELECT id FROM v_links WHERE collection_id IS NULL))"


def gone_links(t):
    loose = t.links.where(F.col("collection_id").isNull()).select(F.col("id").alias("link_id"))
    return loose.unionAll(t.base("events").select((F.col("user_id") + 1000000000).alias("link_id")))


@query("sink_note_delete", f"""
WITH {_ROWS}, {_GONE} SELECT 'kept' AS part, link_id, path, NULL AS assets FROM old WHERE link_id NOT IN (SELECT link_id FROM gone)
UNION ALL SELECT 'deleted', link_id, path, regexp_replace(path, '/[^/]*$', '') || '/assets/' || link_id || '_*' FROM old WHERE link_id IN (SELECT link_id FROM gone)""")
def sink_note_delete(t):
    left, deleted = vault.note_delete(old_manifest(t), gone_links(t))
    kept = left.select(F.lit("kept").alias("part"), "link_id", "path", F.lit(None).cast("string").alias("assets"))
    return kept.unionByName(deleted.withColumn("part", F.lit("deleted")))


@query("empty_dirs", f"""
WITH {_ROWS}, {_GONE}, d AS (SELECT link_id, regexp_replace(path, '/[^/]*$', '') AS dir FROM old)
SELECT DISTINCT dir FROM d WHERE link_id IN (SELECT link_id FROM gone) AND dir NOT IN (SELECT dir FROM d WHERE link_id NOT IN (SELECT link_id FROM gone))""")
def empty_dirs(t):
    _, deleted = vault.note_delete(old_manifest(t), gone_links(t))
    return vault.empty_dirs(old_manifest(t), deleted)


@query("src_vault_dirs", f"""
WITH {_ROWS}, p AS (SELECT DISTINCT string_split(regexp_replace(substring(path, 13), '/[^/]*$', ''), '/') AS p FROM fresh),
n AS (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM p) SELECT DISTINCT array_to_string(p[1:d], '/') AS dir FROM n""")
def src_vault_dirs(t):
    return vault.vault_dirs(note_rows(t))


@query("src_manifest", f"""
WITH {_ROWS} SELECT link_id, path, slug, collection, updated_at FROM fresh""")
def src_manifest(t):
    # each collection's notes as one manifest text, beside an unreadable one
    entry = F.struct(F.col("link_id").alias("linkId"), "path", "slug", "collection", F.col("updated_at").alias("updatedAt"))
    per_link = note_rows(t).select(
        F.to_json(F.struct(F.create_map(F.col("link_id").cast("string"), entry).alias("notes"))).alias("value"))
    broken = t.base("region").select(F.concat(F.lit('{"notes": {"'), "r_name").alias("value"))
    return vault.read_manifest(per_link.unionAll(broken))


@query("wikilink_extract", _NOTES + f""", found AS (SELECT DISTINCT link_id, slug AS target FROM top5 WHERE link_id IN (SELECT link_id FROM notes))
SELECT link_id, target FROM found WHERE target NOT IN (SELECT slug FROM notes)""")
def wikilink_extract(t):
    return vault.dangling_wikilinks(link_notes(t))


# ---- pages of lines ----------------------------------------------------------------------------


@query("notes_by_collection", f"WITH {_ROWS} SELECT collection, slug, link_id, '- [[' || slug || ']] — `' || collection || '`' AS line FROM fresh")
def notes_by_collection(t):
    return vault.collection_lines(note_rows(t)).orderBy("collection", "slug", "link_id")


_INDEX = _EDGES + f""", {_ROWS}, n AS (SELECT count(*)::VARCHAR AS n FROM fresh), names AS (SELECT DISTINCT collection FROM fresh),
lines AS (
  SELECT 0 AS part, '' AS key1, 0 AS sub, lpad((k - 1)::VARCHAR, 3, '0') AS key2, 0 AS link_id, ls[k] AS line FROM
    (SELECT ['---', 'title: All Links', 'total: ' || n, 'updated: {ISO}', '---', '', '# 📚 All Saved Links (' || n || ')', ''] AS ls FROM n), range(1, 9) r(k)
  UNION ALL SELECT 1, collection, 0, '000', 0, '## 📁 ' || collection FROM names UNION ALL SELECT 1, collection, 0, '001', 0, '' FROM names
  UNION ALL SELECT 1, collection, 1, slug, link_id, '- [[' || slug || ']] — `' || collection || '`' FROM fresh
  UNION ALL SELECT 1, collection, 2, '000', 0, '' FROM names
  UNION ALL SELECT 2, '', 0, '000', 0, '## 🔗 Backlinks Graph' UNION ALL SELECT 2, '', 0, '001', 0, ''
  UNION ALL SELECT 3, target, 0, source, 0, '- [[' || source || ']] → [[' || target || ']]' FROM edges
  UNION ALL SELECT 4, '', 0, '000', 0, '' UNION ALL SELECT 4, '', 0, '001', 0, '```mermaid' UNION ALL SELECT 4, '', 0, '002', 0, 'graph LR'
  UNION ALL SELECT 5, target, 0, source, 0, '    ' || source || ' --> ' || target FROM edges
  UNION ALL SELECT 6, '', 0, '000', 0, '```' UNION ALL SELECT 6, '', 0, '001', 0, '')
"""


def index_lines(t):
    return vault.index_document(note_rows(t), rl.backlink_edges(t.links, t.tag_edges), as_of())


@query("index_document", _INDEX + "SELECT '_index.md' AS page, part, key1, sub, key2, link_id, line FROM lines")
def index_document(t):
    return index_lines(t)


_TAG_LINES = f"""
WITH tt AS ({_TAGGED}), c AS (SELECT tag, count(*)::VARCHAR AS n FROM tt GROUP BY 1),
lines AS (SELECT tag, 0 AS sub, lpad((k - 1)::VARCHAR, 3, '0') AS key2, 0 AS link_id, ls[k] AS line FROM
  (SELECT tag, ['---', 'title: "Tag: #' || tag || '"', 'tag: ' || tag, 'count: ' || n, 'updated: {ISO}', '---', '', '# #' || tag, '', '**' || n || ' links** with this tag:', ''] AS ls FROM c), range(1, 12) r(k)
  UNION ALL SELECT tag, 1, title, link_id, '- [[' || {q_wikilink('title')} || '|' || title || ']] — `' || collection || '`' FROM tt)
"""


@query("tag_page", _TAG_LINES + f"SELECT 'by-tag/' || {q_wikilink('tag')} || '.md' AS page, 0 AS part, tag AS key1, sub, key2, link_id, line FROM lines")
def tag_page(t):
    return vault.tag_pages(rel.tagged_titles(t.tags, t.link_tags, t.links, t.collections), as_of())


def read_lines(t, folder):
    """Lines of written pages with their number; the files as the driver lists them where their writer has left no list."""
    if Files(t.spark, folder).exists(f"{folder}/{vault.FILE_LISTS}"):
        return vault.read_lines(t.spark, folder)
    rows = t.spark.read.option("basePath", folder).text(folder).select(
        "page", F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("at"))
    # numbers run on from file to file, so no task sees more of a page than a file
    files = rows.groupBy("page", "path", "file").agg(F.count(F.lit(1)).alias("lines"))
    before = files.select("path", (F.sum("lines").over(Window.partitionBy("page").orderBy("file")) - F.col("lines")).alias("before"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    return rows.withColumn("place", place).join(before, "path").select(
        "page", (F.col("place") + F.col("before")).cast("int").alias("n"), "line")


@query("sink_index", _INDEX + "SELECT '_index.md' AS page, row_number() OVER (ORDER BY part, key1, sub, key2, link_id) AS n, line FROM lines")
def sink_index(t):
    folder = VersionedFolder(t.spark, work_folder(t.spark, "index-pages"))
    folder.publish(lambda place: vault.write_lines(index_lines(t), place))
    return read_lines(t, folder.current())


@query("sink_tag_pages", _TAG_LINES + f"""SELECT 'by-tag/' || {q_wikilink('tag')} || '.md' AS page,
  row_number() OVER (PARTITION BY {q_wikilink('tag')} ORDER BY tag, sub, key2, link_id) AS n, line FROM lines""")
def sink_tag_pages(t):
    folder = VersionedFolder(t.spark, work_folder(t.spark, "tag-pages"))
    lines = vault.tag_pages(rel.tagged_titles(t.tags, t.link_tags, t.links, t.collections), as_of())
    folder.publish(lambda place: vault.write_lines(lines, place))
    return read_lines(t, folder.current())


# ---- exports again and exports deleted ---------------------------------------------------------
# asked: links without a collection


def asked_links(t):
    return t.links.where(F.col("collection_id").isNull()).select(F.col("id").alias("link_id"))


_ASKED = "asked AS (SELECT id AS link_id FROM v_links WHERE collection_id IS NULL)"
_OLD_FILES = """files AS (SELECT link_id, vault_path AS path FROM v_export_jobs WHERE status = 'done' AND vault_path IS NOT NULL
  AND link_id IN (SELECT link_id FROM asked))"""


@query("delete_exports", f"""
WITH {_ROWS}, {_ASKED}, {_OLD_FILES} SELECT 'job' AS part, link_id, CASE WHEN status = 'done' AND link_id IN (SELECT link_id FROM asked) THEN 'deleted' ELSE status END AS value,
  CASE WHEN status = 'done' AND link_id IN (SELECT link_id FROM asked) THEN CAST('{AS_OF}' AS TIMESTAMP) ELSE completed_at END AS at_time FROM v_export_jobs
UNION ALL SELECT 'note', link_id, path, NULL FROM old WHERE path NOT IN (SELECT path FROM files)
UNION ALL SELECT 'file', link_id, path, NULL FROM files""")
def delete_exports(t):
    jobs = t.export_jobs.withColumn("error_msg", F.lit(None).cast("string"))
    new_jobs, manifest, files = vault.delete_exports(jobs, old_manifest(t), asked_links(t), as_of())
    none = F.lit(None).cast("timestamp_ntz")
    out = new_jobs.select(F.lit("job").alias("part"), "link_id", F.col("status").alias("value"), F.col("completed_at").alias("at_time"))
    return out.unionAll(manifest.select(F.lit("note"), "link_id", "path", none)).unionAll(
        files.select(F.lit("file"), "link_id", "path", none))


@query("reexport_notes", f"""
WITH {_ROWS}, {_ASKED}, {_OLD_FILES}, new AS (SELECT link_id, path FROM fresh WHERE link_id IN (SELECT link_id FROM asked))
SELECT 'note' AS part, link_id, path FROM new
UNION ALL SELECT 'note', link_id, path FROM old WHERE link_id NOT IN (SELECT link_id FROM new) AND path NOT IN (SELECT path FROM files)
UNION ALL SELECT 'file', link_id, path FROM files WHERE path NOT IN (SELECT path FROM new)""")
def reexport_notes(t):
    manifest, files = vault.reexport_notes(t.export_jobs, old_manifest(t), note_rows(t), asked_links(t))
    return manifest.select(F.lit("note").alias("part"), "link_id", "path").unionAll(files.select(F.lit("file"), "link_id", "path"))
