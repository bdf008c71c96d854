"""Reads, joins and aggregates with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import status as st
from linkloom.operators import relational as rel
from linkloom.plans.registry import query
from linkloom.plans.scalars import q_escape, q_in
from linkloom.sources.schemas import ENTITIES
from linkloom.sources.tables import read_entity, read_pages
from linkloom.streaming.flows import work_folder

TAGS_SQL = "SELECT lt.link_id, string_agg(t.name, '|' ORDER BY t.name) AS tags FROM v_link_tags lt JOIN v_tags t ON t.id = lt.tag_id GROUP BY 1"


def joined(tags="tags"):
    return F.array_join(tags, "|").alias("tags")


# ---- sources -----------------------------------------------------------------------------------


# a column of each entity beside its key
_SHOWN = {"users": "email", "links": "url", "collections": "slug", "tags": "name", "link_tags": "tag_id", "export_jobs": "status"}


@query("src_tables", " UNION ALL ".join(
    f"SELECT '{name}' AS entity, {'link_id' if name == 'link_tags' else 'id'} AS id, {shown}::VARCHAR AS shown FROM v_{name}"
    for name, shown in _SHOWN.items()))
def src_tables(t):
    """Every entity stored under its schema and read back."""
    folder = work_folder(t.spark, "entities")
    out = None
    for name, shown in _SHOWN.items():
        rows = getattr(t, name)
        fields = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTITIES[name]]
        rows.select(*fields).write.parquet(f"{folder}/{name}")
        key = "link_id" if name == "link_tags" else "id"
        part = read_entity(t.spark, folder, name).select(
            F.lit(name).alias("entity"), F.col(key).alias("id"), F.col(shown).cast("string").alias("shown"))
        out = part if out is None else out.unionAll(part)
    return out


@query("src_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def src_pages(t):
    return read_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", "url", F.length("html").alias("chars"))


# ---- lookups and filters -----------------------------------------------------------------------


# every fourth request is another user's and finds nothing
_ASKED = """asked AS (SELECT o_orderkey AS id, o_custkey * 10 + 5 AS collection, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id
  FROM orders)"""


def asked(t, key):
    user = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return t.base("orders").select(key.alias("id"), user.alias("user_id"))


@query("link_by_id", f"""
WITH {_ASKED} SELECT l.id, l.url, l.title, l.status, l.collection_id, l.user_id, l.saved_at, l.parsed_at, l.indexed_at, d.text AS content_md,
  coalesce(g.tags, '') AS tags
FROM v_links l LEFT JOIN documents d ON d.doc_id = l.id LEFT JOIN ({TAGS_SQL}) g ON g.link_id = l.id
WHERE (l.id, l.user_id) IN (SELECT (id, user_id) FROM asked)""")
def link_by_id(t):
    full = rel.with_tags(rel.owned(t.full_links, asked(t, F.col("o_orderkey"))), t.link_tags, t.tags)
    return full.select("id", "url", "title", "status", "collection_id", "user_id", "saved_at", "parsed_at",
                       "indexed_at", "content_md", joined())


@query("links_for_user", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, id DESC) AS pos FROM v_links)
SELECT r.user_id, r.pos, r.id, r.url, r.title, r.status, r.saved_at, coalesce(g.tags, '') AS tags
FROM r LEFT JOIN ({TAGS_SQL}) g ON g.link_id = r.id WHERE pos <= 20""")
def links_for_user(t):
    page = rel.links_page(t.links, 20)
    return rel.with_tags(page, t.link_tags, t.tags).select(
        "user_id", "pos", "id", "url", "title", "status", "saved_at", joined())


@query("links_count_user", "SELECT user_id, count(*) AS total FROM v_links GROUP BY user_id")
def links_count_user(t):
    return t.links.groupBy("user_id").agg(F.count("*").alias("total"))


@query("links_not_indexed", """
SELECT id, url, coalesce(text, '') AS content_md FROM v_links LEFT JOIN documents ON doc_id = id WHERE status = 'parsed' AND indexed_at IS NULL""")
def links_not_indexed(t):
    return rel.links_not_indexed(t.full_links)


@query("collection_by_id", f"""
WITH {_ASKED} SELECT id, name, slug, user_id FROM v_collections WHERE (id, user_id) IN (SELECT (collection, user_id) FROM asked)""")
def collection_by_id(t):
    return rel.owned(t.collections, asked(t, F.col("o_custkey") * 10 + 5)).select("id", "name", "slug", "user_id")


@query("tags_for_link", """
SELECT lt.link_id, t.id, t.name FROM v_link_tags lt JOIN v_tags t ON t.id = lt.tag_id""")
def tags_for_link(t):
    return t.link_tags.join(t.tags, t.link_tags.tag_id == t.tags.id).select("link_id", "id", "name")


@query("export_jobs_for_link", """
SELECT link_id, id, status, vault_path, created_at, completed_at,
       row_number() OVER (PARTITION BY link_id ORDER BY created_at DESC, id DESC) AS pos FROM v_export_jobs""")
def export_jobs_for_link(t):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("link_id").orderBy(F.desc("created_at"), F.desc("id")))
    return t.export_jobs.select("link_id", "id", "status", "vault_path", "created_at", "completed_at", pos.alias("pos"))


@query("export_pending", """
SELECT id, link_id FROM v_export_jobs WHERE status = 'pending' ORDER BY created_at, id LIMIT 50""")
def export_pending(t):
    return rel.export_pending(t.export_jobs)


@query("reexport_eligible", """
WITH asked AS (SELECT o_orderkey AS link_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id FROM orders)
SELECT a.link_id, a.user_id, CASE WHEN l.id IS NULL THEN 'Link not found'
  WHEN l.status <> 'parsed' THEN 'Link not parsed yet (status: ' || l.status || ')' ELSE 'Re-export queued' END AS verdict
FROM asked a LEFT JOIN v_links l ON l.id = a.link_id AND l.user_id = a.user_id""")
def reexport_eligible(t):
    user = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    asked = t.base("orders").select(F.col("o_orderkey").alias("link_id"), user.alias("user_id"))
    return rel.reexport_verdict(t.links, asked)


def decorated(t):
    return rel.with_tags(rel.with_collection_name(t.links, t.collections), t.link_tags, t.tags)


_INBOX = f"""
SELECT l.id FROM v_links l LEFT JOIN v_collections c ON c.id = l.collection_id LEFT JOIN ({TAGS_SQL}) g ON g.link_id = l.id
WHERE {{family}} AND (coalesce(contains(lower(l.title), '{{needle}}'), false) OR contains(lower(l.url), '{{needle}}')
  OR contains(lower(coalesce(c.name, 'Unsorted')), '{{needle}}')
  OR len(list_filter(string_split(coalesce(g.tags, ''), '|'), lambda s: contains(lower(s), '{{needle}}'))) > 0)"""


@query("inbox_filter",
       "SELECT 'ready' AS tab, id FROM (" + _INBOX.format(family=q_in("l.status", st.READY_LINK), needle="red") + ") a "
       "UNION ALL SELECT 'parsing', id FROM (" + _INBOX.format(family=q_in("l.status", st.ACTIVE_LINK), needle="later") + ") b")
def inbox_filter(t):
    ready = rel.inbox_filter(decorated(t), "ready", "Red").select(F.lit("ready").alias("tab"), "id")
    return ready.unionAll(rel.inbox_filter(decorated(t), "parsing", " later ").select(F.lit("parsing"), "id"))


@query("local_search", f"""
SELECT l.id, coalesce(l.title, l.url) AS title, l.url, coalesce(c.name, 'Unsorted') AS collection, coalesce(g.tags, '') AS tags,
  regexp_replace({q_escape('coalesce(l.title, l.url)')}, '(?i)(high)', '<mark>\\1</mark>', 'g') AS snippet
FROM v_links l LEFT JOIN v_collections c ON c.id = l.collection_id LEFT JOIN ({TAGS_SQL}) g ON g.link_id = l.id
WHERE coalesce(contains(lower(l.title), 'high'), false) OR contains(lower(l.url), 'high')
  OR contains(lower(coalesce(c.name, 'Unsorted')), 'high') OR contains(lower(coalesce(g.tags, '')), 'high')""")
def local_search(t):
    return rel.local_search(decorated(t), "HIGH").withColumn("tags", joined())


@query("result_facet_filter", """
SELECT d.id, d.title, d.collection FROM v_doc_links d WHERE d.collection = 'src3'
  AND EXISTS (SELECT 1 FROM v_doc_tags g WHERE g.link_id = d.id AND g.tag = 'en')""")
def result_facet_filter(t):
    names = t.doc_tags.groupBy(F.col("link_id").alias("id")).agg(F.collect_list("tag").alias("tags"))
    hits = t.doc_links.select("id", "title", "collection").join(names, "id")
    return rel.facet_filter(hits, "src3", "en").select("id", "title", "collection")


# ---- joins -------------------------------------------------------------------------------------


@query("join_link_collection", """
SELECT l.id, l.url, l.user_id, coalesce(c.slug, 'unsorted') AS collection FROM v_links l LEFT JOIN v_collections c ON c.id = l.collection_id""")
def join_link_collection(t):
    return rel.with_collection(t.links, t.collections).select("id", "url", "user_id", "collection")


@query("join_link_tags", TAGS_SQL)
def join_link_tags(t):
    return rel.link_tag_names(t.link_tags, t.tags).select("link_id", joined())


_TAGGED = """
SELECT t.name AS tag, l.id AS link_id, l.title, coalesce(c.slug, 'unsorted') AS collection
FROM v_tags t JOIN v_link_tags lt ON lt.tag_id = t.id JOIN v_links l ON l.id = lt.link_id
LEFT JOIN v_collections c ON c.id = l.collection_id WHERE l.status = 'parsed' AND l.title IS NOT NULL"""


@query("join_tag_link_collection", _TAGGED)
def join_tag_link_collection(t):
    return rel.tagged_titles(t.tags, t.link_tags, t.links, t.collections)


@query("join_tag_link_one", _TAGGED + " AND t.name = 'red widget 1'")
def join_tag_link_one(t):
    return rel.tagged_titles(t.tags, t.link_tags, t.links, t.collections, "red widget 1")


@query("selfjoin_shared_tags", """
SELECT a.link_id, count(b.link_id) AS partners FROM v_link_tags a LEFT JOIN v_link_tags b
  ON a.tag_id = b.tag_id AND a.link_id <> b.link_id GROUP BY a.link_id""")
def selfjoin_shared_tags(t):
    return rel.partner_counts(t.link_tags)


@query("semi_in_subquery", """
SELECT id, title FROM v_links WHERE id IN (SELECT link_id FROM v_link_tags WHERE tag_id IN
  (SELECT tag_id FROM v_link_tags GROUP BY tag_id HAVING count(*) >= 2))""")
def semi_in_subquery(t):
    return rel.links_sharing_tags(t.links, t.link_tags).select("id", "title")


@query("existence_or", """
WITH x AS (SELECT l.id,
  EXISTS (SELECT 1 FROM v_link_tags a JOIN v_link_tags b ON a.tag_id = b.tag_id AND a.link_id <> b.link_id WHERE a.link_id = l.id) AS by_tag,
  EXISTS (SELECT 1 FROM v_links o WHERE o.collection_id = l.collection_id AND o.id <> l.id) AS by_collection
  FROM v_links l WHERE l.status = 'parsed' AND l.title IS NOT NULL)
SELECT * FROM x WHERE by_tag OR by_collection""")
def existence_or(t):
    return rel.links_with_candidates(t.links, t.link_tags)


@query("scalar_subquery", """
SELECT l.id, (SELECT count(*) FROM v_link_tags lt WHERE lt.link_id = l.id) AS n_tags,
       (SELECT count(*) FROM v_export_jobs j WHERE j.link_id = l.id) AS n_jobs FROM v_links l""")
def scalar_subquery(t):
    # the correlated counts decorrelate to one aggregate and one left join each
    return t.spark.sql("""
        SELECT l.id, (SELECT count(*) FROM {lt} lt WHERE lt.link_id = l.id) AS n_tags,
               (SELECT count(*) FROM {jobs} j WHERE j.link_id = l.id) AS n_jobs FROM {links} l""",
                       links=t.links, lt=t.link_tags, jobs=t.export_jobs)


@query("ui_collection_name", """
SELECT l.id, coalesce(c.name, 'Unsorted') AS collection_name FROM v_links l LEFT JOIN v_collections c ON c.id = l.collection_id""")
def ui_collection_name(t):
    return rel.with_collection_name(t.links, t.collections).select("id", "collection_name")


@query("orphan_anti", """
WITH kept AS (SELECT * FROM v_links WHERE status <> 'failed')
SELECT 'link_tags' AS child, link_id AS parent_id FROM v_link_tags WHERE link_id NOT IN (SELECT id FROM kept)
UNION ALL SELECT 'export_jobs', link_id FROM v_export_jobs WHERE link_id NOT IN (SELECT id FROM kept)
UNION ALL SELECT 'links', collection_id FROM kept WHERE collection_id IS NOT NULL
  AND collection_id NOT IN (SELECT id FROM v_collections WHERE name <> 'Reading/Later/3-MEDIUM')""")
def orphan_anti(t):
    kept = t.links.where(F.col("status") != "failed")
    gone = [("link_tags", rel.orphans(t.link_tags, "link_id", kept), "link_id"),
            ("export_jobs", rel.orphans(t.export_jobs, "link_id", kept), "link_id"),
            ("links", rel.orphans(kept, "collection_id", t.collections.where(F.col("name") != "Reading/Later/3-MEDIUM")), "collection_id")]
    parts = [df.select(F.lit(name).alias("child"), F.col(key).alias("parent_id")) for name, df, key in gone]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# ---- aggregates --------------------------------------------------------------------------------


@query("collections_with_counts", """
SELECT c.user_id, c.id, c.name, c.slug, count(l.id) AS link_count FROM v_collections c LEFT JOIN v_links l ON l.collection_id = c.id
GROUP BY ALL""")
def collections_with_counts(t):
    return rel.collections_with_counts(t.collections, t.links).select("user_id", "id", "name", "slug", "link_count")


@query("tags_with_counts", """
SELECT t.id, t.name, count(lt.link_id) AS link_count FROM v_tags t LEFT JOIN v_link_tags lt ON lt.tag_id = t.id
GROUP BY ALL ORDER BY link_count DESC, t.name""")
def tags_with_counts(t):
    return rel.tags_with_counts(t.tags, t.link_tags).orderBy(F.desc("link_count"), "name").select(
        "id", "name", "link_count")


@query("index_lag", "SELECT count(*) FILTER (WHERE status = 'parsed' AND indexed_at IS NULL) AS lag FROM v_links")
def index_lag(t):
    return rel.index_lag(t.links)


@query("status_counts", f"""
SELECT user_id, count(*) FILTER (WHERE {q_in('status', st.READY_LINK)}) AS ready,
       count(*) FILTER (WHERE {q_in('status', st.ACTIVE_LINK)}) AS in_progress FROM v_links GROUP BY user_id""")
def status_counts(t):
    return rel.status_counts(t.links)


@query("collection_tree", """
WITH counted AS (SELECT c.id, c.user_id, c.name, count(l.id) AS n FROM v_collections c LEFT JOIN v_links l ON l.collection_id = c.id GROUP BY ALL),
parts AS (SELECT *, string_split(name, '/') AS p FROM counted),
nodes AS (SELECT user_id, n, len(p) AS deep, unnest(range(1, len(p) + 1)) AS d, p FROM parts)
SELECT user_id, array_to_string(p[1:d], '/') AS path, p[d] AS label, (d - 1)::INT AS depth,
       sum(CASE WHEN d = deep THEN n ELSE 0 END)::BIGINT AS own_count, sum(n)::BIGINT AS tree_count
FROM nodes GROUP BY ALL""")
def collection_tree(t):
    return rel.collection_tree(rel.collections_with_counts(t.collections, t.links))


@query("jobs_per_link", "SELECT link_id, count(*) AS jobs FROM v_export_jobs GROUP BY 1")
def jobs_per_link(t):
    return rel.jobs_per_link(t.export_jobs)


@query("export_entries", """
SELECT id, link_id, status, link_id || '-' || (row_number() OVER (PARTITION BY link_id ORDER BY created_at DESC, id DESC) - 1) AS key FROM v_export_jobs""")
def export_entries(t):
    return rel.export_entries(t.export_jobs).select("id", "link_id", "status", "key")


@query("export_work_pending", f"""
SELECT l.user_id, bool_or(j.link_id IS NULL OR {q_in('j.status', st.ACTIVE_EXPORT)}) AS pending
FROM v_links l LEFT JOIN v_export_jobs j ON j.link_id = l.id GROUP BY 1""")
def export_work_pending(t):
    return rel.export_work_pending(t.links, t.export_jobs)


@query("distinct_titles", "SELECT DISTINCT title FROM v_doc_links")
def distinct_titles(t):
    return t.doc_links.select("title").distinct()


@query("latency_histogram", """
WITH s AS (SELECT epoch(parsed_at) - epoch(saved_at) AS x FROM v_links WHERE parsed_at IS NOT NULL)
SELECT b.le, count(*) FILTER (WHERE b.le IS NULL OR x <= b.le) AS n FROM s, (VALUES (1), (5), (10), (30), (60), (120), (NULL)) b(le) GROUP BY b.le""")
def latency_histogram(t):
    return rel.latency_histogram(t.links)


# ---- latest and newest -------------------------------------------------------------------------

_LATEST = """SELECT id, link_id, status, vault_path FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY {order} DESC NULLS LAST, id DESC) AS pos
FROM v_export_jobs WHERE {where}) WHERE pos = 1"""


@query("export_latest_success", _LATEST.format(order="completed_at", where="status = 'done'"))
def export_latest_success(t):
    return rel.latest_success(t.export_jobs).select("id", "link_id", "status", "vault_path")


@query("export_latest_path", _LATEST.format(order="coalesce(completed_at, created_at)", where="vault_path IS NOT NULL"))
def export_latest_path(t):
    return rel.latest_path(t.export_jobs).select("id", "link_id", "status", "vault_path")


@query("collection_top6", """
SELECT collection_id, pos, id FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY saved_at DESC, id DESC) AS pos
FROM v_links WHERE collection_id IS NOT NULL) WHERE pos <= 6""")
def collection_top6(t):
    return rel.newest_in_collection(t.links).select("collection_id", "pos", "id")


@query("page_with_total", """
SELECT user_id, pos, id, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, id DESC) AS pos,
  count(*) OVER (PARTITION BY user_id) AS total FROM v_links) WHERE pos > 5 AND pos <= 15""")
def page_with_total(t):
    return rel.page_with_total(t.links, 10, 5).select("user_id", "pos", "id", "total")
