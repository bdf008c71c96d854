"""Write rules applied to batches drawn from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import changes
from linkloom.plans.registry import query
from linkloom.plans.scalars import JS, q_tidy


def jobs_table(t):
    return t.export_jobs.withColumn("error_msg", F.when(F.col("status") == "failed", "unreachable"))


_JOBS = "jobs AS (SELECT *, CASE WHEN status = 'failed' THEN 'unreachable' END AS error_msg FROM v_export_jobs)"

# ---- tags --------------------------------------------------------------------------------------
# new names: every part type, in upper and lower case, beside the existing tag names


@query("tag_upsert", """
WITH names AS (SELECT p_type AS name FROM part UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT upper(name) || ' ' FROM v_tags),
fresh AS (SELECT min(name) AS name FROM names WHERE lower(rtrim(name)) NOT IN (SELECT lower(name) FROM v_tags) GROUP BY lower(rtrim(name)))
SELECT id, name FROM v_tags UNION ALL
SELECT (SELECT max(id) FROM v_tags) + row_number() OVER (ORDER BY md5(name)), name FROM fresh""")
def tag_upsert(t):
    part = t.base("part").select(F.col("p_type").alias("name"))
    names = part.unionAll(part.select(F.lower("name"))).unionAll(t.tags.select(F.concat(F.upper("name"), F.lit(" "))))
    return changes.tag_upsert(t.tags, names)


_ATTACH = "edges AS (SELECT l_orderkey AS link_id, l_suppkey AS tag_id FROM lineitem)"


def supplier_edges(t):
    return t.base("lineitem").select(F.col("l_orderkey").alias("link_id"), F.col("l_suppkey").alias("tag_id"))


@query("link_tags_attach", f"WITH {_ATTACH} SELECT link_id, tag_id FROM v_link_tags UNION SELECT link_id, tag_id FROM edges")
def link_tags_attach(t):
    return changes.link_tags_attach(t.link_tags, supplier_edges(t))


# updates come from urgent orders; those of 'P' orders name the wrong user and must change nothing
_UPDATES = """upd AS (SELECT o_orderkey AS link_id, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END AS user_id
  FROM orders WHERE o_orderpriority = '1-URGENT'),
owned AS (SELECT u.link_id FROM upd u JOIN v_links l ON l.id = u.link_id AND l.user_id = u.user_id)"""


def urgent(t):
    user = F.when(F.col("o_orderstatus") == "P", F.lit(-1)).otherwise(F.col("o_custkey")).cast("bigint")
    return t.base("orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("link_id"), user.alias("user_id"))


@query("link_tags_replace", f"""
WITH {_UPDATES}, {_ATTACH} SELECT link_id, tag_id FROM v_link_tags WHERE link_id NOT IN (SELECT link_id FROM owned)
UNION ALL SELECT DISTINCT link_id, tag_id FROM edges WHERE link_id IN (SELECT link_id FROM owned)""")
def link_tags_replace(t):
    return changes.link_tags_replace(t.link_tags, t.links, urgent(t), supplier_edges(t))


@query("link_tags_detach", f"""
WITH {_UPDATES} SELECT link_id, tag_id FROM v_link_tags WHERE link_id NOT IN (SELECT link_id FROM upd)""")
def link_tags_detach(t):
    return changes.link_tags_detach(t.link_tags, urgent(t))


# ---- links -------------------------------------------------------------------------------------


@query("link_insert", """
WITH old AS (SELECT id, sha256(url) AS url_hash, user_id FROM v_links),
cap AS (SELECT event_id AS seq, url, user_id, ts AS saved_at, sha256(url) AS url_hash FROM v_captures
  UNION ALL SELECT id, url, user_id, saved_at, sha256(url) FROM v_links),
first AS (SELECT *, row_number() OVER (PARTITION BY url_hash, user_id ORDER BY seq) AS rn FROM cap),
fresh AS (SELECT * FROM first WHERE rn = 1 AND (url_hash, user_id) NOT IN (SELECT (url_hash, user_id) FROM old))
SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY md5(user_id || ':' || url_hash)) AS id, seq, url, url_hash, user_id, saved_at, 'pending' AS status FROM fresh""")
def link_insert(t):
    old = t.links.withColumn("url_hash", F.sha2("url", 256))
    captures = t.captures.select(F.col("event_id").alias("seq"), "url", "user_id", F.col("ts").alias("saved_at"))
    again = t.links.select(F.col("id").alias("seq"), "url", "user_id", "saved_at")
    return changes.link_insert(old, captures.unionByName(again))


# every link is updated twice; the later update names another collection
@query("link_update", f"""
WITH {_UPDATES} SELECT l.id, l.user_id, l.status, CASE WHEN o.link_id IS NOT NULL THEN l.user_id * 10 + 5 ELSE l.collection_id END AS collection_id,
  CASE WHEN o.link_id IS NOT NULL THEN 'urgent' ELSE l.export_directory END AS export_directory,
  CASE WHEN o.link_id IS NOT NULL THEN NULL ELSE l.export_file_name END AS export_file_name
FROM v_links l LEFT JOIN owned o ON o.link_id = l.id""")
def link_update(t):
    def update(seq, collection, name):
        return urgent(t).select(F.lit(seq).alias("seq"), "link_id", "user_id", (F.col("user_id") * 10 + collection).alias("collection_id"),
                                F.lit("urgent").alias("export_directory"), F.lit(name).cast("string").alias("export_file_name"))

    return changes.link_update(t.links, update(2, 5, None).unionByName(update(1, 4, "early"))).select(
        "id", "user_id", "status", "collection_id", "export_directory", "export_file_name")


@query("link_delete", f"""
WITH {_UPDATES} SELECT 'links' AS part, id AS key, user_id AS other FROM v_links WHERE id NOT IN (SELECT link_id FROM owned)
UNION ALL SELECT 'link_tags', link_id, tag_id FROM v_link_tags WHERE link_id NOT IN (SELECT link_id FROM owned)
UNION ALL SELECT 'export_jobs', link_id, id FROM v_export_jobs WHERE link_id NOT IN (SELECT link_id FROM owned)""")
def link_delete(t):
    links, edges, jobs = changes.link_delete(t.links, urgent(t), t.link_tags, t.export_jobs)
    return links.select(F.lit("links").alias("part"), F.col("id").alias("key"), F.col("user_id").alias("other")).unionAll(
        edges.select(F.lit("link_tags"), "link_id", "tag_id")).unionAll(
        jobs.select(F.lit("export_jobs"), "link_id", "id"))


_KIND = """CASE event_type WHEN 'click' THEN 'parsing' WHEN 'view' THEN 'parsed' WHEN 'purchase' THEN 'indexed'
  WHEN 'signup' THEN 'failed' ELSE 'ignored' END"""


@query("link_mark", f"""
WITH ev AS (SELECT user_id AS link_id, event_id AS seq, {_KIND} AS kind, ts AS at_ts, 'Title ' || event_id AS title, (event_id % 9)::INT AS minutes, '# ' || event_id AS body FROM events),
s AS (SELECT link_id, max_by(kind, seq) AS kind FROM ev WHERE kind IN ('parsing', 'parsed', 'failed') GROUP BY 1),
p AS (SELECT link_id, max(seq) AS seq FROM ev WHERE kind = 'parsed' GROUP BY 1),
x AS (SELECT link_id, max_by(at_ts, seq) AS at_ts FROM ev WHERE kind = 'indexed' GROUP BY 1)
SELECT l.id, coalesce(s.kind, l.status) AS status, CASE WHEN e.seq IS NOT NULL THEN e.title ELSE l.title END AS title,
  CASE WHEN e.seq IS NOT NULL THEN e.minutes ELSE l.reading_time_min END AS reading_time_min,
  CASE WHEN e.seq IS NOT NULL THEN e.at_ts ELSE l.parsed_at END AS parsed_at, coalesce(x.at_ts, l.indexed_at) AS indexed_at,
  CASE WHEN e.seq IS NOT NULL THEN e.body ELSE 'old ' || l.id END AS content_md
FROM v_links l LEFT JOIN s ON s.link_id = l.id LEFT JOIN p ON p.link_id = l.id LEFT JOIN ev e ON e.seq = p.seq LEFT JOIN x ON x.link_id = l.id""")
def link_mark(t):
    kind = F.col("event_type")
    kinds = (F.when(kind == "click", "parsing").when(kind == "view", "parsed").when(kind == "purchase", "indexed")
             .when(kind == "signup", "failed").otherwise("ignored"))
    events = t.base("events").select(
        F.col("user_id").alias("link_id"), F.col("event_id").alias("seq"), kinds.alias("kind"), F.col("ts").alias("at"),
        F.concat(F.lit("Title "), "event_id").alias("title"), (F.col("event_id") % 9).cast("int").alias("reading_time_min"),
        F.concat(F.lit("# "), "event_id").alias("content_md"))
    links = t.links.withColumn("content_md", F.concat(F.lit("old "), "id"))
    return changes.link_mark(links, events).select(
        "id", "status", "title", "reading_time_min", "parsed_at", "indexed_at", "content_md")


@query("index_reset", """
SELECT id, status, CASE WHEN status <> 'parsed' THEN indexed_at END AS indexed_at FROM v_links""")
def index_reset(t):
    return changes.index_reset(t.links).select("id", "status", "indexed_at")


# ---- collections -------------------------------------------------------------------------------


_VERDICTS = rf"""
WITH req AS (SELECT event_id AS seq, NULL::BIGINT AS collection_id, user_id, CASE event_type WHEN 'click' THEN '  Read & Later ' WHEN 'view' THEN 'Work/1-URGENT'
    WHEN 'signup' THEN ' ' WHEN 'error' THEN '?!'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'Mühe ' ELSE 'MUHE ' END || (event_id % 40) // 2 END AS name FROM events
  UNION ALL SELECT 1000000000 + o_orderkey, o_custkey * 10 + 5, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END,
    'Box ' || o_orderpriority FROM orders),
j AS (SELECT seq, collection_id, user_id, trim(name) AS name,
  {q_tidy(rf"regexp_replace(regexp_replace(lower(trim(name)), '[^\p{{L}}\p{{Nd}}{JS}-]', ' ', 'g'), '[{JS}]+', '-', 'g')")} AS slug FROM req),
e AS (SELECT j.*, CASE WHEN j.name = '' THEN 'Collection name cannot be empty' WHEN j.slug = '' THEN 'Collection name must contain letters or numbers'
   WHEN j.collection_id IS NOT NULL AND o.id IS NULL THEN 'Collection not found'
   WHEN h.id IS NOT NULL AND h.id IS DISTINCT FROM j.collection_id THEN 'Collection with this name already exists' END AS error
  FROM j LEFT JOIN v_collections h ON h.user_id = j.user_id AND h.slug = j.slug
  LEFT JOIN v_collections o ON o.id = j.collection_id AND o.user_id = j.user_id),
f AS (SELECT user_id, strip_accents(slug) AS slug, min(seq) AS first FROM e WHERE error IS NULL GROUP BY 1, 2),
v AS (SELECT e.seq, e.collection_id, e.user_id, e.name, e.slug,
  coalesce(e.error, CASE WHEN e.seq > f.first THEN 'Collection with this name already exists' END, 'ok') AS verdict
FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.slug = strip_accents(e.slug))"""


@query("collection_write", f"{_VERDICTS} SELECT * FROM v")
def collection_write(t):
    return changes.collection_write(t.collections, name_requests(t))


@query("collection_apply", f"""{_VERDICTS},
r AS (SELECT collection_id AS id, max_by(name, seq) AS name, max_by(slug, seq) AS slug FROM v
  WHERE verdict = 'ok' AND collection_id IS NOT NULL GROUP BY 1)
SELECT c.id, coalesce(r.name, c.name) AS name, coalesce(r.slug, c.slug) AS slug, c.user_id FROM v_collections c LEFT JOIN r ON r.id = c.id
UNION ALL SELECT (SELECT max(id) FROM v_collections) + row_number() OVER (ORDER BY md5(seq::VARCHAR)), name, slug, user_id
FROM v WHERE verdict = 'ok' AND collection_id IS NULL""")
def collection_apply(t):
    return changes.collection_apply(t.collections, changes.collection_write(t.collections, name_requests(t)))


def name_requests(t):
    kind = F.col("event_type")
    name = (F.when(kind == "click", "  Read & Later ").when(kind == "view", "Work/1-URGENT").when(kind == "signup", " ")
            .when(kind == "error", "?!").otherwise(F.concat(
                F.when(F.col("event_id") % 2 == 0, "Mühe ").otherwise("MUHE "), F.floor(F.col("event_id") % 40 / 2))))
    inserts = t.base("events").select(
        F.col("event_id").alias("seq"), F.lit(None).cast("bigint").alias("collection_id"), "user_id", name.alias("name"))
    user = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    renames = t.base("orders").select(
        (F.col("o_orderkey") + 1000000000).alias("seq"), (F.col("o_custkey") * 10 + 5).alias("collection_id"),
        user.alias("user_id"), F.concat(F.lit("Box "), "o_orderpriority").alias("name"))
    return inserts.unionByName(renames)


_DROPS = """req AS (SELECT DISTINCT o_custkey * 10 + 1 AS collection_id, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS user_id
  FROM orders WHERE o_orderpriority = '1-URGENT'),
gone AS (SELECT c.id FROM v_collections c JOIN req r ON r.collection_id = c.id AND r.user_id = c.user_id)"""


@query("collection_delete", f"""
WITH {_DROPS} SELECT 'collections' AS part, id, NULL::BIGINT AS collection_id FROM v_collections WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'links', l.id, CASE WHEN l.collection_id IN (SELECT id FROM gone)
  OR EXISTS (SELECT 1 FROM req r WHERE r.collection_id = l.collection_id AND r.user_id = l.user_id) THEN NULL ELSE l.collection_id END FROM v_links l""")
def collection_delete(t):
    user = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    req = t.base("orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        (F.col("o_custkey") * 10 + 1).alias("collection_id"), user.alias("user_id"))
    kept, links = changes.collection_delete(t.collections, t.links, req)
    return kept.select(F.lit("collections").alias("part"), "id", F.lit(None).cast("bigint").alias("collection_id")).unionAll(
        links.select(F.lit("links"), "id", "collection_id"))


# ---- export jobs -------------------------------------------------------------------------------

_NEXT = "(SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY md5(link_id::VARCHAR))"


@query("export_upsert", f"""
WITH {_JOBS}, asked AS (SELECT id AS link_id, saved_at AS at_ts FROM v_links WHERE status = 'parsed' AND title IS NOT NULL),
up AS (SELECT 'pending' AS form, j.id, j.link_id, CASE WHEN a.link_id IS NULL THEN j.status ELSE 'pending' END AS status, j.vault_path,
    CASE WHEN a.link_id IS NULL THEN j.error_msg END AS error_msg, j.created_at, CASE WHEN a.link_id IS NULL THEN j.completed_at END AS completed_at
  FROM jobs j LEFT JOIN asked a ON a.link_id = j.link_id
  UNION ALL SELECT 'exporting', j.id, j.link_id, CASE WHEN a.link_id IS NULL THEN j.status ELSE 'exporting' END, j.vault_path, j.error_msg, j.created_at,
    CASE WHEN a.link_id IS NULL THEN j.completed_at END FROM jobs j LEFT JOIN asked a ON a.link_id = j.link_id),
new AS (SELECT {_NEXT} AS id, link_id, at_ts FROM asked WHERE link_id NOT IN (SELECT link_id FROM jobs))
SELECT * FROM up UNION ALL SELECT 'pending', id, link_id, 'pending', NULL, NULL, at_ts, NULL FROM new
UNION ALL SELECT 'exporting', id, link_id, 'exporting', NULL, NULL, at_ts, NULL FROM new""")
def export_upsert(t):
    asked = t.links.where((F.col("status") == "parsed") & F.col("title").isNotNull()).select(
        F.col("id").alias("link_id"), F.col("saved_at").alias("at"))
    forms = [changes.export_upsert(jobs_table(t), asked, s).withColumn("form", F.lit(s)) for s in ("pending", "exporting")]
    return forms[0].unionByName(forms[1])


@query("export_update", f"""
WITH {_JOBS}, u AS (SELECT id, CASE status WHEN 'pending' THEN 'exporting' WHEN 'exporting' THEN 'done' ELSE 'failed' END AS status,
  created_at + INTERVAL '1' HOUR AS at_ts FROM v_export_jobs WHERE status <> 'done')
SELECT j.id, j.link_id, coalesce(u.status, j.status) AS status, CASE WHEN u.id IS NULL THEN j.vault_path WHEN u.status = 'done' THEN 'x/' || j.id || '.md' END AS vault_path,
  CASE WHEN u.id IS NULL THEN j.error_msg WHEN u.status = 'failed' THEN 'again' END AS error_msg,
  CASE WHEN u.id IS NULL THEN j.completed_at WHEN u.status IN ('done', 'failed') THEN u.at_ts END AS completed_at
FROM jobs j LEFT JOIN u ON u.id = j.id""")
def export_update(t):
    s = F.col("status")
    new = F.when(s == "pending", "exporting").when(s == "exporting", "done").otherwise("failed")
    updates = t.export_jobs.where(s != "done").select(
        "id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), new.alias("status"), (F.col("created_at") + F.expr("INTERVAL '1' HOUR")).alias("at")).select(
        "id", "seq", "status", F.when(s == "done", F.concat(F.lit("x/"), "id", F.lit(".md"))).alias("vault_path"),
        F.when(s == "failed", F.when(F.col("seq") == 2, "again").otherwise("early")).alias("error_msg"), "at")
    return changes.export_update(jobs_table(t), updates).select(
        "id", "link_id", "status", "vault_path", "error_msg", "completed_at")
