"""Related-link rankings with their check SQL (full self joins on the DuckDB side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import related
from linkloom.plans.registry import query
from linkloom.plans.scalars import q_wikilink

_PAIRS = """
pairs AS (SELECT a.link_id, b.link_id AS rel_id, count(*) AS n FROM v_link_tags a JOIN v_link_tags b
  ON a.tag_id = b.tag_id AND a.link_id <> b.link_id
  JOIN v_links l ON l.id = b.link_id AND l.status = 'parsed' AND l.title IS NOT NULL GROUP BY 1, 2)"""

_TOP5 = f"""
WITH {_PAIRS}, top AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY n DESC, rel_id) AS pos FROM pairs),
top5 AS (SELECT top.link_id, top.rel_id, top.n AS shared_tags, top.pos, {q_wikilink('l.title')} AS slug
  FROM top JOIN v_links l ON l.id = top.rel_id WHERE pos <= 5)"""


@query("related_top5", _TOP5 + "SELECT link_id, rel_id, pos, slug FROM top5")
def related_top5(t):
    return related.related_top(t.links, t.link_tags).select("link_id", "rel_id", "pos", "slug")


@query("related_shared_count", _TOP5 + "SELECT link_id, rel_id, shared_tags FROM top5")
def related_shared_count(t):
    return related.related_top(t.links, t.link_tags).select("link_id", "rel_id", "shared_tags")


@query("having_min_shared", f"""
WITH {_PAIRS} SELECT link_id, rel_id, n AS shared_tags, pos FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY n DESC, rel_id) AS pos
FROM pairs WHERE n >= 2) WHERE pos <= 10""")
def having_min_shared(t):
    return related.strong_related(t.links, t.link_tags)


@query("related_weighted_top8", f"""
WITH tagged AS (SELECT a.link_id, b.link_id AS rel_id, count(*) AS n FROM v_link_tags a JOIN v_link_tags b
  ON a.tag_id = b.tag_id AND a.link_id <> b.link_id GROUP BY 1, 2),
same AS (SELECT a.id AS link_id, b.id AS rel_id FROM v_links a JOIN v_links b ON a.collection_id = b.collection_id AND a.id <> b.id),
cand AS (SELECT link_id, rel_id FROM tagged UNION SELECT link_id, rel_id FROM same),
scored AS (SELECT c.link_id, c.rel_id, coalesce(g.n, 0) AS shared_tags, (s.rel_id IS NOT NULL) AS same_collection,
    coalesce(g.n, 0) * 3 + (CASE WHEN s.rel_id IS NOT NULL THEN 1 ELSE 0 END) AS score, l.title, l.collection_id
  FROM cand c LEFT JOIN tagged g ON g.link_id = c.link_id AND g.rel_id = c.rel_id
  LEFT JOIN same s ON s.link_id = c.link_id AND s.rel_id = c.rel_id
  JOIN v_links l ON l.id = c.rel_id AND l.status = 'parsed' AND l.title IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY score DESC, rel_id) AS pos FROM scored)
SELECT t.link_id, t.rel_id, t.pos, t.score, t.shared_tags, t.same_collection, {q_wikilink('t.title')} AS slug, coalesce(c.slug, 'unsorted') AS collection
FROM top t LEFT JOIN v_collections c ON c.id = t.collection_id WHERE pos <= 8""")
def related_weighted_top8(t):
    return related.related_weighted(t.links, t.link_tags, t.collections).drop("title")


@query("backlinks_for_link", f"""
WITH {_PAIRS}, titled AS (SELECT p.link_id, l.title, max(p.n) AS shared_tags FROM pairs p JOIN v_links l ON l.id = p.rel_id
  JOIN v_links me ON me.id = p.link_id AND me.title IS NOT NULL WHERE p.n >= 2 GROUP BY 1, 2)
SELECT link_id, title, {q_wikilink('title')} AS slug, shared_tags, pos FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY shared_tags DESC, title) AS pos
FROM titled) WHERE pos <= 10""")
def backlinks_for_link(t):
    return related.backlinks(t.links, t.link_tags)


_EDGES = _TOP5 + f""", edges AS (SELECT DISTINCT top5.slug AS target, {q_wikilink('l.title')} AS source FROM top5
  JOIN v_links l ON l.id = top5.link_id AND l.status = 'parsed' AND l.title IS NOT NULL)"""


@query("backlinks_map", _EDGES + "SELECT target, source FROM edges")
def backlinks_map(t):
    return related.backlink_edges(t.links, t.link_tags)


@query("graph_lines", _EDGES + "SELECT target, source, '- [[' || source || ']] → [[' || target || ']]' AS line FROM edges")
def graph_lines(t):
    return related.graph_lines(related.backlink_edges(t.links, t.link_tags))


@query("mermaid_edges", _EDGES + "SELECT target, source, '    ' || source || ' --> ' || target AS line FROM edges")
def mermaid_edges(t):
    return related.mermaid_lines(related.backlink_edges(t.links, t.link_tags))


def doc_link_tags(t):
    """Document tags (language, source) as a numeric edge list: few tags, each on many links."""
    return t.doc_tags.select("link_id", F.xxhash64("tag").alias("tag_id"))


def doc_links(t):
    return t.doc_links.select("id", "title", F.lit("parsed").alias("status"), "collection", "user_id")


@query("related_hot_tags", """
WITH pairs AS (SELECT a.id AS link_id, b.id AS rel_id, (CASE WHEN a.lang = b.lang THEN 1 ELSE 0 END) + (CASE WHEN a.source = b.source THEN 1 ELSE 0 END) AS n
  FROM (SELECT doc_id AS id, lang, source FROM documents) a JOIN (SELECT doc_id AS id, lang, source FROM documents) b
  ON a.id <> b.id AND (a.lang = b.lang OR a.source = b.source))
SELECT link_id, rel_id, n AS shared_tags, pos FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY n DESC, rel_id) AS pos FROM pairs) WHERE pos <= 5""")
def related_hot_tags(t):
    # few tags on many links: the split for large groups carries the whole load here
    top = related.related_top(doc_links(t), doc_link_tags(t), hot_degree=100)
    return top.select("link_id", "rel_id", "shared_tags", "pos")
