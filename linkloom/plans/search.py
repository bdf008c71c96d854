"""Search queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import search
from linkloom.plans.registry import query
from linkloom.plans.relational import TAGS_SQL, joined
from linkloom.streaming.flows import work_folder

TEXTS = [(1, "The thand of"), (2, "le que la LE"), (3, "src3"), (4, "en")]


def q_tokens(x):
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{Nd}}]+'), lambda s: s <> '')"


def docs(t):
    """Search documents: tags are part of the document, as in an index."""
    title = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    return t.base("documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("user_id"), title.alias("title"),
        F.col("text").alias("content"), F.array("lang", "source").alias("tags"), F.col("source").alias("collection"),
        F.col("doc_id").alias("saved_at"))


def texts(t):
    rows = ", ".join(f"({n}, '{text}')" for n, text in TEXTS)
    return t.spark.sql(f"SELECT * FROM VALUES {rows} AS v(query_id, text)")


_DOCS = """d AS (SELECT l.id, l.user_id, l.title, l.content, l.collection, l.saved_seq, list(g.tag ORDER BY g.tag) AS tags
  FROM v_doc_links l JOIN v_doc_tags g ON g.link_id = l.id GROUP BY ALL)"""

_FIELDS = f"""{_DOCS},
ft AS (SELECT id, user_id, 'title' AS field, {q_tokens('title')} AS terms FROM d
  UNION ALL SELECT id, user_id, 'content', {q_tokens('content')} FROM d UNION ALL SELECT id, user_id, 'tags', tags FROM d),
spots AS (SELECT field, id, user_id, len(terms) AS dl, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM ft)"""


@query("search_postings", f"""
WITH {_FIELDS} SELECT field, term, id, user_id, dl, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM spots
WHERE field <> 'tags' GROUP BY ALL""")
def search_postings(t):
    rows = search.postings(docs(t)).where(F.col("field") != "tags")
    spots = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return rows.withColumn("positions", spots)


_RANKED = f"""
WITH {_FIELDS}, q AS (SELECT * FROM (VALUES (1, 'The thand of'), (2, 'le que la LE'), (3, 'src3'), (4, 'en')) v(query_id, text)),
w AS (SELECT query_id, unnest({q_tokens('text')}) AS term FROM q),
qt AS (SELECT query_id, f.field, term, count(*) AS qtf FROM w, (VALUES ('title'), ('content')) f(field) GROUP BY ALL
  UNION ALL SELECT query_id, 'tags', text, 1 FROM q),
stats AS (SELECT field, count(*) AS n, avg(len(terms)) AS avgdl FROM ft WHERE len(terms) > 0 GROUP BY field),
found AS (SELECT field, term, id, user_id, dl, count(*) AS tf FROM spots WHERE (field, term) IN (SELECT (field, term) FROM qt) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM found GROUP BY ALL),
parts AS (SELECT qt.query_id, f.id, f.user_id, f.field, qt.qtf * ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * f.tf * 2.2 /
    (f.tf + CASE WHEN f.field = 'tags' THEN 1.2 ELSE 1.2 * (0.25 + 0.75 * f.dl / s.avgdl) END) AS part
  FROM found f JOIN qt ON qt.field = f.field AND qt.term = f.term JOIN df ON df.field = f.field AND df.term = f.term JOIN stats s ON s.field = f.field),
per AS (SELECT query_id, id, user_id, field, sum(part) * CASE field WHEN 'title' THEN 2.0 ELSE 1.0 END AS x FROM parts GROUP BY query_id, id, user_id, field),
scored AS (SELECT query_id, id, user_id, round(max(x), 6) AS score FROM per GROUP BY ALL),
top AS (SELECT query_id, user_id, id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, user_id ORDER BY score DESC, id) AS pos FROM scored) WHERE pos <= 20)
"""


@query("search_fulltext", _RANKED + "SELECT query_id, user_id, id, score, pos FROM top")
def search_fulltext(t):
    return search.search_fulltext(docs(t), texts(t))


@query("search_stored", _RANKED + "SELECT query_id, user_id, id, score, pos FROM top")
def search_stored(t):
    """Builds the index in a shared folder and answers from it."""
    folder = work_folder(t.spark, "search-index")
    search.write_index(docs(t), folder)
    return search.search_index(
        t.spark.read.parquet(f"{folder}/postings"), t.spark.read.parquet(f"{folder}/field_stats"), texts(t))


def q_mark(x, terms):
    pieces = rf"regexp_extract_all({x}, '[\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}]+')"
    return (f"CASE WHEN len(list_filter({pieces}, lambda p: list_contains({terms}, lower(p)))) > 0 THEN array_to_string(list_transform({pieces}, "
            f"lambda p: CASE WHEN list_contains({terms}, lower(p)) THEN '<mark>' || p || '</mark>' ELSE p END), '') END")


@query("search_highlight", _RANKED + rf""", words AS (SELECT query_id, {q_tokens('text')} AS words FROM q),
j AS (SELECT top.*, d.title, d.content, words.words, regexp_extract_all(d.content, '[\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}]+') AS pieces
  FROM top JOIN d ON d.id = top.id JOIN words ON words.query_id = top.query_id),
k AS (SELECT *, coalesce(list_position(list_transform(pieces, lambda p: list_contains(words, lower(p))), true), 0) AS first FROM j),
m AS (SELECT *, CASE WHEN first > 0 THEN substring(content, 1 + length(array_to_string(pieces[1:first - 1], '')), 200) END AS fragment FROM k)
SELECT query_id, user_id, id, score, pos, {q_mark('title', 'words')} AS title_mark, {q_mark('fragment', 'words')} AS content_mark FROM m""")
def search_highlight(t):
    d = docs(t)
    return search.with_highlights(search.search_fulltext(d, texts(t)), d, texts(t))


@query("search_tag", f"""
WITH {_DOCS} SELECT user_id, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_seq DESC, id DESC) AS pos
FROM d WHERE list_contains(tags, 'en')) WHERE pos <= 50""")
def search_tag(t):
    return search.search_tag(docs(t), "en").select("user_id", "id", "pos")


_PAGE = """SELECT user_id, id, title, pos, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_seq DESC, id DESC) AS pos,
  count(*) OVER (PARTITION BY user_id) AS total FROM d WHERE {where}) WHERE pos > {offset} AND pos <= {offset} + {limit}"""


@query("search_advanced", f"""WITH {_DOCS} """ + _PAGE.format(
    where=f"list_contains(tags, 'en') AND collection = 'src3' AND (list_has_any({q_tokens('title')}, ['the', 'and']) "
          f"OR list_has_any({q_tokens('content')}, ['the', 'and']) OR list_contains(tags, 'the and'))", offset=0, limit=20))
def search_advanced(t):
    return search.search_advanced(docs(t), "The and", ("en",), "src3").select("user_id", "id", "title", "pos", "total")


@query("search_scope", f"""WITH {_DOCS} """ + _PAGE.format(where="true", offset=5, limit=10))
def search_scope(t):
    # no clause but the user: everything matches
    return search.search_advanced(docs(t), limit=10, offset=5).select("user_id", "id", "title", "pos", "total")


@query("search_suggest", f"""
SELECT user_id, id, title, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY len({q_tokens('title')}), id) AS pos
FROM v_doc_links WHERE contains(' ' || array_to_string({q_tokens('title')}, ' '), ' of th')) WHERE pos <= 5""")
def search_suggest(t):
    return search.search_suggest(t.doc_links, "Of TH").select("user_id", "id", "title", "pos")


_RESYNC = f"""SELECT l.id, l.url, coalesce(l.title, '') AS title, coalesce(d.text, '') AS content, coalesce(l.reading_time_min, 0) AS reading_time, l.saved_at, l.user_id,
  coalesce(c.slug, 'unsorted') AS collection, coalesce(g.tags, '') AS tags FROM v_links l LEFT JOIN v_collections c ON c.id = l.collection_id
  LEFT JOIN documents d ON d.doc_id = l.id LEFT JOIN ({TAGS_SQL}) g ON g.link_id = l.id WHERE l.status = 'parsed' AND l.indexed_at IS NULL"""


@query("resync_docs", _RESYNC)
def resync_docs(t):
    return search.resync_docs(t.full_links, t.collections, t.link_tags, t.tags).withColumn("tags", joined())


@query("sink_search_docs", f"""
WITH n AS ({_RESYNC}) SELECT id, title, collection, user_id FROM n WHERE id NOT IN (SELECT user_id FROM events)
UNION ALL SELECT user_id, 'Event ' || max(event_id), max_by(event_type, event_id), max_by(user_id, event_id) FROM events GROUP BY user_id""")
def sink_search_docs(t):
    old = search.resync_docs(t.full_links, t.collections, t.link_tags, t.tags).select("id", "title", "collection", "user_id")
    batch = t.base("events").select(
        F.col("user_id").alias("id"), F.concat(F.lit("Event "), "event_id").alias("title"),
        F.col("event_type").alias("collection"), "user_id", F.col("event_id").alias("seq"))
    return search.merge_docs(old, batch)


@query("sink_search_delete", """SELECT id, title FROM v_doc_links WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def sink_search_delete(t):
    gone = t.base("labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return search.delete_docs(t.doc_links, gone).select("id", "title")
