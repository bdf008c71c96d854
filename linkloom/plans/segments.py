"""The stored index that follows changes: it must answer as one built from the final documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators.segments import SearchIndex
from linkloom.plans.registry import query
from linkloom.plans.search import _RANKED, docs, q_tokens, texts
from linkloom.streaming.flows import work_folder

_LEFT = "NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def changed_index(t, name):
    """Every third document under an old text first, then all of them in two batches, then toxic ones deleted."""
    d = docs(t)
    index = SearchIndex(t.spark, work_folder(t.spark, name), buckets=4, fanout=3, tier_docs=100)
    index.apply(d.where("id % 3 = 0").withColumns({"content": F.lit("the le que of before"), "title": F.lit("of the thand")}))
    index.apply(d.where("id % 3 < 2"))
    index.apply(d.where("id % 3 = 2"), t.base("labels").where("toxic = 1 AND doc_id % 3 < 2").select(F.col("doc_id").alias("id")))
    index.apply(d.where(F.lit(False)), t.base("labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    return index


@query("segments_search", _RANKED.replace("GROUP BY ALL)", f"WHERE l.id {_LEFT} GROUP BY ALL)", 1).replace("pos <= 20", "pos <= 5")
       + "SELECT query_id, user_id, id, score, pos FROM top")
def segments_search(t):
    return changed_index(t, "segments").search(texts(t), 5)


@query("segments_suggest", f"""
SELECT user_id, id, title, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY len({q_tokens('title')}), id) AS pos
FROM v_doc_links WHERE id {_LEFT} AND contains(' ' || array_to_string({q_tokens('title')}, ' '), ' of th')) WHERE pos <= 5""")
def segments_suggest(t):
    return changed_index(t, "suggest").suggest("Of TH").select("user_id", "id", "title", "pos")


@query("segments_documents", f"SELECT id, user_id, title, content FROM v_doc_links WHERE id {_LEFT}")
def segments_documents(t):
    return changed_index(t, "stored").documents().select("id", "user_id", "title", "content")
