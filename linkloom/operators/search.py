"""Full-text search over link documents: postings, BM25 ranking, tag, filtered and prefix search.

Contract: tokens are lower-cased runs of letters and digits; the terms of a query are OR-ed; a field
scores BM25 (k1 = 1.2, b = 0.75); a document scores its best field, the title counting twice; tags
match only as a whole string and have no length norm. Ties go to the smaller id. Statistics are those
of all documents, also where the answer is limited to a user.

A document table has: id, user_id, title, content, tags array<string>, collection and a save order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.relational import page_per_key

# fixed values: ranking parameters
K1, B = 1.2, 0.75
BOOSTS = {"title": 2.0, "content": 1.0, "tags": 1.0}
WORD = r"\p{L}\p{Nd}"
SLICE_TOKENS = 200_000  # tokens grouped together


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD}]+"), "")


def _field_tokens(docs: DataFrame) -> DataFrame:
    """One row per document and field with the field's terms and their number.

    The length is taken next to the list, so that exploding the list later drops the list itself.
    """
    lists = docs.select(
        "id", "user_id", tokens(F.col("title")).alias("title"), tokens(F.col("content")).alias("content"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms"), F.size(f).alias("dl")) for f in BOOSTS])
    return lists.select("id", "user_id", F.explode(cells).alias("f")).select("id", "user_id", "f.field", "f.terms", "f.dl")


# ---- the index as tables -----------------------------------------------------------------------


def postings(docs: DataFrame) -> DataFrame:
    """(field, term, id, user_id, dl, tf, positions): one row per term of a document's field.

    All tokens of a field are in one row, so they are grouped there and nothing is shuffled.
    """
    rows = _field_tokens(docs).select("field", "id", "user_id", "dl", "terms")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_grouped, f"field string, term string, id {kinds['id']}, user_id {kinds['user_id']}, dl int, tf long, "
                                     "positions array<int>")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each row with their positions, in slices of some hundred thousand tokens."""
    for batch in batches:
        lengths = batch.column("dl").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + SLICE_TOKENS, "right")))
            part = batch.slice(at, end - at)
            size = lengths[at:end]
            words = part.column("terms").flatten().dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((code, row))  # stable: positions stay in order
            new = np.ones(len(order), bool)
            new[1:] = (row[order][1:] != row[order][:-1]) | (code[order][1:] != code[order][:-1])
            first = np.flatnonzero(new)
            bounds = np.append(first, len(order)).astype(np.int32)
            spot = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            of = pa.array(row[order][first])
            yield pa.RecordBatch.from_arrays(
                [part.column("field").take(of), words.dictionary.take(pa.array(code[order][first])),
                 part.column("id").take(of), part.column("user_id").take(of), part.column("dl").take(of),
                 pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(spot[order]))],
                ["field", "term", "id", "user_id", "dl", "tf", "positions"])
            at = end


def field_stats(docs: DataFrame) -> DataFrame:
    """(field, n, avgdl) over documents that have the field."""
    return _field_tokens(docs).select("field", "dl").where("dl > 0").groupBy("field").agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def write_index(docs: DataFrame, folder: str, buckets: int = 64) -> None:
    """Store postings, split by a hash of the term so that a query reads only its terms' buckets."""
    rows = postings(docs).withColumn("bucket", _bucket(buckets))
    # bucket and id together spread a frequent term over many tasks and files
    rows.repartition("bucket", F.pmod(F.hash("id"), F.lit(16))).sortWithinPartitions("term").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    field_stats(docs).write.mode("overwrite").parquet(f"{folder}/field_stats")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("term"), F.lit(buckets))


def merge_docs(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by id; of several writes of one id the last ``seq`` wins."""
    columns = existing.columns
    last = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in columns if c != "id"]), "seq").alias("row"))
    new = last.select("id", "row.*").select(columns)
    return existing.join(new.select("id"), "id", "left_anti").select(columns).unionByName(new)


def delete_docs(existing: DataFrame, gone: DataFrame) -> DataFrame:
    return existing.join(gone.select("id"), "id", "left_anti")


# ---- ranked search -----------------------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, field, term, qtf) of queries (query_id, text)."""
    words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("qtf"))
    whole = queries.select("query_id", F.lit("tags").alias("field"), F.col("text").alias("term"), F.lit(1).cast("bigint").alias("qtf"))
    fields = F.explode(F.array(F.lit("title"), F.lit("content")))
    return words.select("query_id", fields.alias("field"), "term", "qtf").unionByName(whole)


def matching_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Term counts of the asked terms only, straight from the documents (no stored index needed).

    Spark sends a small query table to the scanning tasks by its measured size, and other tokens are dropped there.
    """
    wanted = terms.select("field", "term").distinct()
    spots = _field_tokens(docs).select(
        "field", "id", "user_id", "dl", F.explode("terms").alias("term"))
    return spots.join(wanted, ["field", "term"]).groupBy("field", "term", "id", "user_id", "dl").agg(
        F.count("*").alias("tf"))


def score(found: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, user_id, score) from postings of the query terms."""
    # counting tf keeps the aggregated postings identical in both branches, so Spark reuses their shuffle
    df = found.groupBy("field", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weights = terms.join(df, ["field", "term"]).join(stats, "field").select(
        "query_id", "field", "term", "avgdl",
        (F.col("qtf") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    norm = F.when(F.col("field") == "tags", F.lit(K1)).otherwise(K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    hits = found.join(weights, ["field", "term"]).withColumn("part", part)
    fields = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("part"))), F.lit(0.0)) * boost for f, boost in BOOSTS.items()]
    return hits.groupBy("query_id", "id", "user_id").agg(F.round(F.greatest(*fields), 6).alias("score"))


def search_fulltext(docs: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Best documents of each query for every user: (query_id, user_id, id, score, pos).

    Queries (query_id, text) may carry user_id to limit the answer to that user.
    """
    terms = query_terms(queries)
    scored = score(matching_postings(docs, terms), field_stats(docs), terms)
    return _top(scored, queries, limit)


def search_index(found: DataFrame, stats: DataFrame, queries: DataFrame, buckets: int = 64, limit: int = 20) -> DataFrame:
    """The same over a stored index (postings in as many ``buckets`` as they were written in, field_stats).

    Only the partitions of the asked terms' buckets are read; their numbers are the one thing the driver sees.
    """
    terms = query_terms(queries)
    wanted = terms.select("field", "term", _bucket(buckets).alias("bucket")).distinct()
    asked = [row[0] for row in wanted.select("bucket").distinct().collect()]
    mine = found.where(F.col("bucket").isin(asked)).join(wanted, ["bucket", "field", "term"], "left_semi").select(
        "field", "term", "id", "user_id", "dl", "tf")
    return _top(score(mine, stats, terms), queries, limit)


def _top(scored: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    if "user_id" in queries.columns:
        scored = scored.join(queries.select("query_id", "user_id"), ["query_id", "user_id"], "left_semi")
    return top_per_user(scored, limit)


def top_per_user(scored: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id", "user_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select(
        "query_id", "user_id", "id", "score", "pos")


# ---- highlights --------------------------------------------------------------------------------


def _pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{WORD}]+|[^{WORD}]+"), F.lit(0))


def highlight(c: Column, terms: Column) -> Column:
    """Text with every query word marked; null where there is none."""
    pieces = _pieces(c)
    marked = F.transform(pieces, lambda p: F.when(
        F.array_contains(terms, F.lower(p)), F.concat(F.lit("<mark>"), p, F.lit("</mark>"))).otherwise(p))
    return F.when(F.exists(pieces, lambda p: F.array_contains(terms, F.lower(p))), F.array_join(marked, ""))


def first_fragment(c: Column, terms: Column, size: int = 200) -> Column:
    """``size`` characters from the first query word on."""
    pieces = _pieces(c)
    first = F.array_position(F.transform(pieces, lambda p: F.array_contains(terms, F.lower(p))), True)
    before = F.length(F.array_join(F.slice(pieces, 1, F.greatest(first - 1, F.lit(0)).cast("int")), ""))
    return F.when(first > 0, F.substring(c, before + 1, F.lit(size)))


def with_highlights(top: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Marked title and first content fragment, computed for the top rows only."""
    words = queries.select("query_id", tokens(F.col("text")).alias("words"))
    rows = top.join(docs.select("id", "title", "content"), "id").join(words, "query_id")
    fragment = first_fragment(F.col("content"), F.col("words"))
    return rows.select(*top.columns, highlight(F.col("title"), F.col("words")).alias("title_mark"),
                       highlight(fragment, F.col("words")).alias("content_mark"))


# ---- tag, filtered and prefix search -----------------------------------------------------------


def search_tag(docs: DataFrame, tag: str, limit: int = 50, saved: str = "saved_at") -> DataFrame:
    """Each user's newest documents with the exact tag."""
    return page_per_key(docs.where(F.array_contains("tags", tag)), "user_id", [F.desc(saved), F.desc("id")], limit)


def text_matches(text: str) -> Column:
    """Does any field of a document match any word of the text (tags: the whole text)?"""
    words = F.lit(text).alias("q")
    asked = tokens(words)
    return (F.arrays_overlap(tokens(F.col("title")), asked) | F.arrays_overlap(tokens(F.col("content")), asked)
            | F.array_contains("tags", text))


def search_advanced(docs: DataFrame, text: str | None = None, tags: tuple[str, ...] = (), collection: str | None = None,
                    limit: int = 20, offset: int = 0, saved: str = "saved_at") -> DataFrame:
    """All given clauses must hold; newest first, one page per user, with the user's total."""
    clauses = [F.array_contains("tags", tag) for tag in tags]
    if collection is not None:
        clauses.append(F.col("collection") == collection)
    if text is not None:
        clauses.append(text_matches(text))
    hits = docs.where(reduce(lambda a, b: a & b, clauses)) if clauses else docs
    hits = hits.select("id", "user_id", "title", "collection", saved)
    total = hits.groupBy("user_id").agg(F.count("*").alias("total"))
    page = page_per_key(hits, "user_id", [F.desc(saved), F.desc("id")], limit, offset)
    return page.join(total, "user_id")


def search_suggest(docs: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """Titles that hold the words in order, the last one as a prefix; shortest titles first, then id."""
    words = [w for w in _split_words(prefix) if w]
    if not words:
        return page_per_key(docs.where(F.lit(False)), "user_id", [F.col("id")], limit)
    terms = tokens(F.col("title"))
    hits = docs.where(F.concat(F.lit(" "), F.array_join(terms, " ")).contains(" " + " ".join(words)))
    rows = hits.select("id", "user_id", "title", F.size(terms).alias("n_words"))
    return page_per_key(rows, "user_id", [F.col("n_words"), F.col("id")], limit)


def _split_words(text: str) -> list[str]:
    return "".join(ch if ch.isalpha() or ch.isdecimal() else " " for ch in text.lower()).split()


# ---- feeding the index -------------------------------------------------------------------------


def resync_docs(links: DataFrame, collections: DataFrame, link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents of all parsed links that are not indexed yet."""
    from linkloom.operators.relational import with_collection, with_tags

    todo = links.where((F.col("status") == "parsed") & F.col("indexed_at").isNull())
    # only the tags of these links are named and gathered
    own = link_tags.join(todo.select(F.col("id").alias("link_id")).distinct(), "link_id", "left_semi")
    full = with_tags(with_collection(todo, collections), own, tags)
    content = F.coalesce("content_md", F.lit("")) if "content_md" in links.columns else F.lit("")
    return full.select(
        "id", "url", F.coalesce("title", F.lit("")).alias("title"), content.alias("content"),
        F.coalesce("reading_time_min", F.lit(0)).alias("reading_time"), "saved_at", "user_id", "collection", "tags")


def mark_indexed(links: DataFrame, written: DataFrame, at: Column) -> DataFrame:
    """Set the index time of links whose document was really written."""
    done = written.select("id").distinct().withColumn("written", F.lit(True))
    kind = links.schema["indexed_at"].dataType
    return links.join(done, "id", "left").withColumn(
        "indexed_at", F.when(F.col("written"), at.cast(kind)).otherwise(F.col("indexed_at"))).select(links.columns)
