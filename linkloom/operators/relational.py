"""Lookups, filters, joins and aggregates over links, tags, collections and export jobs.

Each function answers for every link, user or tag at once; a key column filter narrows it to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import status as st
from linkloom.functions import strings

# ---- pages of rows per key ---------------------------------------------------------------------


def page_per_key(rows: DataFrame, key: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit of each key in the given order.

    The rank filter becomes a window group limit, so each task keeps at most offset+limit rows of a
    key before the shuffle: a key with a third of all rows costs no more than any other.
    """
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where((F.col("pos") <= offset + limit) & (F.col("pos") > offset))


def tags_of(link_tags: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (link_id, tag_id) of some links (id). Rows are dealt by link once, for this and for what is grouped by link."""
    ids = links.select(F.col("id").alias("link_id"))
    return link_tags.where(F.col("tag_id").isNotNull()).select("link_id", "tag_id").join(ids, "link_id", "left_semi").distinct()


def link_tag_names(link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(link_id, tags): sorted tag names of each tagged link."""
    named = link_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return named.groupBy("link_id").agg(F.array_sort(F.collect_list("name")).alias("tags"))


def with_tags(links: DataFrame, link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    names = link_tag_names(link_tags, tags).withColumnRenamed("link_id", "id")
    return links.join(names, "id", "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>")))


def with_collection(links: DataFrame, collections: DataFrame) -> DataFrame:
    """Add ``collection`` (the slug, 'unsorted' where there is none)."""
    c = collections.select(F.col("id").alias("collection_id"), F.col("slug").alias("collection"))
    return links.join(c, "collection_id", "left").withColumn("collection", F.coalesce("collection", F.lit("unsorted")))


def with_collection_name(links: DataFrame, collections: DataFrame) -> DataFrame:
    c = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    return links.join(c, "collection_id", "left").withColumn(
        "collection_name", F.coalesce("collection_name", F.lit("Unsorted")))


def owned(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows that are asked for (id, user_id) and belong to the asking user."""
    return rows.join(asked.select("id", "user_id"), ["id", "user_id"], "left_semi")


def links_page(links: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Each user's newest links without their content, one page."""
    columns = [c for c in links.columns if c not in ("content_md", "indexed_at")]
    return page_per_key(links.select(columns), "user_id", [F.desc("saved_at"), F.desc("id")], limit, offset)


def page_with_total(links: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page per user plus the user's total; the list caps its page at 100."""
    page = links_page(links, min(limit, 100), offset)
    total = links.groupBy("user_id").agg(F.count("*").alias("total"))
    return page.join(total, "user_id")


def links_not_indexed(links: DataFrame, limit: int | None = None) -> DataFrame:
    content = F.coalesce("content_md", F.lit("")) if "content_md" in links.columns else F.lit("")
    rows = links.where((F.col("status") == "parsed") & F.col("indexed_at").isNull()).select(
        "id", "url", content.alias("content_md"))
    return rows.limit(limit) if limit is not None else rows


def export_pending(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.where(F.col("status") == "pending").orderBy("created_at", "id").limit(limit).select("id", "link_id")


def reexport_verdict(links: DataFrame, asked: DataFrame) -> DataFrame:
    """Decide each request (link_id, user_id): accepted, not found (or not owned), not parsed yet."""
    l = links.select(F.col("id").alias("link_id"), "user_id", "status")
    joined = asked.join(l, ["link_id", "user_id"], "left")
    verdict = (
        F.when(F.col("status").isNull(), "Link not found")
        .when(F.col("status") != "parsed", F.concat(F.lit("Link not parsed yet (status: "), "status", F.lit(")")))
        .otherwise("Re-export queued")
    )
    return joined.select("link_id", "user_id", verdict.alias("verdict"))


# ---- text filters of the inbox -----------------------------------------------------------------


def _any_contains(values: list[Column], tags: Column, needle: str) -> Column:
    low = F.lit(needle.lower())
    hit = F.exists(tags, lambda t: F.lower(t).contains(low))
    for value in values:
        hit = hit | F.coalesce(F.lower(value).contains(low), F.lit(False))
    return hit


def inbox_filter(links: DataFrame, tab: str, text: str) -> DataFrame:
    """Rows of a tab (all, ready, parsing, exported) whose title, url, collection or a tag holds the text.

    ``links`` carries collection_name and tags.
    """
    family = {"all": F.lit(True), "ready": st.is_ready(F.col("status")), "parsing": st.is_active(F.col("status"))}
    rows = links.where(family.get(tab, st.is_exported(F.col("status"))))
    needle = text.strip()
    if not needle:
        return rows
    return rows.where(_any_contains([F.col("title"), F.col("url"), F.col("collection_name")], F.col("tags"), needle))


def local_search(links: DataFrame, text: str) -> DataFrame:
    """Substring search with a marked snippet, for use without an index."""
    hits = links.where(_any_contains([F.col("title"), F.col("url"), F.col("collection_name")], F.col("tags"), text))
    content = F.col("content_md") if "content_md" in links.columns else F.lit(None).cast("string")
    return hits.select(
        "id", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "url", "tags",
        F.col("collection_name").alias("collection"),
        strings.search_snippet(content, F.col("title"), F.col("url"), text).alias("snippet"))


def facet_filter(hits: DataFrame, collection: str | None = None, tag: str | None = None) -> DataFrame:
    if collection:
        hits = hits.where(F.col("collection") == collection)
    if tag:
        hits = hits.where(F.array_contains("tags", tag))
    return hits


# ---- joins -------------------------------------------------------------------------------------


def tagged_titles(tags: DataFrame, link_tags: DataFrame, links: DataFrame, collections: DataFrame,
                  tag_name: str | None = None) -> DataFrame:
    """(tag, link_id, title, collection) of parsed, titled links: the rows behind tag pages."""
    if tag_name is not None:
        tags = tags.where(F.col("name") == tag_name)
    ready = links.where((F.col("status") == "parsed") & F.col("title").isNotNull()).select(
        F.col("id").alias("link_id"), "title", "collection_id")
    # collections are found before a link is repeated for its tags; made on the way (exploded) they are more than Spark's estimates,
    # so they are merged with, never broadcast
    filed = with_collection(ready, collections.hint("merge"))
    edges = link_tags.join(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), "tag_id")
    return edges.join(filed, "link_id").select("tag", "link_id", "title", "collection")


def partner_counts(link_tags: DataFrame) -> DataFrame:
    """Per link: number of (tag, other link) partners over its tags.

    Equals the size of the shared-tag self join per link, but from tag degrees: no pair is built.
    """
    degree = link_tags.groupBy("tag_id").agg((F.count("*") - 1).alias("others"))
    return link_tags.join(degree, "tag_id").groupBy("link_id").agg(F.sum("others").alias("partners"))


def links_sharing_tags(links: DataFrame, link_tags: DataFrame) -> DataFrame:
    """Links with a tag that some other link has too (IN-subquery as a left semi join)."""
    shared = link_tags.groupBy("tag_id").agg(F.count("*").alias("n")).where("n >= 2")
    edges = link_tags.join(shared, "tag_id", "left_semi").select(F.col("link_id").alias("id"))
    return links.join(edges, "id", "left_semi")


def links_with_candidates(links: DataFrame, link_tags: DataFrame) -> DataFrame:
    """Parsed, titled links that could be related to another one: by a shared tag or by collection.

    Both conditions are existence tests on grouped keys, so no pair of links is built.
    """
    shared = link_tags.groupBy("tag_id").agg(F.count("*").alias("n")).where("n >= 2")
    by_tag = link_tags.join(shared, "tag_id", "left_semi").select(F.col("link_id").alias("id")).distinct()
    crowded = links.where(F.col("collection_id").isNotNull()).groupBy("collection_id").agg(
        F.count("*").alias("n")).where("n >= 2").select("collection_id", F.lit(True).alias("in_crowd"))
    flagged = links.where((F.col("status") == "parsed") & F.col("title").isNotNull()).join(
        by_tag.withColumn("in_tag", F.lit(True)), "id", "left").join(crowded, "collection_id", "left")
    return flagged.where(F.col("in_tag") | F.col("in_crowd")).select(
        "id", F.coalesce("in_tag", F.lit(False)).alias("by_tag"),
        F.coalesce("in_crowd", F.lit(False)).alias("by_collection"))


def shared_tag_counts_with(link_tags: DataFrame, asked: DataFrame) -> DataFrame:
    """For asked links (a table of link_id), every link that shares a tag and how many are shared.

    The answer is as long as asked x their partners; use the top-k operators for all links.
    """
    mine = link_tags.join(asked.select("link_id"), "link_id", "left_semi").select(
        F.col("link_id").alias("asked_id"), "tag_id")
    return (mine.join(link_tags, "tag_id").where(F.col("link_id") != F.col("asked_id"))
            .groupBy("asked_id", "link_id").agg(F.count("*").alias("shared_tags")))


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is gone (what a cascading delete removes)."""
    return children.where(F.col(key).isNotNull()).join(
        parents.select(F.col(parent_key).alias(key)), key, "left_anti")


# ---- aggregates --------------------------------------------------------------------------------


def collections_with_counts(collections: DataFrame, links: DataFrame) -> DataFrame:
    """Collections with their number of links of any user; empty ones keep a zero."""
    counts = links.where(F.col("collection_id").isNotNull()).groupBy(F.col("collection_id").alias("id")).agg(
        F.count("*").alias("link_count"))
    return collections.join(counts, "id", "left").withColumn("link_count", F.coalesce("link_count", F.lit(0)))


def tags_with_counts(tags: DataFrame, link_tags: DataFrame) -> DataFrame:
    counts = link_tags.groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("link_count"))
    return tags.join(counts, "id", "left").withColumn("link_count", F.coalesce("link_count", F.lit(0)))


def index_lag(links: DataFrame) -> DataFrame:
    return links.agg(F.count_if((F.col("status") == "parsed") & F.col("indexed_at").isNull()).alias("lag"))


def status_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("user_id").agg(
        F.count_if(st.is_ready(F.col("status"))).alias("ready"),
        F.count_if(st.is_active(F.col("status"))).alias("in_progress"))


def collection_tree(collections: DataFrame) -> DataFrame:
    """Rows of each user's collection tree: own count, subtree count and depth of every path.

    ``collections`` carries link_count. Names split on '/'; of two collections with one path the
    later name counts.
    """
    parts = F.filter(F.transform(F.split("name", "/"), strings.browser_trim), lambda p: p != "")
    named = collections.select("user_id", "id", "name", "link_count", parts.alias("parts")).where(F.size("parts") > 0)
    leaves = named.groupBy("user_id", F.array_join("parts", "/").alias("path")).agg(
        F.max_by("link_count", F.struct("name", "id")).alias("own"), F.first("parts").alias("parts"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(
        F.array_join(F.slice("parts", 1, n), "/").alias("path"), F.element_at("parts", n).alias("label"),
        (n - 1).alias("depth")))
    nodes = leaves.select("user_id", F.col("path").alias("leaf"), "own", F.explode(prefixes).alias("node")).select(
        "user_id", "leaf", "own", "node.*")
    return nodes.groupBy("user_id", "path", "label", "depth").agg(
        F.sum(F.when(F.col("leaf") == F.col("path"), F.col("own")).otherwise(0)).alias("own_count"),
        F.sum("own").alias("tree_count"))


def jobs_per_link(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("link_id").agg(F.count("*").alias("jobs"))


def export_entries(jobs: DataFrame) -> DataFrame:
    """Jobs with a display key 'link-position', newest first within a link."""
    pos = F.row_number().over(Window.partitionBy("link_id").orderBy(F.desc("created_at"), F.desc("id"))) - 1
    return jobs.withColumn("key", F.concat_ws("-", F.col("link_id"), pos))


def export_work_pending(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per user: is any export still running? A link without jobs counts as running."""
    active = jobs.groupBy(F.col("link_id").alias("id")).agg(
        F.bool_or(st.is_active_export(F.col("status"))).alias("active"))
    joined = links.select("id", "user_id").join(active, "id", "left")
    return joined.groupBy("user_id").agg(F.bool_or(F.coalesce("active", F.lit(True))).alias("pending"))


# fixed values: upper bounds of the parse latency histogram, in seconds
LATENCY_BUCKETS = [1, 5, 10, 30, 60, 120]


def latency_histogram(links: DataFrame) -> DataFrame:
    """Cumulative counts of parse times up to each bound, the total last (bound null)."""
    took = F.unix_micros(F.col("parsed_at").cast("timestamp")) - F.unix_micros(F.col("saved_at").cast("timestamp"))
    seen = links.where(F.col("parsed_at").isNotNull()).select((took / F.lit(1_000_000)).alias("seconds"))
    totals = seen.agg(*[F.count_if(F.col("seconds") <= b).alias(f"le_{b}") for b in LATENCY_BUCKETS],
                      F.count("*").alias("le_inf"))
    cells = [F.struct(F.lit(b).alias("le"), F.col(f"le_{b}").alias("n")) for b in LATENCY_BUCKETS]
    cells.append(F.struct(F.lit(None).cast("int").alias("le"), F.col("le_inf").alias("n")))
    return totals.select(F.inline(F.array(*cells)))


# ---- latest and newest -------------------------------------------------------------------------


def latest_per_link(jobs: DataFrame, order: Column) -> DataFrame:
    ranked = page_per_key(jobs, "link_id", [order.desc_nulls_last(), F.desc("id")], 1)
    return ranked.drop("pos")


def latest_success(jobs: DataFrame) -> DataFrame:
    return latest_per_link(jobs.where(F.col("status") == "done"), F.col("completed_at"))


def latest_path(jobs: DataFrame) -> DataFrame:
    """Latest job with a path, also where a newer export is still pending."""
    return latest_per_link(jobs.where(F.col("vault_path").isNotNull()), F.coalesce("completed_at", "created_at"))


def newest_in_collection(links: DataFrame, k: int = 6) -> DataFrame:
    filed = links.where(F.col("collection_id").isNotNull())
    return page_per_key(filed, "collection_id", [F.desc("saved_at"), F.desc("id")], k)
