"""Write rules as pure functions: (table, batch of changes) -> new table or verdicts.

A batch is one DataFrame of requests; the result is a new version of the table, to be written to a
new folder. Nothing is numbered, merged or checked on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import strings
from linkloom.session import ensure_checkpoint_dir

# names that differ only in case, accents or trailing spaces are one name
NAME_COLLATION = "UNICODE_CI_AI_RTRIM"


def same_name(c: Column) -> Column:
    return F.collate(c, NAME_COLLATION)


def number_rows(rows: DataFrame, key: Column, base: DataFrame, base_id: str = "id") -> DataFrame:
    """Give each row the next free id after the largest one in ``base``, in order of md5(key).

    ``key`` is unique per row. Ranks are taken inside 4096 hash buckets and shifted by the sizes of
    the buckets before, so the numbering is dense and repeatable without one global sort.
    """
    hashed = rows.withColumn("_h", F.md5(key.cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h")))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    # at most 4096 rows: the one unpartitioned window here is of fixed size
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("_b", before.alias("_shift")))
    top = base.select(F.coalesce(F.max(base_id), F.lit(-1))).scalar()
    numbered = ranked.join(shifts, "_b")
    return numbered.withColumn(base_id, top + F.col("_shift") + F.col("_r")).drop("_h", "_b", "_r", "_shift")


# ---- tags --------------------------------------------------------------------------------------


def tag_upsert(tags: DataFrame, names: DataFrame) -> DataFrame:
    """All tags after inserting the unseen names; of equal new names the smallest spelling is kept."""
    fresh = names.groupBy(same_name(F.col("name")).alias("folded")).agg(F.min("name").alias("name"))
    known = tags.select(same_name(F.col("name")).alias("folded"))
    unseen = fresh.join(known, "folded", "left_anti").select("name")
    return tags.select("id", "name").unionByName(number_rows(unseen, F.col("name"), tags))


def tag_ids(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """(link_id, tag_id) of wanted (link_id, name), names compared as the tag table does."""
    folded = tags.select(F.col("id").alias("tag_id"), same_name(F.col("name")).alias("folded"))
    return wanted.select("link_id", same_name(F.col("name")).alias("folded")).join(folded, "folded").select(
        "link_id", "tag_id").distinct()


def link_tags_attach(link_tags: DataFrame, edges: DataFrame) -> DataFrame:
    new = edges.select("link_id", "tag_id").distinct().join(link_tags, ["link_id", "tag_id"], "left_anti")
    return link_tags.select("link_id", "tag_id").unionByName(new)


def link_tags_detach(link_tags: DataFrame, links: DataFrame) -> DataFrame:
    return link_tags.join(links.select("link_id"), "link_id", "left_anti")


def link_tags_replace(link_tags: DataFrame, links: DataFrame, updates: DataFrame, edges: DataFrame) -> DataFrame:
    """Tag edges after updates (link_id, user_id) with their new edges; no new edges clears the link.

    Updates of links that are not the user's change nothing.
    """
    owned = owned_requests(links, updates)
    return link_tags_detach(link_tags, owned).unionByName(
        edges.select("link_id", "tag_id").distinct().join(owned, "link_id", "left_semi"))


# ---- links -------------------------------------------------------------------------------------


def owned_requests(links: DataFrame, requests: DataFrame) -> DataFrame:
    mine = links.select(F.col("id").alias("link_id"), "user_id")
    return requests.join(mine, ["link_id", "user_id"], "left_semi")


def link_insert(links: DataFrame, captures: DataFrame) -> DataFrame:
    """New 'pending' links from captures (seq, url, user_id, collection_id, saved_at).

    One link per (url, user): the first capture counts and known ones are refused.
    """
    hashed = captures.withColumn("url_hash", strings.url_hash(F.col("url")))
    known = links.select("url_hash", "user_id")
    # min_by over the whole row keeps the first capture with map-side combining
    columns = [c for c in hashed.columns if c not in ("url_hash", "user_id")]
    first = hashed.groupBy("url_hash", "user_id").agg(F.min_by(F.struct(*columns), F.col("seq")).alias("row"))
    fresh = first.join(known, ["url_hash", "user_id"], "left_anti").select("url_hash", "user_id", "row.*")
    key = F.concat_ws(":", "user_id", "url_hash")
    return number_rows(fresh, key, links).withColumn("status", F.lit("pending"))


def link_update(links: DataFrame, updates: DataFrame) -> DataFrame:
    """Set collection and export overrides of owned links, nulls included; a link's update with the largest seq wins.

    updates: (seq, link_id, user_id, collection_id, export_directory, export_file_name).
    """
    fields = ["collection_id", "export_directory", "export_file_name"]
    new = updates.groupBy(F.col("link_id").alias("id"), "user_id").agg(F.max_by(F.struct(*fields), "seq").alias("new"))
    joined = links.join(new, ["id", "user_id"], "left")
    for field in fields:
        joined = joined.withColumn(field, F.when(F.col("new").isNotNull(), F.col(f"new.{field}")).otherwise(F.col(field)))
    return joined.drop("new").select(links.columns)


def link_delete(links: DataFrame, requests: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """Owned deletes with their cascade: [links, *children] without the deleted ones."""
    gone = owned_requests(links, requests).select("link_id").distinct()
    kept = links.join(gone.withColumnRenamed("link_id", "id"), "id", "left_anti")
    return [kept] + [child.join(gone, "link_id", "left_anti") for child in children]


def link_mark(links: DataFrame, events: DataFrame) -> DataFrame:
    """Apply a batch of stage events (link_id, seq, kind, at, title, content_md, reading_time_min).

    kind is parsing, parsed, failed or indexed; the latest event of each concern wins. Being parsed stores the content.
    """
    given = [c for c in ("title", "content_md", "reading_time_min") if c in links.columns]
    seq = F.col("seq")
    states = F.col("kind").isin("parsing", "parsed", "failed")
    parsed = F.col("kind") == "parsed"
    latest = events.groupBy(F.col("link_id").alias("id")).agg(
        F.max_by(F.when(states, F.col("kind")), F.when(states, seq)).alias("new_status"),
        F.max_by(F.when(parsed, F.struct(*given, "at")), F.when(parsed, seq)).alias("parsed"),
        F.max_by(F.when(F.col("kind") == "indexed", F.col("at")), F.when(F.col("kind") == "indexed", seq)).alias("new_indexed"))
    joined = links.join(latest, "id", "left")
    was_parsed = F.col("parsed").isNotNull()
    return joined.withColumns({
        "status": F.coalesce("new_status", "status"),
        **{c: F.when(was_parsed, F.col(f"parsed.{c}")).otherwise(F.col(c)) for c in given},
        "parsed_at": F.when(was_parsed, F.col("parsed.at")).otherwise(F.col("parsed_at")),
        "indexed_at": F.coalesce("new_indexed", "indexed_at"),
    }).select(links.columns)


def index_reset(links: DataFrame) -> DataFrame:
    return links.withColumn("indexed_at", F.when(F.col("status") != "parsed", F.col("indexed_at")))


# ---- collections -------------------------------------------------------------------------------


def collection_write(collections: DataFrame, requests: DataFrame) -> DataFrame:
    """Judge inserts and renames (seq, collection_id null for an insert, user_id, name).

    Slugs that differ only in case, accents or trailing spaces are one slug. Within a batch the first request for a
    (user, slug) may succeed; a slug that a rename frees is free from the next batch on.
    """
    # collections may be made on the way (exploded), which Spark's estimates miss: they are merged with, never broadcast
    taken = collections.groupBy("user_id", same_name(F.col("slug")).alias("folded")).agg(F.min("id").alias("holder")).hint("merge")
    owners = collections.select(F.col("id").alias("collection_id"), F.col("user_id").alias("owner")).hint("merge")
    # inserts name no collection: they look for no owner, so they do not all meet in the task of the null key
    insert = F.col("collection_id").isNull()
    asked = requests.where(~insert).join(owners, "collection_id", "left").unionByName(
        requests.where(insert).withColumn("owner", F.lit(None).cast(owners.schema["owner"].dataType)))
    name = strings.java_trim(F.col("name"))
    judged = asked.withColumn("name", name).withColumn("slug", strings.collection_slug(F.col("name"))).withColumn(
        "folded", same_name(F.col("slug")))
    rows = judged.join(taken, ["user_id", "folded"], "left")
    error = (
        F.when(F.col("name").isNull(), "Missing 'name' field")
        .when(F.col("name") == "", "Collection name cannot be empty")
        .when(F.col("slug") == "", "Collection name must contain letters or numbers")
        .when(F.col("collection_id").isNotNull() & ~F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)),
              "Collection not found")
        .when(F.col("holder").isNotNull() & ~F.coalesce(F.col("holder") == F.col("collection_id"), F.lit(False)),
              "Collection with this name already exists")
    )
    rows = rows.withColumn("error", error)
    # the first acceptable request per key, by aggregate and join: hot keys combine map-side
    first = rows.where(F.col("error").isNull()).groupBy("user_id", "folded").agg(F.min("seq").alias("first_seq"))
    verdict = F.coalesce(
        "error", F.when(F.col("seq") > F.col("first_seq"), "Collection with this name already exists"), F.lit("ok"))
    return rows.join(first, ["user_id", "folded"], "left").select(
        "seq", "collection_id", "user_id", "name", "slug", verdict.alias("verdict"))


def collection_apply(collections: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The collections (id, name, slug, user_id) after the accepted requests of ``collection_write``.

    Of several accepted renames of a collection the last one counts; inserts get the next free ids.
    """
    # read four times below; stored, so requests are judged once
    ensure_checkpoint_dir(verdicts.sparkSession)
    done = verdicts.where(F.col("verdict") == "ok").checkpoint()
    renamed = done.where(F.col("collection_id").isNotNull()).groupBy(F.col("collection_id").alias("id")).agg(
        F.max_by(F.struct("name", "slug"), "seq").alias("new"))
    columns = ["id", "name", "slug", "user_id"]
    kept = collections.join(renamed, "id", "left").select(
        "id", F.coalesce("new.name", "name").alias("name"), F.coalesce("new.slug", "slug").alias("slug"), "user_id")
    fresh = number_rows(done.where(F.col("collection_id").isNull()), F.col("seq"), collections)
    return kept.unionByName(fresh.select(columns))


def collection_delete(collections: DataFrame, links: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collections, links) after deletes (collection_id, user_id): links lose the collection, not their row."""
    own = collections.select(F.col("id").alias("collection_id"), "user_id")
    gone = requests.join(own, ["collection_id", "user_id"], "left_semi").select("collection_id").distinct()
    kept = collections.join(gone.withColumnRenamed("collection_id", "id"), "id", "left_anti")
    # the user's own links leave the collection even where the collection is another user's
    asked = requests.select("collection_id", "user_id", F.lit(True).alias("asked")).distinct()
    flagged = links.join(gone.withColumn("gone", F.lit(True)), "collection_id", "left").join(
        asked, ["collection_id", "user_id"], "left")
    cleared = F.when(F.col("gone").isNull() & F.col("asked").isNull(), F.col("collection_id"))
    return kept, flagged.withColumn("collection_id", cleared).select(links.columns)


# ---- export jobs -------------------------------------------------------------------------------


def export_upsert(jobs: DataFrame, asked: DataFrame, state: str = "pending") -> DataFrame:
    """One job per asked link: a new row, or the old one set back with its path kept.

    ``pending`` (a user's request) also clears the error; ``exporting`` (a worker's start) keeps it.
    asked: (link_id, at).
    """
    wanted = asked.groupBy("link_id").agg(F.min("at").alias("at"))
    old = jobs.join(wanted.select("link_id", F.lit(True).alias("hit")), "link_id", "left")
    hit = F.col("hit").isNotNull()
    reset = {"status": F.when(hit, F.lit(state)).otherwise(F.col("status")),
             "completed_at": F.when(~hit, F.col("completed_at"))}
    if state == "pending":
        reset["error_msg"] = F.when(~hit, F.col("error_msg"))
    new = number_rows(wanted.join(jobs.select("link_id"), "link_id", "left_anti"), F.col("link_id"), jobs)
    empty = F.lit(None).cast("string")
    fresh = new.select("id", "link_id", F.lit(state).alias("status"), empty.alias("vault_path"),
                       empty.alias("error_msg"), F.col("at").alias("created_at"),
                       F.lit(None).cast(jobs.schema["completed_at"].dataType).alias("completed_at"))
    return old.withColumns(reset).select(fresh.columns).unionByName(fresh)


def export_update(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Set state, path and error; the completion time only for done and failed, cleared otherwise.

    updates: (seq, id, status, vault_path, error_msg, at); a job's update with the largest seq wins.
    """
    new = updates.groupBy("id").agg(F.max_by(F.struct("status", "vault_path", "error_msg", "at"), "seq").alias("new"))
    joined = jobs.join(new, "id", "left")
    hit = F.col("new").isNotNull()
    closed = F.when(F.col("new.status").isin("done", "failed"), F.col("new.at"))
    return joined.withColumns({
        "status": F.when(hit, F.col("new.status")).otherwise(F.col("status")),
        "vault_path": F.when(hit, F.col("new.vault_path")).otherwise(F.col("vault_path")),
        "error_msg": F.when(hit, F.col("new.error_msg")).otherwise(F.col("error_msg")),
        "completed_at": F.when(hit, closed).otherwise(F.col("completed_at")),
    }).select(jobs.columns)
