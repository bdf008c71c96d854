"""Streams over the event and page tables; each must equal its batch form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from linkloom.operators import metrics, ratelimit
from linkloom.plans.events import TIGHT, q_replay, q_ttl
from linkloom.plans.pages import q_text
from linkloom.plans.registry import query
from linkloom.plans.relational import joined
from linkloom.plans.scalars import AS_OF, q_stem
from linkloom.plans.search import _RESYNC
from linkloom.sources import codecs
from linkloom.sources.versions import Files
from linkloom.streaming import feed, firsts, flows, queues, stateful, ttl, windows


def stream_of(t, table):
    """The files of one table as a stream, be it one file or a folder of them."""
    base = t.base(table)
    place = f"{t.folder}/{table}.parquet"
    files = Files(t.spark, t.folder)
    if files.fs.getFileStatus(files.path(place)).isDirectory():
        return t.spark.readStream.schema(base.schema).parquet(place)
    return t.spark.readStream.schema(base.schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


def captures(t):
    return stream_of(t, "events").select("event_id", "ts", "user_id", F.concat(F.lit("https://example.com/"), "event_type").alias("url"))


@query("stream_ttl_dedup", q_ttl("user_id || ' ' || url", 86400))
def stream_ttl_dedup(t):
    rows = captures(t).select(F.concat_ws(" ", "user_id", "url").alias("key"), "ts", "event_id")
    out = flows.collect_batches(stateful.ttl_dedup_stream(rows, ["key"]), flows.work_folder(t.spark, "ttl"))
    return out.where("verdict = 'kept'").select(
        "key", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.col("seq").alias("event_id"))


@query("stream_ttl_processor", q_ttl("user_id || ' ' || url", 86400))
def stream_ttl_processor(t):
    """The state processor; two rows long after all others move the watermark past them."""
    folder, provider = flows.work_folder(t.spark, "ttl-processor"), "spark.sql.streaming.stateStore.providerClass"
    rows = t.captures.select(F.concat_ws(" ", "user_id", "url").alias("key"), "ts", "event_id")
    last = rows.agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    before = t.spark.conf.get(provider)
    ttl.use_state_store(t.spark)
    try:
        for days in (0, 3, 6):
            end = last.select(F.lit("end").alias("key"), (F.col("ts") + F.make_dt_interval(F.lit(days))).alias("ts"), "event_id")
            (end if days else rows).write.mode("append").parquet(f"{folder}/in")
            stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            out = flows.collect_batches(ttl.ttl_dedup_processor(stream, ["key"], cell_seconds=86400), folder)
    finally:
        t.spark.conf.set(provider, before)
    return out.where("verdict = 'kept' AND key <> 'end'").select(
        "key", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.col("seq").alias("event_id"))


@query("stream_permanent_dedup", "SELECT user_id, url, min(event_id) AS event_id FROM v_captures GROUP BY 1, 2")
def stream_permanent_dedup(t):
    store = firsts.FirstArrivals(t.spark, flows.work_folder(t.spark, "first"), ["user_id", "url"], "event_id", buckets=8)
    return store.run(captures(t)).select("user_id", "url", "event_id")


@query("stream_rate_limit", "SELECT seq, key, allowed, used, reset_at FROM (" + q_replay(TIGHT).strip() + ") r")
def stream_rate_limit(t):
    requests = stream_of(t, "events").select(
        "event_id", "ts", F.when(F.col("event_type") == "signup", "/auth/login").when(F.col("event_type") == "view", "/links/search")
        .when(F.col("event_type") == "error", "/health").otherwise("/links").alias("path"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 20, F.lit(", 172.16.0.1")).alias("x_forwarded_for"))
    judged = stateful.rate_limit_stream(ratelimit.keyed_requests(requests, TIGHT))
    return flows.collect_batches(judged, flows.work_folder(t.spark, "rate")).drop("late")


@query("stream_slot_counts", """
SELECT event_type, epoch(date_trunc('second', ts))::BIGINT // 15 AS slot, count(*) AS c FROM events GROUP BY 1, 2""")
def stream_slot_counts(t):
    counts = windows.slot_counts_stream(stream_of(t, "events"), ["event_type"])
    return windows.final_counts(flows.collect_batches(counts, flows.work_folder(t.spark, "slots"), "update"), ["event_type"])


@query("feed", """SELECT '{"type":"link_parsed","linkId":' || user_id || '}' AS value FROM events WHERE event_type = 'view'""")
def feed_stream(t):
    parsed = stream_of(t, "events").where("event_type = 'view'").select(F.col("user_id").alias("link_id"))
    return flows.collect_batches(feed.feed_messages(parsed), flows.work_folder(t.spark, "feed"))


@query("src_queue", "SELECT event_id AS link_id FROM events WHERE event_type <> 'error'")
def src_queue(t):
    # queue entries of error events are not numbers and are skipped
    entry = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id").cast("string"))
    folder = flows.work_folder(t.spark, "queue")
    queues.enqueue(t.base("events").select(entry.alias("value")), f"{folder}/entries")
    return flows.collect_batches(feed.link_ids(queues.read_queue(t.spark, f"{folder}/entries")), folder)


@query("src_feed", "SELECT event_id AS link_id FROM events WHERE event_type <> 'signup'")
def src_feed(t):
    entry = F.when(F.col("event_type") == "signup", "not a number").otherwise(F.col("event_id").cast("string"))
    folder = flows.work_folder(t.spark, "subscriber")
    for half in (0, 1):  # two runs, one batch each
        queues.enqueue(t.base("events").where(F.col("event_id") % 2 == half).select(entry.alias("value")), f"{folder}/entries")
    return flows.collect_batches(feed.link_ids(queues.read_queue(t.spark, f"{folder}/entries")), folder)


@query("capture_flow", f"""
WITH first AS (SELECT url, page_id % 50 AS user_id, min(page_id) AS seq FROM pages GROUP BY 1, 2),
p AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1)
SELECT f.seq, f.user_id, f.url, coalesce(nullif({q_text("regexp_extract(g.html, '(?s)<title>(.*?)</title>', 1)")}, ''), f.url) AS title,
  'collections/unsorted/' || {q_stem(q_text("regexp_extract(g.html, '(?s)<title>(.*?)</title>', 1)"))} || '.md' AS path
FROM first f JOIN p ON p.url = f.url JOIN pages g ON g.page_id = p.page_id""")
def capture_flow(t):
    folder = flows.work_folder(t.spark, "capture")
    corpus = t.pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    flow = flows.CaptureFlow(t.spark, corpus, folder, F.lit(AS_OF).cast("timestamp"))
    flow.run(flows.page_captures(stream_of(t, "pages")))
    notes = flow.table("notes").select(F.col("link_id").alias("id"), "path")
    return flow.table("links").join(notes, "id").select("seq", "user_id", "url", "title", "path")


@query("incremental_index", _RESYNC + " AND l.id IN (SELECT o_orderkey FROM orders)")
def incremental_index(t):
    folder = flows.work_folder(t.spark, "index")
    ids = stream_of(t, "orders").select(F.col("o_orderkey").alias("link_id"))
    index = flows.IncrementalIndex(t.full_links, t.collections, t.link_tags, t.tags, folder)
    index.run(ids)
    return index.documents().withColumn("tags", joined())


@query("stream_links_per_hour", """
WITH closed AS (SELECT event_id, ts, kind, epoch(date_trunc('second', ts))::BIGINT // 15 AS slot FROM v_attempts WHERE kind = 'link_created'),
s AS (SELECT slot, count(*) AS c FROM closed GROUP BY 1)
SELECT make_timestamp((slot + 1) * 15 * 1000000) AS "at", (sum(c) OVER (ORDER BY slot RANGE BETWEEN 239 PRECEDING AND CURRENT ROW))::BIGINT AS n FROM s""")
def stream_links_per_hour(t):
    created = stream_of(t, "events").where("event_type = 'click'")
    counts = flows.collect_batches(windows.slot_counts_stream(created), flows.work_folder(t.spark, "hourly"), "update")
    slots = windows.final_counts(counts)
    return metrics.sliding_from_slots(slots, 3600)


# ---- JSON records ------------------------------------------------------------------------------


@query("src_json", """
SELECT event_id AS id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE 'https://example.com/' || event_type END AS url,
  CASE event_type WHEN 'click' THEN 'parsed' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'failed' END AS status,
  CASE WHEN event_type = 'error' THEN 'Unknown LinkStatus: lost' WHEN event_type = 'signup' THEN 'Invalid instant: yesterday' END AS error FROM events""")
def src_json(t):
    kind = F.col("event_type")
    state = F.when(kind == "click", "PARSED").when(kind == "view", "pending").when(kind == "purchase", "Failed").when(
        kind == "error", "lost").otherwise("parsing")
    record = F.struct(
        F.col("event_id").alias("id"), F.concat(F.lit("https://example.com/"), kind).alias("url"), F.lit("h").alias("urlHash"),
        state.alias("status"), F.when(kind == "signup", "yesterday").otherwise("2024-01-01T00:00:00.5Z").alias("savedAt"))
    texts = t.base("events").select(F.to_json(record).alias("value"))
    good, bad = codecs.decode(texts, "link")
    number = F.get_json_object("value", "$.id").cast("bigint")
    none = F.lit(None).cast("string")
    return good.select("id", "url", "status", none.alias("error")).unionAll(bad.select(number, none, none, "error"))


@query("sink_json", """
SELECT '{"id":' || id || ',"title":' || coalesce('"' || title || '"', 'null') || ',"savedAt":"' || strftime(saved_at, '%Y-%m-%dT%H:%M:%SZ') || '","parsedAt":'
  || coalesce('"' || strftime(parsed_at, '%Y-%m-%dT%H:%M:%SZ') || '"', 'null') || ',"status":"' || status || '"}' AS value FROM v_links""")
def sink_json(t):
    names = {"id": "id", "title": "title", "saved_at": "savedAt", "parsed_at": "parsedAt", "status": "status"}
    return codecs.encode(t.links, names)





def _faulty(name, key, fields, good):
    """SQL of one entity: faults by the key's remainder (``fields``: remainder to message), 3: cut off, else the good row."""
    cases = " ".join(f"WHEN {key} % 5 = {r}{extra} THEN {message}" for r, extra, message in fields)
    return f"""SELECT '{name}' AS entity, {key} AS key, CASE {cases} WHEN {key} % 5 = 3 THEN 'not a JSON record of this kind' END AS error, {good} AS detail"""


_ENTITIES = " UNION ALL ".join([
    _faulty("link", "id", [(1, "", "'Invalid instant: day ' || id"), (2, "", "'Unknown LinkStatus: lost' || id")],
            "url || ' ' || status || ' ' || epoch(saved_at)::BIGINT || ' ' || coalesce(epoch(parsed_at)::BIGINT::VARCHAR, '-')") + " FROM v_links",
    _faulty("collection", "id", [(1, "", "'Invalid instant: ' || name"), (4, "", "'missing field slug'")],
            "name || ' ' || slug || ' ' || (user_id * 86400)") + " FROM v_collections",
    _faulty("tag", "id", [(4, "", "'missing field name'")], "name") + " FROM v_tags",
    _faulty("link_tag", "link_id", [(4, "", "'missing field tagId'")], "tag_id::VARCHAR") + " FROM v_link_tags",
    _faulty("export_job", "id", [(1, "", "'Unknown ExportStatus: lost' || id"), (0, " AND completed_at IS NOT NULL", "'Invalid instant: later'")],
            "status || ' ' || coalesce(vault_path, '-') || ' ' || epoch(created_at)::BIGINT") + " FROM v_export_jobs",
    _faulty("parse_job", "id", [(4, "", "'missing field url'")], "url") + " FROM v_links"])


@query("src_json_entities", f"WITH e AS ({_ENTITIES}) SELECT entity, key, error, CASE WHEN error IS NULL THEN detail END AS detail FROM e")
def src_json_entities(t):
    """Records of six entities made from the tables, each with its kinds of fault."""
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    at = lambda c: F.unix_seconds(F.col(c)).cast("string")
    text, dash = F.col, lambda c: F.coalesce(c, F.lit("-"))
    left = F.col("id") % 5
    records = {
        "link": (t.links, "id", F.struct(
            "id", "url", F.lit("h").alias("urlHash"), F.when(left == 2, F.concat(F.lit("Lost"), "id")).otherwise(F.upper("status")).alias("status"),
            F.when(left == 1, F.concat(F.lit("day "), "id")).otherwise(iso("saved_at")).alias("savedAt"), iso("parsed_at").alias("parsedAt")),
            F.concat_ws(" ", "url", "status", at("savedAt"), dash(at("parsedAt")))),
        "collection": (t.collections, "id", F.struct(
            "id", "name", F.when(left != 4, F.col("slug")).alias("slug"), F.col("user_id").alias("userId"),
            F.when(left == 1, F.col("name")).otherwise(iso(F.timestamp_seconds(F.col("user_id") * 86400))).alias("createdAt")),
            F.concat_ws(" ", "name", "slug", at("createdAt"))),
        "tag": (t.tags, "id", F.struct("id", F.when(left != 4, F.col("name")).alias("name")), text("name")),
        "link_tag": (t.link_tags, "link_id", F.struct(
            F.col("link_id").alias("linkId"), F.when(F.col("link_id") % 5 != 4, F.col("tag_id")).alias("tagId")), text("tagId").cast("string")),
        "export_job": (t.export_jobs, "id", F.struct(
            "id", F.col("link_id").alias("linkId"), F.when(left == 1, F.concat(F.lit("LOST"), "id")).otherwise(F.col("status")).alias("status"),
            F.col("vault_path").alias("vaultPath"), iso("created_at").alias("createdAt"),
            F.when(F.col("completed_at").isNotNull(), F.when(left == 0, "later").otherwise(iso("completed_at"))).alias("completedAt")),
            F.concat_ws(" ", "status", dash(text("vaultPath")), at("createdAt"))),
        "parse_job": (t.links, "id", F.struct(F.col("id").alias("linkId"), F.when(left != 4, F.col("url")).alias("url")), text("url"))}
    out = []
    for name, (rows, key, record, detail) in records.items():
        whole = F.to_json(record)
        texts = rows.select(whole.alias("whole"), F.col(key).alias("key"))
        texts = texts.select(F.when(F.col("key") % 5 == 3, F.expr("substring(whole, 1, length(whole) - 1)")).otherwise(F.col("whole")).alias("value"))
        # judged once: valid and refused records come from the same scan
        judged = codecs.judge(texts, name)
        fields = judged.schema["r"].dataType.names
        own = "id" if "id" in fields else "linkId"
        good, none = F.col("error").isNull(), F.lit(None).cast("string")
        named = F.regexp_extract("value", rf'"{own}":(\d+)', 1).cast("bigint")
        rows = judged.select("value", "error", "r.*").select(
            F.lit(name).alias("entity"), F.when(good, F.col(own)).otherwise(named).alias("key"), "error",
            F.when(good, detail).otherwise(none).alias("detail"))
        out.append(rows)
    return reduce(lambda a, b: a.unionByName(b), out)
