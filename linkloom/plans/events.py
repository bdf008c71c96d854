"""Event-log queries: deduplication, admission, operating numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import strings
from linkloom.operators import dedup, metrics, ratelimit
from linkloom.plans.registry import query


def q_ttl(key, ttl):
    return f"""
WITH RECURSIVE c AS (SELECT {key} AS key, ts, event_id FROM v_captures),
kept AS (SELECT key, min(ts) AS ts FROM c GROUP BY key
  UNION ALL SELECT k.key, (SELECT min(c.ts) FROM c WHERE c.key = k.key AND c.ts >= k.ts + INTERVAL {ttl} SECOND) FROM kept k
  WHERE k.ts IS NOT NULL)
SELECT c.key, c.ts, min(c.event_id) AS event_id FROM kept k JOIN c ON c.key = k.key AND c.ts = k.ts GROUP BY 1, 2"""


@query("ttl_dedup", q_ttl("user_id || ' ' || url", 86400))
def ttl_dedup(t):
    captures = t.captures.select(F.concat_ws(" ", "user_id", "url").alias("key"), "ts", "event_id")
    return dedup.ttl_dedup(captures, ["key"])


@query("ttl_dedup_hot", q_ttl("url", 3600))
def ttl_dedup_hot(t):
    # few keys with many captures each: none of them is brought together
    captures = t.captures.select(F.col("url").alias("key"), "ts", "event_id")
    return dedup.ttl_dedup(captures, ["key"], ttl_seconds=3600, hot_rows=50, cells=60)


@query("permanent_dedup", """
SELECT user_id, url, min(event_id) AS event_id, min_by(ts, event_id) AS ts FROM v_captures GROUP BY 1, 2""")
def permanent_dedup(t):
    return dedup.permanent_dedup(t.captures, ["user_id", "url"], "event_id")


def q_replay(limits):
    case_n = " ".join(f"WHEN '{k}' THEN {n}" for k, (n, _) in limits.items())
    case_s = " ".join(f"WHEN '{k}' THEN {s * 1000}" for k, (_, s) in limits.items())
    return f"""
WITH RECURSIVE b AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ms, split_part(x_forwarded_for, ',', 1) AS ip,
  CASE WHEN path IN ('/health', '/metrics') THEN NULL WHEN path LIKE '/auth/%' THEN 'auth' WHEN path LIKE '/links/search%' THEN 'search' ELSE 'general' END AS bucket FROM v_requests),
k AS (SELECT seq, ms, 'rate-limit:' || bucket || ':' || ip AS key, CASE bucket {case_n} END AS most, CASE bucket {case_s} END AS span FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS rn FROM k WHERE key IS NOT NULL),
r AS (SELECT o.key, o.rn, o.seq, o.ms, o.most, o.span, 0 AS used, true AS allowed, [o.ms] AS log FROM o WHERE rn = 1
  UNION ALL SELECT o.key, o.rn, o.seq, o.ms, o.most, o.span, len(list_filter(r.log, lambda x: x > o.ms - o.span)),
    len(list_filter(r.log, lambda x: x > o.ms - o.span)) < o.most,
    CASE WHEN len(list_filter(r.log, lambda x: x > o.ms - o.span)) < o.most THEN list_append(list_filter(r.log, lambda x: x > o.ms - o.span), o.ms)
      ELSE list_filter(r.log, lambda x: x > o.ms - o.span) END
  FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1)
SELECT seq, key, allowed, used::INT AS used, CASE WHEN NOT allowed THEN ms // 1000 + span // 1000 END AS reset_at FROM r
UNION ALL SELECT seq, NULL, true, 0, NULL FROM k WHERE key IS NULL"""


# the second form is tight enough for this log to be refused often
TIGHT = {"auth": (2, 6 * 3600), "general": (5, 6 * 3600), "search": (3, 4 * 3600)}


@query("rate_limit", q_replay(strings.RATE_LIMITS))
def rate_limit(t):
    return ratelimit.replay(ratelimit.keyed_requests(t.requests))


@query("rate_limit_tight", q_replay(TIGHT))
def rate_limit_tight(t):
    return ratelimit.replay(ratelimit.keyed_requests(t.requests, TIGHT))


# ---- operating numbers -------------------------------------------------------------------------

_SLOTS = """s AS (SELECT {by} epoch(date_trunc('second', ts))::BIGINT // 15 AS slot, count(*) AS c FROM v_attempts WHERE {where} GROUP BY ALL)"""
_AT = "make_timestamp((slot + 1) * 15 * 1000000)"


@query("links_per_hour", f"""
WITH {_SLOTS.format(by='', where="kind = 'link_created'")}
SELECT {_AT} AS at, (sum(c) OVER (ORDER BY slot RANGE BETWEEN 239 PRECEDING AND CURRENT ROW))::BIGINT AS links FROM s""".replace(" AS at,", ' AS "at",'))
def links_per_hour(t):
    return metrics.links_per_hour(t.attempts)


@query("failure_rates", f"""
WITH {_SLOTS.format(by='failure_type,', where='failure_type IS NOT NULL')}
SELECT failure_type, {_AT} AS "at", round((sum(c) OVER (PARTITION BY failure_type ORDER BY slot RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)) / 300, 6) AS per_second FROM s""")
def failure_rates(t):
    return metrics.failure_rates(t.attempts)


@query("export_success_pct", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE kind = 'export_success') AS ok, count(*) FILTER (WHERE kind = 'export_failed') AS bad FROM v_attempts GROUP BY 1),
p AS (SELECT day, round(ok * 100 / nullif(ok + bad, 0), 6) AS pct FROM d)
SELECT day, pct, CASE WHEN pct < 80 THEN 'red' WHEN pct < 95 THEN 'yellow' WHEN pct IS NOT NULL THEN 'green' END AS level FROM p""")
def export_success_pct(t):
    return metrics.export_success_pct(t.attempts)


@query("queue_depth", f"""
WITH x AS (SELECT epoch(date_trunc('second', ts))::BIGINT // 15 AS slot, CASE WHEN kind = 'link_created' THEN 2 WHEN kind IN ('export_success', 'parse_failed') THEN -1 ELSE 0 END AS change FROM v_attempts),
s AS (SELECT slot, sum(change) AS c FROM x GROUP BY 1), d AS (SELECT slot, (sum(c) OVER (ORDER BY slot))::BIGINT AS depth FROM s)
SELECT {_AT} AS "at", depth, CASE WHEN depth >= 50 THEN 'red' WHEN depth >= 10 THEN 'yellow' ELSE 'green' END AS level FROM d""")
def queue_depth(t):
    kind = F.col("kind")
    change = F.when(kind == "link_created", 2).when(kind.isin("export_success", "parse_failed"), -1).otherwise(0)
    return metrics.queue_depth(t.attempts.select("ts", change.alias("change")))


@query("index_gap", "SELECT count(*) - count(indexed_at) AS gap FROM v_links")
def index_gap(t):
    return metrics.index_gap(t.links)


@query("job_counters", """
WITH x AS (SELECT date_trunc('hour', ts) AS hour, CASE WHEN kind LIKE 'export%' OR failure_type = 'export' THEN 'export' ELSE 'parse' END AS stage,
  CASE WHEN kind IN ('link_created', 'export_success') THEN 1 ELSE 0 END AS ok FROM v_attempts)
SELECT hour, stage, count(*) AS started, sum(ok)::BIGINT AS completed, sum(1 - ok)::BIGINT AS failed FROM x GROUP BY 1, 2""")
def job_counters(t):
    return metrics.job_counters(t.attempts)


# ---- messages ----------------------------------------------------------------------------------


@query("sink_feed", """SELECT '{"type":"link_parsed","linkId":' || id || '}' AS value FROM v_links WHERE status = 'parsed'""")
def sink_feed(t):
    from linkloom.streaming.feed import feed_messages

    return feed_messages(t.links.where(F.col("status") == "parsed").select(F.col("id").alias("link_id")))
