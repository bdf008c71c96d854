"""The named queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (audit, bytepairs, licences, markup, naming, nearsets, negatives, packing, pieces, quality, suffixes, urls,
                          windows)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
     g AS (SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g""")
def op2(spark, folder):
    return naming.mark_copies(table(spark, folder, "documents")).drop("row")


@query("op6_quality_rules", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10))
                   IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
     w AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS p FROM t),
     g AS (SELECT doc_id, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w
           WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
     d AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
     r AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
           FROM (SELECT doc_id, p, unnest([0, 1, 2]) AS k FROM d WHERE n > 1) GROUP BY doc_id),
     m AS (SELECT doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
                  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                  coalesce(n_repeat_words, 0) AS n_repeat_words
           FROM t LEFT JOIN r USING (doc_id)),
     b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * n_dup_lines > len(lines)
            OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{L}'))
            OR length(text) - length(replace(text, '!', '')) > 0.3 * n_words
            OR 2 * len(regexp_extract_all(text, '[\p{L}\p{M}]')) < word_chars
            OR list_sum([len(list_distinct(words[5000 * i + 1:5000 * i + 5000]))
                         FOR i IN range(0, greatest(len(words) - 1, 0) // 5000 + 1)]) < 0.2 * n_words
            OR len(regexp_extract_all(text, '\.\.\.|…')) > 0.3 * n_words) AS kept
FROM b""")
def op6(spark, folder):
    return quality.judge(table(spark, folder, "documents")).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


URL_RULES = tuple(urls.UrlRule(*r) for r in (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
    ("net/fr/", "block")))


def _url_sql(order: int = 4, bin_width: int = 20_000) -> str:
    def fits(rule):
        host, _, path = rule.place.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    longest = sorted(URL_RULES, key=lambda r: (-len(r.place), r.place))
    choose = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest) + " END"
    models = ""
    for n in range(order + 1):
        low = "1.0::DOUBLE / 256" if n == 0 else "l.{c}"
        chance = ", ".join(
            f"(g.{c} + greatest({c}_kinds, 1)::DOUBLE * ({low.format(c=c)})) / ({c}_n + greatest({c}_kinds, 1)::DOUBLE) AS {c}"
            for c in ("allow", "block"))
        shorter = f" JOIN m{n - 1} l ON l.run = right(g.run, {n})" if n else ""
        models += f""",
g{n} AS (SELECT right(run, {n + 1}) AS run, sum(allow)::BIGINT AS allow, sum(block)::BIGINT AS block FROM seen GROUP BY 1),
c{n} AS (SELECT left(run, {n}) AS context, sum(allow)::BIGINT AS allow_n, count(*) FILTER (allow > 0) AS allow_kinds,
  sum(block)::BIGINT AS block_n, count(*) FILTER (block > 0) AS block_kinds FROM g{n} GROUP BY 1),
m{n} AS (SELECT g.run, {chance} FROM g{n} g JOIN c{n} c ON c.context = left(g.run, {n}){shorter})"""
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS row, page_id, url, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host FROM r),
p AS (SELECT *, {choose(lambda r: r.place)} AS rule, {choose(lambda r: r.verdict)} AS decided FROM h),
k AS (SELECT *, CASE WHEN md5(url) < '2' THEN 'held_' || decided ELSE decided END AS class,
  repeat(chr(2), {order}) || host || path AS told FROM p),
runs AS (SELECT row, class, substring(told, i, {order + 1}) AS run
  FROM (SELECT row, class, told, unnest(range(1, length(told) - {order} + 1)) AS i FROM k)),
seen AS (SELECT run, count(*) FILTER (class = 'allow') AS allow, count(*) FILTER (class = 'block') AS block FROM runs GROUP BY run){models},
ratios AS (SELECT run, round((ln(allow) - ln(block)) * 1000000)::BIGINT AS ratio FROM m{order}),
scores AS (SELECT row, class, round(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM runs JOIN ratios USING (run) GROUP BY row, class),
bins AS (SELECT floor(score / {bin_width}) AS bin, count(*) FILTER (class = 'held_allow') AS good,
  count(*) FILTER (class = 'held_block') AS bad FROM scores GROUP BY 1),
sums AS (SELECT sum(good) AS good, sum(bad) AS bad, min(bin) AS least FROM bins),
errors AS (SELECT least AS cut, 1.0::DOUBLE AS error, 0 AS turn FROM sums
  UNION ALL SELECT bin + 1, sum(b.good) OVER o::DOUBLE / s.good + (s.bad - sum(b.bad) OVER o)::DOUBLE / s.bad, 1 FROM bins b, sums s
  WHERE s.good > 0 AND s.bad > 0 WINDOW o AS (ORDER BY bin)),
best AS (SELECT CASE WHEN good > 0 AND bad > 0 THEN (SELECT cut FROM errors ORDER BY round(error, 12), turn, cut LIMIT 1) * {bin_width} ELSE 0 END AS cut FROM sums)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score < cut THEN 'block' ELSE 'allow' END) AS verdict, score
FROM k LEFT JOIN scores USING (row), best"""


@query("op5_url_filter", _url_sql())
def op5(spark, folder):
    return urls.judge_urls(table(spark, folder, "pages"), URL_RULES)


def _licence_sql(threshold: float = 0.8) -> str:
    """The scan as a join of every unit with every template: no size bounds."""
    rows = ",\n".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(
        (name, text) for name in sorted(licences.TEMPLATES) for text in licences.TEMPLATES[name]))
    grams = "[words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]"
    return rf"""
WITH templates AS (SELECT place, name, string_split(text, ' ') AS words FROM (VALUES {rows}) AS v(place, name, text)),
     t AS (SELECT place, name, list_distinct({grams}) AS grams FROM templates),
     d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM d
           UNION ALL
           SELECT doc_id, unit FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '
[ 	-
]*
')) AS unit FROM d)
           WHERE contains(trim(unit, ' '), chr(10))),
     n AS (SELECT row_number() OVER () AS id, doc_id,
                  string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM u),
     g AS (SELECT id, doc_id, list_distinct({grams}) AS grams FROM n),
     s AS (SELECT id, doc_id, name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice,
                  place FROM g, t),
     b AS (SELECT id, doc_id, name FROM s WHERE dice >= {threshold}
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY dice DESC, place) = 1)
SELECT d.doc_id, count(b.id) AS n_found, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licences
FROM d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id"""


@query("op7_licence_scan", _licence_sql())
def op7(spark, folder):
    return licences.scan(table(spark, folder, "documents")).select("doc_id", "n_found", "licences")


@query("op4_html_extraction")
def op4(spark, folder):
    return markup.extract(table(spark, folder, "pages"))


@query("op10_substring_dedup", r"""
WITH w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
               SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
     s AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER f = 20 THEN string_agg(word, ' ') OVER f END AS win FROM w
           WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
     r AS (SELECT doc_id, i, word, win IS NOT NULL
                  AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM s),
     c AS (SELECT doc_id, i, word, max(CAST(again AS INT)) OVER (
                      PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
     k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
                  string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS body FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)""")
def op10(spark, folder):
    return windows.drop_repeats(table(spark, folder, "documents")).select(
        "doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_suffix_dedup")
def op3(spark, folder):
    return suffixes.drop_repeated_strings(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_minhash_dedup")
def op9(spark, folder):
    return nearsets.near_groups(table(spark, folder, "documents")).drop("row")


@query("op8_sentencepiece")
def op8(spark, folder):
    rows = pieces.decode(pieces.encode(table(spark, folder, "documents")))
    return rows.select(F.col("key").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_ids"),
                       (F.col("decoded") == F.col("text")).alias("lossless"))


@query("op1_best_fit_packing")
def op1(spark, folder):
    return packing.pack(table(spark, folder, "documents"), with_ids=False)


@query("op11_hard_negatives", r"""
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     e AS (SELECT row_number() OVER () AS r, * FROM u),
     s AS (SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike,
                  CAST(list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score
           FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
     p AS (SELECT a, anchor_id, b, id AS positive_id, score AS positive_score FROM s WHERE alike
           QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, id) AS INT) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, id) <= 5""")
def op11(spark, folder):
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


@query("op12_filter_audit", r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                   100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
           FROM d LEFT JOIN l USING (doc_id)),
     g AS (SELECT part, fails, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (good) AS BIGINT) AS good,
                  CAST(count(*) FILTER (toxic) AS BIGINT) AS toxic FROM f GROUP BY part, fails),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter
           FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
     h AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[strpos('ABCDE', letter)] AS here,
                  len([j FOR j IN range(1, step) IF fails[strpos('ABCDE', substr(filter_order, j, 1))]]) > 0 AS gone,
                  len([x FOR x IN fails IF x]) = 1 AS one FROM s, g),
     r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept,
                  sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
                  sum(CASE WHEN here AND one THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost,
                  sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r""")
def op12(spark, folder):
    return audit.interactions(audit.tally(table(spark, folder, "documents"), table(spark, folder, "labels")))


@query("op13_byte_bpe")
def op13(spark, folder):
    rows = bytepairs.decode(bytepairs.encode(table(spark, folder, "documents")))
    return rows.select(F.col("key").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
