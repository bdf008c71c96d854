"""Page corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import pages as pg
from linkloom.plans.registry import query
from linkloom.plans.scalars import AS_OF


def q_text(x):
    """Text of HTML for DuckDB: entities that occur in the corpus, white space collapsed."""
    decoded = (f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")
    return rf"trim(regexp_replace({decoded}, '[ \t\n\f\r]+', ' ', 'g'))"


@query("page_title", f"""
SELECT page_id, coalesce(nullif({q_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ''), url) AS title FROM pages""")
def page_title(t):
    parts = pg.page_parts(t.pages)
    return parts.select("page_id", pg.title_of(parts).alias("title"))


@query("page_meta", """
SELECT page_id, 'about ' || page_id AS description, CASE WHEN page_id % 2 = 0 THEN 'https://img.example/' || page_id || '.png' END AS og_image FROM pages""")
def page_meta(t):
    # the corpus has no descriptions: give each page some before its title
    about = F.concat(
        F.lit('<meta name="description" content=""><meta property="og:description" content="about '), "page_id", F.lit('">'),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta property="og:image" content="https://img.example/'), "page_id",
                                                   F.lit('.png">'))).otherwise(""), F.lit("<title>"))
    html = F.replace(F.col("html"), F.lit("<title>"), about)
    return pg.page_parts(t.pages.withColumn("html", html)).select("page_id", "description", "og_image")


@query("page_strip", r"""
SELECT page_id, len(regexp_extract_all(html, '<(script|style|nav|footer|header|noscript|iframe)\b'))::INT AS removed FROM pages""")
def page_strip(t):
    return pg.page_parts(t.pages).select("page_id", "removed")


@query("page_main", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'article' WHEN page_id % 3 = 1 THEN '[role=main]' ELSE '.markdown-body' END AS main_place FROM pages""")
def page_main(t):
    opening = (F.when(F.col("page_id") % 3 == 0, "<article>").when(F.col("page_id") % 3 == 1, "<section role=main>")
               .otherwise("<div class='x Markdown-Body'>"))
    html = F.replace(F.col("html"), F.lit("<article>"), opening)
    return pg.page_parts(t.pages.withColumn("html", html)).select("page_id", "main_place")


@query("page_code_lang", "SELECT page_id, 'py|hljs js' AS languages FROM pages")
def page_code_lang(t):
    code = '<pre><code class="language-py">a = 1</code></pre><pre><code class="hljs lang-js">b</code></pre><h1>'
    html = F.replace(F.col("html"), F.lit("<h1>"), F.lit(code))
    return pg.page_parts(t.pages.withColumn("html", html)).select("page_id", F.array_join("languages", "|").alias("languages"))


_INNER = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


@query("page_markdown")
def page_markdown(t):
    done = pg.parse_pages(t.pages, F.lit(AS_OF).cast("timestamp_ntz"))
    return done.select("page_id", "content_md")


@query("page_markdown_words", rf"""
SELECT page_id, trim(regexp_replace({q_text(rf"regexp_replace({_INNER}, '<[^>]*>', ' ', 'g')")}, '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')) AS words FROM pages""")
def page_markdown_words(t):
    # the Markdown holds exactly the words of the main content, in order
    done = pg.parse_pages(t.pages, F.lit(AS_OF).cast("timestamp_ntz"))
    return done.select("page_id", F.trim(F.regexp_replace("content_md", r"[^\p{L}\p{Nd}]+", " ")).alias("words"))


@query("parse_pages", f"""
SELECT page_id, 'parsed' AS status, {q_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, url,
  CAST('{AS_OF}' AS TIMESTAMP) AS parsed_at FROM pages""")
def parse_pages(t):
    done = pg.parse_pages(t.pages, F.lit(AS_OF).cast("timestamp_ntz"))
    return done.select("page_id", "status", "title", "url", "parsed_at")


_IMAGES = r"""img AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, '<li><a href="/([^"]*)"', 1), lambda s: 'https://img.example/' || s)) AS urls,
  list_transform(regexp_extract_all(html, '<li><a href="/([^"]*)"', 1), lambda s: 'https://img.example/' || s) AS seen FROM pages)"""


def pictured(t):
    """Pages whose menu entries became images."""
    html = F.replace(F.col("html"), F.lit('<li><a href="/'), F.lit('<li><img src="https://img.example/'))
    return t.pages.withColumn("html", html)


@query("page_images", f"""
WITH {_IMAGES}, u AS (SELECT page_id, unnest(urls) AS image_url, seen FROM img)
SELECT page_id, image_url, (row_number() OVER (PARTITION BY page_id ORDER BY list_position(seen, image_url)) - 1)::INT AS pos FROM u""")
def page_images(t):
    return pg.page_images(pictured(t))


@query("distinct_images", f"WITH {_IMAGES} SELECT page_id, len(urls)::INT AS n FROM img")
def distinct_images(t):
    return pg.page_parts(pictured(t)).select("page_id", F.size("images").alias("n"))


@query("image_size_filter", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * 200 <= 10485760 AND l_quantity * 250000 <= 10485760""")
def image_size_filter(t):
    assets = t.base("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 200).alias("declared_bytes"),
        (F.col("l_quantity") * 250000).alias("real_bytes"))
    return pg.image_size_filter(assets).select("l_orderkey", "l_linenumber")


# Markdown made of the documents: sentences become headings, items, quotes and fences by their first letter
_MARKS = [("A", "# "), ("E", "- "), ("T", "> "), ("I", "```"), ("D", "### ")]


def marked(column):
    text = F.replace(F.col(column), F.lit(". "), F.lit(".\n"))
    for letter, mark in _MARKS:
        text = F.replace(text, F.lit("\n" + letter), F.lit("\n" + mark + letter))
    return F.replace(text, F.lit("the.\n"), F.lit("the.\n\n"))


def q_marked(x):
    text = f"replace({x}, '. ', '.' || chr(10))"
    for letter, mark in _MARKS:
        text = f"replace({text}, chr(10) || '{letter}', chr(10) || '{mark}{letter}')"
    return f"replace({text}, 'the.' || chr(10), 'the.' || chr(10) || chr(10))"


@query("markdown_blocks", rf"""
WITH m AS (SELECT doc_id, string_split(replace({q_marked('text')}, chr(13), ''), chr(10)) AS lines FROM documents WHERE text <> ''),
r AS (SELECT doc_id, unnest(range(len(lines)))::INT AS n, unnest(lines) AS line FROM m),
s AS (SELECT *, trim(line, ' ' || chr(9)) AS t FROM r),
f AS (SELECT *, starts_with(t, '```') AS fence FROM s),
g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM f),
k AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}\s+.*$') THEN 'heading'
  WHEN regexp_matches(line, '^[-*+]\s+.*$') THEN 'list' WHEN regexp_matches(line, '^>\s?.*$') THEN 'quote' WHEN t = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM g),
w AS (SELECT *, CASE kind WHEN 'heading' THEN n
  WHEN 'paragraph' THEN coalesce(min(n) FILTER (WHERE kind IN ('fence', 'heading', 'list', 'quote', 'blank')) OVER ahead, 2147483647)
  WHEN 'list' THEN coalesce(min(n) FILTER (WHERE kind IN ('fence', 'heading', 'quote', 'blank')) OVER ahead, 2147483647)
  WHEN 'quote' THEN coalesce(min(n) FILTER (WHERE kind IN ('fence', 'heading', 'list', 'blank')) OVER ahead, 2147483647)
  WHEN 'code' THEN coalesce(min(n) FILTER (WHERE kind = 'fence') OVER ahead, 2147483647) END AS at_n,
  CASE kind WHEN 'heading' THEN regexp_extract(line, '^#{{1,6}}\s+(.*)$', 1) WHEN 'list' THEN regexp_extract(line, '^[-*+]\s+(.*)$', 1)
   WHEN 'quote' THEN regexp_extract(line, '^>\s?(.*)$', 1) WHEN 'code' THEN line ELSE t END AS val,
  CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) END AS level
  FROM k WINDOW ahead AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, at_n AS "at", CASE kind WHEN 'paragraph' THEN 0 WHEN 'list' THEN 1 WHEN 'quote' THEN 2 WHEN 'code' THEN 3 ELSE 4 END AS rank, kind, level,
  CASE WHEN kind IN ('code', 'list') THEN string_agg(val, chr(10) ORDER BY n) ELSE string_agg(val, ' ' ORDER BY n) END AS text
FROM w WHERE at_n IS NOT NULL GROUP BY doc_id, at_n, kind, level""")
def markdown_blocks(t):
    return pg.markdown_blocks(t.base("documents").select("doc_id", marked("text").alias("md")), "doc_id", "md")
