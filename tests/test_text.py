"""Column functions and the HTML helper on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import notes, strings
from linkloom.functions.html import parse_page
from linkloom.operators import pages as pg
from linkloom.sources import codecs


def value(spark, make, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize("text,wikilink,stem", [
    ("a - b", "a---b", "a-b"), ("Tea! (no. 7)", "tea-no-7", "tea-no-7"),
    ("  Report.MD", "-reportmd", "report"), ("--x--", "--x--", "x"), ("ÄÖ", "", "untitled"), ("tab\x0bbed", "tab-bed", "tab-bed"),
    ("w" * 90, "w" * 80, "w" * 80), ("", "", "untitled")])
def test_slugs(spark, text, wikilink, stem):
    assert value(spark, strings.wikilink_slug, text) == wikilink
    assert value(spark, strings.file_stem, text) == stem


def test_collection_slug(spark):
    assert value(spark, strings.collection_slug, "Read Later") == "read-later"
    assert value(spark, strings.collection_slug, "  Müßig & Größe 3 ") == "müßig-größe-3"
    assert value(spark, strings.collection_slug, "?!") == ""
    assert value(spark, strings.collection_slug, "𝒜" * 60) == "𝒜" * 50  # 100 units are 50 such letters


def test_utf16_left(spark):
    assert value(spark, lambda c: strings.utf16_left(c, 3), "a😀b") == "a😀"
    assert value(spark, lambda c: strings.utf16_left(c, 2), "a😀b") == "a"


def test_paths(spark):
    assert value(spark, strings.normalize_directory, r" sales\..//Q1 /./é") == "sales/q1"
    path = value(spark, lambda d, n, t, c: strings.note_path(d, n, t, c), "sales/q1", "Plan B (old).md", "T", "dev")
    assert path == "collections/sales/q1/plan-b-old.md"
    assert value(spark, lambda d, n, t, c: strings.note_path(d, n, t, c), None, None, "T", "") == "collections/unsorted/t.md"
    absolute = value(spark, lambda d, n, t, c: strings.note_path(d, n, t, c, True), "/data/x/../y", None, "T", "c")
    assert absolute == "/data/y/t.md"


@pytest.mark.parametrize("text,h", [("", 0), ("a", 97), ("hello", 99162322), ("polygenelubricants", -2147483648), ("😀", 1772899)])
def test_java_hash(spark, text, h):
    assert value(spark, strings.java_string_hash, text) == h


def test_image_name_of_smallest_hash(spark):
    assert value(spark, lambda i, u: strings.image_filename(i, u, F.lit("image/webp")), "1", "polygenelubricants") == "1_-2147483648.webp"


@pytest.mark.parametrize("text,minutes", [("", 1), ("   ", 1), ("w " * 399, 1), ("w " * 400, 2), (" " + "w " * 399, 2)])
def test_reading_minutes(spark, text, minutes):
    assert value(spark, strings.reading_minutes, text) == minutes


def test_tags_domain_snippet(spark):
    assert value(spark, strings.parse_tag_list, " a, ,b ,") == ["a", "b"]
    assert value(spark, strings.link_domain, "https://www.Example.org/x") == "example.org"
    assert value(spark, strings.link_domain, "not an address") == "external"
    snippet = value(spark, lambda c: strings.search_snippet(c, F.lit("t"), F.lit("u"), "c++"), "C++ <b> c++")
    assert snippet == "<mark>C++</mark> &lt;b&gt; <mark>c++</mark>"


def test_note_text(spark):
    header = "---\nx: 1\n---"
    text = value(spark, lambda h, t, b: notes.note_markdown(h, t, b, notes.related_section(F.array(F.lit("other-note")))),
                 header, "T", "| a |\n| b |\nend")
    # later body lines lose a leading '|'; the first keeps its own
    assert text == "---\nx: 1\n---\n\n# T\n\n| a |\n b |\nend\n\n\n## Related\n[[other-note]]\n"


def test_clean_markdown(spark):
    assert value(spark, notes.clean_markdown, "\n\na\n\n\n\nb\n   \nc [ ]()\n") == "a\n\nb\n\nc"


PAGE = "<html><head>{head}</head><body>{body}</body></html>"


def test_page_titles_and_meta():
    page = parse_page(PAGE.format(head='<title> A  B </title><meta name="description" content="About tea">'
                                       '<meta property="og:image" content="https://i.org/c.jpg">', body="<h1>H</h1>"))
    assert (page["title_tag"], page["h1"], page["description"], page["og_image"]) == (
        "A B", "H", "About tea", "https://i.org/c.jpg")
    named = parse_page('<meta property="og:title" content="P"><meta name="og:title" content="N"><p>x')
    assert named["og_title"] == "N"


def test_page_main_and_strip():
    body = "<nav>Home</nav><div class='sidebar x'>S</div><div role=banner>B</div><main><p>Real</p><script>alert(1)</script></main><footer>F</footer>"
    page = parse_page(PAGE.format(head="", body=body))
    assert page["markdown"] == "Real" and page["main_place"] == "main" and page["removed"] == 5


@pytest.mark.parametrize("html,markdown", [
    ("<article><h1>Green tea</h1><p>Pour <strong>hot</strong> water.</p></article>",
     "Green tea\n=========\n\nPour **hot** water."),
    ("<table><tr><th>Leaf<th>Min<tr><td>Assam<td>4</table>", "| Leaf  | Min |\n|-------|-----|\n| Assam | 4   |"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>", "* a\n* b\n  1. c"),
    ("<div><p>left open<div>inside out</p></div>", "left open\n\ninside out"),
    ("<p><b>one<p>two</b> three", "**one**\n\n**two** three"),
    ("<pre><code class='language-py'>a = 1\n</code></pre>", "```py\na = 1\n```"),
    ("<blockquote>q<p>r</blockquote><hr>", "> q\n>\n> r\n\n*** ** * ** ***"),
    ("<p><a href='https://e.org'>x</a> <em>y</em> <del>z</del> <code>k*</code><br>n", "[x](https://e.org) *y* ~~z~~ `k*`  \nn"),
    ("<h3>T</h3>5 * 3 &lt; 4", "### T\n\n5 \\* 3 \\< 4"), ("", "")])
def test_page_markdown(html, markdown):
    assert parse_page(html)["markdown"] == markdown


def test_images():
    shown = "".join(f"<img src='https://e.org/{i}.png'>" for i in range(60))
    page = parse_page("<img src='/rel.png'><img src='//e.org/p.png'><img src='data:x'>" + shown * 2)
    assert page["images"] == [f"https://e.org/{i}.png" for i in range(50)]
    assert parse_page("<base href='https://b.org/d/'><img src='x.png'>")["images"] == ["https://b.org/d/x.png"]


def test_blocks(spark):
    text = "# H\npara\ngoes on\n- one\ntail\n- two\n\n> q1\n> q2\n```\ncode\n\nmore\n```\n```\nopen"
    df = spark.createDataFrame([(1, text)], "k int, md string")
    rows = pg.markdown_blocks(df, "k", "md").orderBy("at", "rank").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [
        ("heading", 1, "H"), ("paragraph", None, "para goes on"), ("paragraph", None, "tail"), ("list", None, "one\ntwo"),
        ("quote", None, "q1 q2"), ("code", None, "code\n\nmore"), ("code", None, "open")]


def test_json_records(spark):
    texts = ['{"id":1,"name":"a"}', '{"id":"x"', '{"id":2}', "[1]"]
    good, bad = codecs.decode(spark.createDataFrame([(t,) for t in texts], "value string"), "tag")
    assert [(r.id, r.name) for r in good.collect()] == [(1, "a")]
    assert {r.value for r in bad.collect()} == set(texts[1:])
    job = '{"id":1,"linkId":2,"status":"DONE","createdAt":"2024-01-01T00:00:00Z"}'
    good, _ = codecs.decode(spark.createDataFrame([(job,)], "value string"), "export_job")
    row = good.first()
    assert row.status == "done" and row.createdAt is not None and row.vaultPath is None


def folded(text):
    """The blocks of a text by a plain fold over its lines."""
    import re

    out, full, inside = [], {}, False
    glue = {"paragraph": " ", "list": "\n", "quote": " ", "code": "\n"}

    def flush(at, *kinds):
        for kind in kinds:
            if kind in full:
                out.append((at, kind, None, glue[kind].join(full.pop(kind))))

    for n, line in enumerate(text.replace("\r", "").split("\n")):
        trimmed = line.strip()
        if trimmed.startswith("```"):
            flush(n, "paragraph", "list", "quote", "code")
            inside = not inside
        elif inside:
            full.setdefault("code", []).append(line)
        elif found := re.match(r"^(#{1,6})\s+(.*)$", line):
            flush(n, "paragraph", "list", "quote")
            out.append((n, "heading", len(found[1]), found[2]))
        elif found := re.match(r"^[-*+]\s+(.*)$", line):
            flush(n, "paragraph", "quote")
            full.setdefault("list", []).append(found[1])
        elif found := re.match(r"^>\s?(.*)$", line):
            flush(n, "paragraph", "list")
            full.setdefault("quote", []).append(found[1])
        elif not trimmed:
            flush(n, "paragraph", "list", "quote")
        else:
            full.setdefault("paragraph", []).append(trimmed)
    flush(2**31 - 1, "paragraph", "list", "quote", "code")
    return out


def test_blocks_equal_a_fold_and_long_notes_take_linear_time(spark):
    import random
    import time

    rnd = random.Random(7)
    lines = ["# head", "### more", "#no", "one", " two ", "- item", "* other", "-no", "> said", ">also", "", "  ", "```", "```py", "last"]
    texts = ["\n".join(rnd.choices(lines, k=rnd.randrange(1, 40))) for _ in range(300)]
    texts.append("\n".join(rnd.choices(lines, k=200_000)))
    start = time.time()
    rows = pg.markdown_blocks(spark.createDataFrame(list(enumerate(texts)), "k int, md string"), "k", "md").collect()
    assert time.time() - start < 60
    want = sorted((k, *map(str, block)) for k, text in enumerate(texts) if text for block in folded(text))
    assert sorted((r["k"], *map(str, (r["at"], r["kind"], r["level"], r["text"]))) for r in rows) == want


@pytest.mark.parametrize("raw,title", [
    ("Salt &amp; pepper &amp", "Salt & pepper &amp"), ("&am", "&am"), ("&#65;&#x42; &#67", "AB &#67"), ("a && b", "a && b")])
def test_character_references_need_their_semicolon(raw, title):
    page = parse_page(f"<title>{raw}</title><meta property='og:image' content='https://i.example/?a=1&copy=2'><article><p>{raw}</p></article>")
    assert page["title_tag"] == title
    assert page["markdown"].replace("\\", "") == title
    assert page["og_image"] == "https://i.example/?a=1&copy=2"


@pytest.mark.parametrize("text,browser,spaces", [
    (" one, \ntwo ,\t,three ", ["one", "two", "three"], ["one", "\ntwo", "\t", "three"]), (" , ", [], [])])
def test_tag_lists_are_trimmed_as_asked(spark, text, browser, spaces):
    assert value(spark, strings.parse_tag_list, text) == browser
    assert value(spark, lambda c: strings.parse_tag_list(c, F.trim), text) == spaces


def test_the_tag_query_keeps_line_breaks_like_its_sql(spark, tmp_path):
    from compare import rows_of
    import duckdb

    from linkloom.plans import catalog
    from linkloom.sources.views import Tables

    rows = [(1, "one \nAll rights\t two", "en", "web", 22), (2, "", "en", "web", 0), (3, None, "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = catalog()["parse_tags"].run(Tables(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog()["parse_tags"].sql)
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_a_parsed_page_leaves_no_cycles_behind():
    import gc

    html = "<article>" + "<div><p>text <b>bold</b></p></div>" * 200 + "</article>"
    parse_page(html)
    gc.collect()
    gc.disable()
    try:
        parse_page(html)
        assert gc.collect() < 100  # a tree with ways up left all its nodes to the collector
    finally:
        gc.enable()
