"""What large tables need: no exploded table is broadcast, no file is listed by the driver, and no row that is not asked for is paired."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import changes, related, relational, vault
from linkloom.plans import vault as plans
from linkloom.sources.versions import Files

LINES = "page string, part int, key1 string, sub int, key2 string, link_id bigint, line string"


def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exploded(spark):
    """Three collections of each of two users: Spark takes the rows for two."""
    return spark.range(1, 3).select(F.col("id").alias("user_id"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("name")).select(
        (F.col("user_id") * 10 + F.ascii("name") - 97).alias("id"), "name", F.col("name").alias("slug"), "user_id")


def requests(spark):
    return spark.createDataFrame(
        [(1, None, 1, " New "), (2, None, 1, "new"), (3, 11, 1, "B"), (4, 20, 1, "x"), (5, None, 2, "A"), (6, None, None, "A"), (7, 12, 1, "Two"),
         (8, 12, 1, "Three"), (9, None, 2, "Last")], "seq long, collection_id long, user_id long, name string")


def test_collections_are_not_broadcast_to_judge_requests(spark):
    got = changes.collection_write(exploded(spark), requests(spark))
    assert "Broadcast" not in physical(got)
    assert {r.seq: r.verdict for r in got.collect()} == {
        1: "ok", 2: "Collection with this name already exists", 3: "ok", 4: "Collection not found",
        5: "Collection with this name already exists", 6: "ok", 7: "ok", 8: "ok", 9: "ok"}


def test_requests_are_judged_once_to_be_applied(spark):
    verdicts = changes.collection_write(exploded(spark), requests(spark))
    got = changes.collection_apply(exploded(spark), verdicts)
    assert "regexp" not in got._jdf.queryExecution().analyzed().toString()
    rows = {r.id: (r.name, r.slug, r.user_id) for r in got.collect()}
    assert {i: rows[i] for i in (10, 11, 12, 20, 21, 22)} == {
        10: ("a", "a", 1), 11: ("B", "b", 1), 12: ("Three", "three", 1), 20: ("a", "a", 2), 21: ("b", "b", 2), 22: ("c", "c", 2)}
    assert sorted((i, rows[i][1]) for i in rows if i > 22)[0][0] == 23 and {rows[i][1] for i in (23, 24, 25)} == {"new", "a", "last"} and len(rows) == 9


def test_collections_are_not_broadcast_to_titles(spark):
    links = spark.createDataFrame([(1, "One", "parsed", 10), (2, "Two", "parsed", 99), (3, None, "parsed", 10), (4, "Four", "failed", 10)],
                                  "id long, title string, status string, collection_id long")
    got = relational.tagged_titles(spark.createDataFrame([(7, "t")], "id long, name string"), spark.createDataFrame(
        [(i, 7) for i in (1, 2, 3, 4)], "link_id long, tag_id long"), links, exploded(spark))
    assert "Broadcast" not in physical(got)
    assert sorted(map(tuple, got.collect())) == [("t", 1, "One", "a"), ("t", 2, "Two", "unsorted")]


def test_page_files_are_listed_by_the_tasks_that_write_them(spark, tmp_path):
    rows = [(p, 0, "", 0, f"{n:03d}", n, text) for p in ("by-tag/a b.md", "ä=ö?#\n.md", None) for n, text in enumerate(
        ["first", "", None, "two\rin one", "three\r\nin\n one\r", "ends"])]
    folder = str(tmp_path / "out")
    vault.write_lines(spark.createDataFrame(rows, LINES).repartition(5), folder)

    class Given:
        pass
    Given.spark = spark
    got = plans.read_lines(Given, folder)
    assert not [f for f in got.inputFiles() if "page=" in f]
    want = ["first", "", "", "two", "in one", "three", "in", " one", "ends"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        str((p, n, line)) for p in ("by-tag/a b.md", "ä=ö?#\n.md", None) for n, line in enumerate(want, 1))
    # Spark's reader, which needs no lists, finds the same
    assert Files(spark, folder).exists(f"{folder}/{vault.FILE_LISTS}")
    Files(spark, folder).remove(f"{folder}/_lists")
    again = plans.read_lines(Given, folder)
    assert [f for f in again.inputFiles() if "page=" in f]
    assert sorted(map(str, map(tuple, again.collect()))) == sorted(map(str, map(tuple, got_rows(spark, rows, tmp_path))))


def got_rows(spark, rows, tmp_path):
    folder = str(tmp_path / "again")
    vault.write_lines(spark.createDataFrame(rows, LINES), folder)
    return vault.read_lines(spark, folder).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_lines_that_go_on_in_the_next_block(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(vault, "READ_BYTES", size)
    for text, want in (("a\r\nb\rc\n\nd", ["a", "b", "c", "", "d"]), ("\r\r\n\n", ["", "", ""]), ("ä\r", ["ä"]), ("", []), ("x\n\r", ["x", ""])):
        assert list(vault._lines_of(pa.BufferReader(text.encode()))) == want


@pytest.fixture
def vault_tables(spark):
    links = spark.createDataFrame(
        [(1, "One", "parsed"), (2, "Two", "parsed"), (3, "Three", "pending"), (4, None, "parsed"), (5, "Five", "failed")],
        "id long, title string, status string").selectExpr(
        "*", "'u' AS url", "1 AS reading_time_min", "null AS collection_id", "null AS export_directory", "null AS export_file_name")
    links = links.withColumns({c: F.col(c).cast("string") for c in ("export_directory", "export_file_name")}).withColumn(
        "collection_id", F.col("collection_id").cast("long"))
    # link 2 has its tag twice, tags of no number and of no link are there
    edges = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 7), (4, 7), (5, 8), (1, 8), (None, 7), (1, None), (9, 7)], "link_id long, tag_id long")
    return links, edges, spark.createDataFrame([(7, "b"), (8, "a")], "id long, name string"), spark.createDataFrame([], "id long, slug string")


def watch(monkeypatch):
    seen, shared, names = {}, related.top_shared, relational.link_tag_names

    def paired(items, *a, **b):
        seen["paired"] = sorted(map(tuple, items.collect()))
        return shared(items, *a, **b)

    def named(link_tags, tags):
        seen["named"] = sorted(map(tuple, link_tags.collect()))
        return names(link_tags, tags)

    monkeypatch.setattr(related, "top_shared", paired)
    monkeypatch.setattr(relational, "link_tag_names", named)
    return seen


def test_only_tags_of_exported_links_are_named_and_paired(vault_tables, monkeypatch):
    links, edges, tags, collections = vault_tables
    seen = watch(monkeypatch)
    got = {r.link_id: r.content for r in vault.export_notes(links, edges, tags, collections, at()).collect()}
    assert seen == {k: [(1, 7), (1, 8), (2, 7), (4, 7)] for k in ("paired", "named")}
    assert sorted(got) == [1, 2, 4]
    related_of = {i: text.split("## Related\n")[1].split() if "## Related" in text else [] for i, text in got.items()}
    assert related_of == {1: ["[[two]]"], 2: ["[[one]]"], 4: ["[[one]]", "[[two]]"]}


def test_only_tags_of_parsed_and_titled_links_make_backlinks(vault_tables, monkeypatch):
    links, edges, *_ = vault_tables
    seen = watch(monkeypatch)
    assert sorted(map(tuple, related.backlink_edges(links, edges).collect())) == [("one", "two"), ("two", "one")]
    assert seen["paired"] == [(1, 7), (1, 8), (2, 7)]


def test_the_index_is_sorted_once(spark):
    manifest = spark.createDataFrame([(1, "one", "c")], "link_id long, slug string, collection string")
    edges = spark.createDataFrame([("one", "two"), ("one", "three")], "target string, source string")
    lines = vault.index_document(manifest, edges, at())
    assert lines._jdf.queryExecution().analyzed().toString().count("Sort [") == 1
    assert [r.line for r in lines.collect()][-8:] == [
        "- [[two]] → [[one]]", "", "```mermaid", "graph LR", "    three --> one", "    two --> one", "```", ""]
    assert [r.line for r in related.graph_lines(edges).collect()] == ["- [[three]] → [[one]]", "- [[two]] → [[one]]"]
