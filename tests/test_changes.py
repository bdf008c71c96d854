"""Write rules on hand-made tables, where the benchmark tables hold no such case."""

from pyspark.sql import functions as F

from linkloom.operators import changes, relational, search, vault


def test_tag_names_compare_without_case_accents_and_trailing_spaces(spark):
    tags = spark.createDataFrame([(1, "Scala"), (2, "c++")], "id bigint, name string")
    names = spark.createDataFrame([("scalá ",), ("SCALA",), ("Über",), ("uber",), ("c",)], "name string")
    out = changes.tag_upsert(tags, names).collect()
    assert len(out) == 4 and {r.id for r in out} == {1, 2, 3, 4}
    wanted = spark.createDataFrame([(9, "sCALA"), (9, "scála"), (8, "ÜBER ")], "link_id bigint, name string")
    ids = {(r.link_id, r.tag_id) for r in changes.tag_ids(changes.tag_upsert(tags, names), wanted).collect()}
    assert (9, 1) in ids and len(ids) == 2


def test_numbers_are_dense_and_new(spark):
    base = spark.createDataFrame([(41,)], "id bigint")
    rows = spark.range(5000).select(F.col("id").alias("k"))
    ids = [r.id for r in changes.number_rows(rows, F.col("k"), base).select("id").collect()]
    assert sorted(ids) == list(range(42, 42 + 5000))


def test_empty_tag_list_clears(spark):
    links = spark.createDataFrame([(1, 7), (2, 7)], "id bigint, user_id bigint")
    edges = spark.createDataFrame([(1, 1), (2, 1)], "link_id bigint, tag_id bigint")
    updates = spark.createDataFrame([(1, 7), (2, 99)], "link_id bigint, user_id bigint")
    none = spark.createDataFrame([], "link_id bigint, tag_id bigint")
    assert [tuple(r) for r in changes.link_tags_replace(edges, links, updates, none).collect()] == [(2, 1)]


def test_tree_keeps_the_total(spark):
    rows = [(1, 1, "Work/A", 3), (2, 1, "Work", 2), (3, 1, " Work / A /B", 5), (4, 1, "//", 9)]
    tree = {r.path: (r.own_count, r.tree_count, r.depth) for r in relational.collection_tree(
        spark.createDataFrame(rows, "id bigint, user_id bigint, name string, link_count bigint")).collect()}
    assert tree == {"Work": (2, 10, 0), "Work/A": (3, 8, 1), "Work/A/B": (5, 5, 2)}


def test_tags_that_share_a_file(spark):
    tags = spark.createDataFrame([(1, "c++"), (2, "C"), (3, "d")], "id bigint, name string")
    assert [(r.slug, r.tags) for r in vault.shared_tag_files(tags).collect()] == [("c", 2)]


def test_unreadable_manifest_is_empty(spark):
    texts = spark.createDataFrame([("{broken",), ('{"notes":{"1":{"linkId":1,"path":"p","slug":"s","collection":"c","updatedAt":"u"}}}',)], "value string")
    assert [r.link_id for r in vault.read_manifest(texts).collect()] == [1]


def test_files_of_a_vault(spark, tmp_path):
    notes = spark.createDataFrame([(1, "collections/a/x.md", "one"), (2, "collections/a/x.md", "two"), (3, "collections/b/y.md", "three")],
                                  "link_id bigint, path string, content string")
    vault.write_notes(vault.note_files(notes), str(tmp_path))
    assert (tmp_path / "collections/a/x.md").read_text() == "two"
    vault.remove_files(notes.where("link_id = 3"), str(tmp_path))
    assert not (tmp_path / "collections/b/y.md").exists() and len(list(tmp_path.rglob("*.md"))) == 1


def test_pages_of_lines_keep_their_order(spark, tmp_path):
    titles = spark.createDataFrame([("t", i, f"Title {i:04d}", "c") for i in range(300)], "tag string, link_id bigint, title string, collection string")
    vault.write_lines(vault.tag_pages(titles, F.lit("2024-01-01 00:00:00").cast("timestamp")), str(tmp_path / "out"))
    folder = next((tmp_path / "out").glob("page=*"))
    lines = "".join(f.read_text() for f in sorted(folder.glob("part-*"))).splitlines()
    assert lines[:3] == ["---", 'title: "Tag: #t"', "tag: t"] and lines[11].startswith("- [[title-0000|Title 0000]]")
    assert lines[11:] == sorted(lines[11:]) and len(lines) == 311


def test_stored_index_gives_the_same_answer(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, i % 3, f"the title {i}", "the quick brown fox " * (i % 4) + "jumps", ["x"], "c", i) for i in range(40)],
        "id bigint, user_id bigint, title string, content string, tags array<string>, collection string, saved_at bigint")
    queries = spark.createDataFrame([(1, "quick title"), (2, "x"), (3, "nothing here")], "query_id int, text string")
    search.write_index(docs, str(tmp_path / "ix"), buckets=4)
    stored = search.search_index(spark.read.parquet(str(tmp_path / "ix/postings")), spark.read.parquet(str(tmp_path / "ix/field_stats")), queries, buckets=4)
    assert "PartitionFilters: [isnotnull(bucket" in stored._jdf.queryExecution().toString() or "bucket#" in str(
        stored._jdf.queryExecution().executedPlan().toString()).split("PartitionFilters: [")[1].split("]")[0]
    direct = search.search_fulltext(docs, queries)
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in direct.collect()} != set()


def test_only_written_documents_are_marked(spark):
    links = spark.createDataFrame([(1, None), (2, None)], "id bigint, indexed_at timestamp")
    out = search.mark_indexed(links, spark.createDataFrame([(2,)], "id bigint"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert {r.id: r.indexed_at is not None for r in out.collect()} == {1: False, 2: True}


def test_tasks_put_page_files_in_place_under_spark_s_names(spark, tmp_path):
    pages = ["by-tag/a b.md", "by-tag/100%.md", "ä=ö?#.md", "x:y'[z].md"]
    rows = [(p, 0, "", 0, f"{n:03d}", n, f"{p} line {n}") for p in pages for n in range(20)]
    lines = spark.createDataFrame(rows, "page string, part int, key1 string, sub int, key2 string, link_id bigint, line string")
    folder = str(tmp_path / "out")
    vault.write_lines(lines, folder)
    got = spark.read.option("basePath", folder).text(folder).select("page", "value").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[6]) for r in rows)
    names = [f.name for f in (tmp_path / "out").rglob("*") if f.is_file()]
    assert names and all(n.endswith(".txt") and n.count("-") == 1 for n in names)  # no job's or attempt's number: a repeated task writes the same
