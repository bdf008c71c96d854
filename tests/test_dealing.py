"""Work is dealt by its size: no key, page or table half lands in one task or is read twice."""

import pyarrow as pa
from pyspark.sql import functions as F

from linkloom.operators import changes, relational, search, segments
from linkloom.plans import catalog, vault
from linkloom.sources.views import Tables

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().analyzed().toString()


def test_blocks_of_groups_that_go_on_in_the_next_batch():
    rows = [(0, 0, 0, "title", term, user, i, 1, 3, [i], 0.9 - i / 100) for term, user, n in (("a", 1, 7), ("a", None, 2), ("b", 1, 1))
            for i in range(n)]
    names = ["bucket", "level", "salt", "field", "term", "user_id", "id", "tf", "dl", "positions", "share"]
    whole = pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(names)})
    for cut in range(1, len(rows)):
        out = [r for b in segments._blocked(3)(iter([whole.slice(0, cut), whole.slice(cut, 0), whole.slice(cut)])) for r in b.to_pylist()]
        assert [(r["term"], r["user_id"], r["block"], r["n"], [e["id"] for e in r["entries"]]) for r in out] == [
            ("a", 1, 0, 3, [0, 1, 2]), ("a", 1, 1, 3, [3, 4, 5]), ("a", 1, 2, 1, [6]), ("a", None, 0, 2, [0, 1]), ("b", 1, 0, 1, [0])]
        assert [round(r["top"], 2) for r in out] == [0.9, 0.87, 0.84, 0.9, 0.9]


def test_postings_go_to_more_tasks_as_tokens_grow(spark, tmp_path, monkeypatch):
    docs = spark.range(300).select("id", (F.col("id") % 3).alias("user_id"), F.concat(F.lit("title w"), "id").alias("title"),
                                   F.concat_ws(" ", F.lit("common words and"), F.concat(F.lit("w"), "id")).alias("content"),
                                   F.array(F.lit("t")).alias("tags"))
    index, files, found = None, [], []
    for size in (1_000_000, 100):
        monkeypatch.setattr(segments, "TASK_TOKENS", size, raising=False)
        index = segments.SearchIndex(spark, str(tmp_path / str(size)), buckets=1, levels=1)
        index.apply(docs)
        found.append(sorted(map(tuple, index.search(spark.createDataFrame([(1, "common w7")], "query_id int, text string"), 5).collect())))
        files.append(len(list((tmp_path / str(size) / "postings").rglob("*.parquet"))))
    assert files[0] == 1 and files[1] >= 8
    assert found[0] == found[1] and found[0]


def test_lines_are_numbered_file_by_file(spark, tmp_path):
    for page, sizes in (("a", (3, 2, 4)), ("b", (2,))):
        (tmp_path / f"page={page}").mkdir()
        for part, n in enumerate(sizes):
            (tmp_path / f"page={page}" / f"part-{part:05d}.txt").write_text("".join(f"{part}.{i}\n" for i in range(n)))
    class Given:
        pass
    Given.spark = spark
    got = vault.read_lines(Given, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [
        *[("a", i + 1, line) for i, line in enumerate(["0.0", "0.1", "0.2", "1.0", "1.1", "2.0", "2.1", "2.2", "2.3"])],
        ("b", 1, "0.0"), ("b", 2, "0.1")]
    assert "row_number() windowspecdefinition(page" not in plan_of(got)


def test_inserts_do_not_look_for_the_owner_of_the_null_collection(spark):
    collections = spark.createDataFrame([(1, "Work", "work", 7), (2, "Play", "play", 8)], "id long, name string, slug string, user_id long")
    requests = spark.createDataFrame([(1, None, 7, "New"), (2, 1, 7, "Mine"), (3, 2, 7, "Theirs"), (4, None, None, "New")],
                                     "seq long, collection_id long, user_id long, name string")
    got = changes.collection_write(collections, requests)
    assert {r["seq"]: r["verdict"] for r in got.collect()}[3] == "Collection not found"
    assert {r["seq"]: r["verdict"] for r in got.collect()}[1] == "ok"
    assert "NOT isnull(collection_id" in plan_of(got)


def test_json_records_are_judged_once(spark):
    plan = plan_of(catalog()["src_json_entities"].run(Tables(spark, SF)))
    assert plan.count("Relation [") == 6  # one for each entity, was two


def test_only_tags_of_links_to_index_are_gathered(spark, monkeypatch):
    gathered, names = [], relational.link_tag_names

    def seen(link_tags, tags):
        gathered.append({(r.link_id, r.tag_id) for r in link_tags.collect()})
        return names(link_tags, tags)

    monkeypatch.setattr(relational, "link_tag_names", seen)
    links = spark.createDataFrame(
        [(1, "parsed", None), (2, "pending", None), (3, "parsed", "2024-01-01"), (4, "parsed", None), (None, "parsed", None)],
        "id long, status string, indexed_at string").selectExpr(
        "*", "'u' AS url", "'t' AS title", "1 AS reading_time_min", "null AS saved_at", "1L AS user_id", "null AS collection_id")
    collections = spark.createDataFrame([], "id long, slug string")
    link_tags = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 8), (5, 7), (None, 7)], "link_id long, tag_id long")
    tags = spark.createDataFrame([(7, "b"), (8, "a")], "id long, name string")
    got = search.resync_docs(links, collections, link_tags, tags).collect()
    assert {r.id: r.tags for r in got} == {1: ["a", "b"], 4: [], None: []} and len(got) == 3
    assert gathered == [{(1, 7), (1, 8)}]
