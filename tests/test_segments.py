"""The index that follows changes against one built from the final documents; versions and their conflicts."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkloom.operators import search
from linkloom.operators.segments import SearchIndex
from linkloom.sources.versions import Conflict, VersionedTable, Versions

KIND = "id bigint, user_id bigint, title string, content string, tags array<string>, url string"
WORDS = ["of", "the", "thand", "cat", "catalog", "dog", "do", "a", "le", "que", "là", "x1"]


def make(spark, rnd, ids):
    def text(n):
        return " ".join(rnd.choices(WORDS, range(1, len(WORDS) + 1), k=n))

    rows = [(i, 0 if i % 3 else i % 5, text(rnd.randrange(6)), text(rnd.randrange(40)), rnd.sample(["en", "cat"], rnd.randrange(3)), f"u{i}")
            for i in ids]
    return spark.createDataFrame(rows, KIND)


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """An index after updates, deletes and merges, the final documents, and its files after every batch."""
    rnd, folder = random.Random(5), str(tmp_path_factory.mktemp("ix"))
    index = SearchIndex(spark, folder, buckets=3, block=4, fanout=3, tier_docs=30, task_docs=50)
    want, seen = {}, [set()]
    for number, (ids, gone) in enumerate([(range(0, 60), []), (range(40, 90), [1, 2, 3, 41]), (range(85, 110), [5, 86, 500]), ([], [7, 100])]):
        docs = make(spark, rnd, ids).cache()
        index.apply(docs, spark.createDataFrame([(g,) for g in gone], "id bigint") if gone else None, epoch=number, merge=number == 2)
        want = {k: v for k, v in want.items() if k not in gone} | {r["id"]: r for r in docs.collect()}
        seen.append(files(folder))
    final = spark.createDataFrame([tuple(r) for r in want.values()], KIND).cache()
    return index, final, seen


def test_documents(changed):
    index, final, _ = changed
    key = lambda frame: sorted((r["id"], r["user_id"], r["title"], r["content"], r["url"]) for r in frame.collect())
    assert key(index.documents()) == key(final)


@pytest.mark.parametrize("limit", [1, 3])
def test_ranked_search(spark, changed, limit):
    index, final, _ = changed
    queries = spark.createDataFrame([(1, "cat dog the"), (2, "THE of of"), (3, "en"), (4, "nothing"), (5, "x1 là")], "query_id int, text string")
    assert rows_of(index.search(queries, limit)) == rows_of(search.search_fulltext(final, queries, limit))
    read, all_of_them = index.blocks_read(queries, limit)
    assert 0 < read <= all_of_them and (limit > 1 or read < all_of_them)
    mine = queries.withColumn("user_id", F.lit(0).cast("bigint"))
    assert rows_of(index.search(mine, limit)) == rows_of(search.search_fulltext(final, mine, limit))


@pytest.mark.parametrize("prefix", ["of th", "the the t", "zzz", "là"])
def test_suggest(changed, prefix):
    index, final, _ = changed
    columns = ["user_id", "id", "title", "pos"]
    assert rows_of(index.suggest(prefix).select(columns)) == rows_of(search.search_suggest(final, prefix).select(columns))


def test_batches_write_their_share(changed):
    """Files are never rewritten; only the merge of the third batch makes a second new segment."""
    index, _, seen = changed
    kinds = lambda names: {n.split("/")[1] for n in names if n.startswith("postings/")}
    for number, (before, after) in enumerate(zip(seen, seen[1:])):
        assert before <= after
        assert len(kinds(after) - kinds(before)) == [1, 1, 2, 0][number]
    base, state = index.state()
    assert len(state["segments"]) == 1 and len(state["dead"]) == 1


def test_repeated_batch_and_vacuum(spark, changed):
    index, final, _ = changed
    before = index.state()
    index.apply(make(spark, random.Random(1), range(5)), epoch=3)
    assert index.state() == before
    index.vacuum(1)
    queries = spark.createDataFrame([(1, "cat the")], "query_id int, text string")
    assert rows_of(index.search(queries)) == rows_of(search.search_fulltext(final, queries))
    assert len({n.split("/")[1] for n in files(index.folder) if n.startswith("postings/")}) == 1


def test_empty_index(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "ix"), buckets=2)
    queries = spark.createDataFrame([(1, "cat")], "query_id int, text string")
    assert index.search(queries).count() == 0 and index.suggest("cat").count() == 0
    index.apply(make(spark, random.Random(1), []))
    assert index.search(queries).count() == 0


def test_second_writer_is_refused(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.version() == 0
    with pytest.raises(ValueError):
        table.read()
    one, two = spark.range(3), spark.range(5)
    assert table.replace(one, 0) == 1
    old = table.read()
    with pytest.raises(Conflict):
        table.replace(two, 0)
    assert table.read().count() == 3
    assert table.append(two, 1) == 2
    assert (table.read().count(), table.read(1).count(), old.count()) == (8, 3, 3)
    with pytest.raises(ValueError):
        table.append(spark.range(1).selectExpr("id AS other"), 2)


def test_update_is_repeated_on_a_conflict(spark, tmp_path):
    table, other = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    table.replace(spark.range(1), 0)
    turns = []

    def change(rows):
        turns.append(1)
        if len(turns) == 1:
            other.append(spark.range(10, 11), 1)  # another writer comes first
        return rows.selectExpr("id + 1 AS id")

    assert table.update(change) == 3
    assert len(turns) == 2 and rows_of(table.read()) == [(1,), (11,)]
    table.vacuum(1)
    assert rows_of(table.read()) == [(1,), (11,)] and len(list((tmp_path / "t/data").iterdir())) == 1


def test_versions_are_claimed_once(spark, tmp_path):
    """A rename to a version that exists is refused, also when it came after the look at the latest one."""
    one, two = Versions(spark, str(tmp_path / "v")), Versions(spark, str(tmp_path / "v"))
    two.latest = lambda: 0
    assert one.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        two.commit(0, {"b": 1})
    assert one.content(1) == {"a": 1} and [p.name for p in (tmp_path / "v/_versions").glob("*.tmp")] == []
    assert json.loads((tmp_path / "v/_versions/v1.json").read_text()) == {"a": 1}
