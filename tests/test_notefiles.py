"""Note files: all of a write or none of it, whatever fails and when."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkloom.operators import notefiles
from linkloom.operators.notefiles import NoteStore
from linkloom.sources.versions import Conflict, VersionedFolder


def seen(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*.md")}


def notes(spark, **files):
    return spark.createDataFrame([(f"{k.replace('_', '/')}.md", v) for k, v in files.items()], "path string, content string")


def test_write_and_remove(spark, tmp_path):
    store = NoteStore(spark, str(tmp_path))
    store.write(notes(spark, a_one="1", a_two="é\n", b="3"))
    store.write(notes(spark, a_one="new"), spark.createDataFrame([("b.md",), ("a/one.md",), ("none.md",)], "path string"))
    assert seen(tmp_path) == {"a/one.md": "new", "a/two.md": "é\n"}
    assert list((tmp_path / "_notes/staging").iterdir()) == []


def test_failed_task_leaves_the_old_notes(spark, tmp_path):
    store = NoteStore(spark, str(tmp_path))
    store.write(notes(spark, a="old", b="old"))
    before = store.versions.latest()
    bad = spark.range(0, 40, 1, 4).select(
        F.concat(F.lit("n"), "id", F.lit(".md")).alias("path"),
        F.when(F.col("id") == 39, F.raise_error(F.lit("a task fails")).cast("string")).otherwise("new").alias("content"))
    with pytest.raises(Exception, match="a task fails"):
        store.write(bad.unionByName(notes(spark, a="new")), spark.createDataFrame([("b.md",)], "path string"))
    assert seen(tmp_path) == {"a.md": "old", "b.md": "old"} and store.versions.latest() == before
    assert list((tmp_path / "_notes/staging").iterdir()) == []


def test_committed_write_is_carried_out_later(spark, tmp_path, monkeypatch):
    store, real = NoteStore(spark, str(tmp_path)), notefiles._publish
    store.write(notes(spark, a="old", c="old"))

    def half(root, staging):
        def publish(rows):
            rows = list(rows)
            real(root, staging)(rows[:1])
            raise RuntimeError("lost")
        return publish

    monkeypatch.setattr(notefiles, "_publish", half)
    with pytest.raises(Exception):
        store.write(notes(spark, a="new", b="new"), spark.createDataFrame([("c.md",)], "path string"))
    monkeypatch.setattr(notefiles, "_publish", real)
    NoteStore(spark, str(tmp_path)).recover()
    assert seen(tmp_path) == {"a.md": "new", "b.md": "new"}
    assert NoteStore(spark, str(tmp_path)).recover() == store.versions.latest()


def test_second_writer_is_refused(spark, tmp_path, monkeypatch):
    one, two = NoteStore(spark, str(tmp_path)), NoteStore(spark, str(tmp_path))
    one.write(notes(spark, a="first"))
    base = two.recover()
    one.write(notes(spark, a="second"))
    monkeypatch.setattr(two, "recover", lambda: base)
    with pytest.raises(Conflict):
        two.write(notes(spark, a="third"))
    assert seen(tmp_path) == {"a.md": "second"}


def test_folder_versions(spark, tmp_path):
    folder = VersionedFolder(spark, str(tmp_path / "f"))
    first = folder.publish(lambda place: spark.range(3).write.parquet(place))
    old = folder.current()

    def fails(place):
        spark.range(5).write.parquet(place)
        raise RuntimeError("after some files")

    with pytest.raises(RuntimeError):
        folder.publish(fails)
    assert spark.read.parquet(folder.current()).count() == 3
    folder.publish(lambda place: spark.range(7).write.parquet(place), first)
    with pytest.raises(Conflict):
        folder.publish(lambda place: spark.range(9).write.parquet(place), first)
    assert (spark.read.parquet(folder.current()).count(), spark.read.parquet(old).count()) == (7, 3)
    folder.vacuum(1)
    assert [p.name for p in (tmp_path / "f/data").iterdir()] == [folder.current().rsplit("/", 1)[1]]
