"""Note files with a commit: either all files of a write become visible or none.

Tasks write files to a staging folder beside the notes, under names made from their paths, so a repeated or doubled task
changes nothing. When all have ended, the list of files is stored and the write is committed as a version of the store; from
then on it will be carried out. Publishing moves the staged files to their places and then removes what is to go; both can be
repeated, and ``recover`` does so after a failure. A write that fails before its commit leaves the notes as they were; of two
writers that started from the same version one is refused.

Files are moved by the tasks through Arrow's file systems, so ``root`` may be a path or an address that they know.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from linkloom.sources.versions import Versions


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (fs.LocalFileSystem(), root)


def _stage(root: str, staging: str):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        folder = posixpath.join(base, staging)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            paths, names = batch.column("path").to_pylist(), []
            for path, content in zip(paths, batch.column("content").to_pylist()):
                name = hashlib.sha256(path.encode()).hexdigest()
                aside = posixpath.join(folder, f"{name}.{uuid4().hex}")
                with system.open_output_stream(aside) as out:
                    out.write((content or "").encode())
                system.move(aside, posixpath.join(folder, name))
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string())], ["path", "name"])
    return stage


def _publish(root: str, staging: str):
    def publish(rows) -> None:
        system, base = opened(root)
        for row in rows:
            staged = posixpath.join(base, staging, row["name"])
            if system.get_file_info(staged).type == fs.FileType.NotFound:
                continue  # moved by an earlier attempt
            target = posixpath.join(base, row["path"])  # an absolute path stays one
            system.create_dir(posixpath.dirname(target), recursive=True)
            system.move(staged, target)
    return publish


def _remove(root: str):
    def remove(rows) -> None:
        system, base = opened(root)
        for row in rows:
            target = posixpath.join(base, row["path"])
            if system.get_file_info(target).type != fs.FileType.NotFound:
                system.delete_file(target)
    return remove


class NoteStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/_notes")

    def write(self, files: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Write files (path, content; one row per path) and remove others (path), in one commit; its version.

        A path that is both written and removed is written. What an earlier write has left undone is done first.
        """
        base = self.recover()
        run = uuid4().hex
        staging = f"_notes/staging/{run}"
        lists = f"{self.root}/{staging}/_lists"
        try:
            if files is not None:
                files.select("path", "content").mapInArrow(_stage(self.root, staging), "path string, name string").write.parquet(f"{lists}/files")
            if removed is not None:
                gone = removed.select("path").distinct()
                if files is not None:
                    gone = gone.join(self.spark.read.parquet(f"{lists}/files").select("path"), "path", "left_anti")
                gone.write.parquet(f"{lists}/removed")
            version = self.versions.commit(base, {"run": run, "files": files is not None, "removed": removed is not None, "done": False})
        except BaseException:
            self.versions.files.remove(f"{self.root}/{staging}")
            raise
        return self._carry_out(version)

    def recover(self) -> int:
        """Carry out what was committed but not finished; the latest version."""
        version = self.versions.latest()
        return self._carry_out(version) if version and not self.versions.content(version)["done"] else version

    def _carry_out(self, version: int) -> int:
        content = self.versions.content(version)
        staging = f"_notes/staging/{content['run']}"
        lists = f"{self.root}/{staging}/_lists"
        if content["files"]:
            self.spark.read.parquet(f"{lists}/files").foreachPartition(_publish(self.root, staging))
        if content["removed"]:
            self.spark.read.parquet(f"{lists}/removed").foreachPartition(_remove(self.root))
        version = self.versions.commit(version, content | {"done": True})
        self.versions.files.remove(f"{self.root}/{staging}")
        return version
