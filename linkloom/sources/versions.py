"""Tables with numbered versions: readers see one version, writers build on the one they read.

A version is a small JSON file ``v<number>.json`` that names what belongs to it. It is written aside and renamed to its
number, which the file system refuses when that number exists; so of two writers that started from the same version one is
refused (``Conflict``) and nothing of it is seen. Data files are never changed; ``vacuum`` removes those that no kept version
names. All access is by Hadoop's file systems, so folders may be anywhere Spark reads. The rename must be atomic there
(it is on HDFS and local disks).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed a version since the one this write is based on."""


class Files:
    """The few file operations that versions need, on the file system of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(conf)
        self.root = self.fs.makeQualified(self.path(folder))
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Give a file a name that nothing has yet; False if something has it."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            self.context.rename(self.path(old), self.path(new), self.gateway.new_array(kind, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Versions:
    """The versions of something kept below ``folder``: version 0 is empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.files = folder.rstrip("/"), Files(spark, folder)

    def numbers(self) -> list[int]:
        found = (re.fullmatch(r"v(\d+)\.json", name) for name in self.files.names(f"{self.folder}/_versions"))
        return sorted(int(m.group(1)) for m in found if m)

    def latest(self) -> int:
        return max(self.numbers(), default=0)

    def content(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/_versions/v{version}.json")) if version else {}

    def commit(self, base: int, content: dict) -> int:
        """Make ``content`` the version after ``base``."""
        if self.latest() != base:
            raise Conflict(f"version {base} is no longer the latest of {self.folder}")
        aside = f"{self.folder}/_versions/{uuid4().hex}.tmp"
        self.files.write(aside, json.dumps(content))
        if not self.files.rename(aside, f"{self.folder}/_versions/v{base + 1}.json"):
            self.files.remove(aside)
            raise Conflict(f"version {base + 1} of {self.folder} was written meanwhile")
        return base + 1

    def forget(self, keep: int) -> list[dict]:
        """Drop all but the last ``keep`` versions; the contents of those kept."""
        numbers = self.numbers()
        for number in numbers[:-keep]:
            self.files.remove(f"{self.folder}/_versions/v{number}.json")
        return [self.content(number) for number in numbers[-keep:]]


class VersionedTable:
    """A table that is replaced as a whole or appended to, one version at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, folder)

    def version(self) -> int:
        return self.versions.latest()

    def read(self, version: int | None = None) -> DataFrame:
        number = self.version() if version is None else version
        content = self.versions.content(number)
        if not content:
            raise ValueError(f"{self.folder} has no version yet")
        schema = StructType.fromJson(content["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{part}" for part in content["parts"]])

    def _stored(self, rows: DataFrame) -> str:
        part = uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{part}")
        return part

    def replace(self, rows: DataFrame, base: int) -> int:
        """The rows as the version after ``base``; Conflict if that is not the latest any more."""
        part = self._stored(rows)
        try:
            return self.versions.commit(base, {"parts": [part], "schema": rows.schema.jsonValue()})
        except Conflict:
            self.versions.files.remove(f"{self.folder}/data/{part}")
            raise

    def append(self, rows: DataFrame, base: int) -> int:
        content = self.versions.content(base)
        if content and StructType.fromJson(content["schema"]).simpleString() != rows.schema.simpleString():
            raise ValueError("appended rows have other columns")
        part = self._stored(rows)
        try:
            return self.versions.commit(
                base, {"parts": [*content.get("parts", []), part], "schema": content.get("schema", rows.schema.jsonValue())})
        except Conflict:
            self.versions.files.remove(f"{self.folder}/data/{part}")
            raise

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 3) -> int:
        """Replace the table by ``change`` of its latest version, anew if another writer comes first."""
        for left in reversed(range(attempts)):
            base = self.version()
            try:
                return self.replace(change(self.read(base)), base)
            except Conflict:
                if not left:
                    raise

    def vacuum(self, keep: int = 2) -> None:
        """Remove data that none of the last ``keep`` versions names; no reader or writer of older ones may be at work."""
        used = {part for content in self.versions.forget(keep) for part in content["parts"]}
        for part in set(self.versions.files.names(f"{self.folder}/data")) - used:
            self.versions.files.remove(f"{self.folder}/data/{part}")


class VersionedFolder:
    """A folder of which each version is written aside as a whole and then becomes the current one at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.versions = folder.rstrip("/"), Versions(spark, folder)

    def publish(self, write: Callable[[str], None], base: int | None = None) -> int:
        """``write`` fills the folder it is given; if it fails, or ``base`` is no longer the latest version, nothing changes."""
        base = self.versions.latest() if base is None else base
        part = uuid4().hex
        try:
            write(f"{self.folder}/data/{part}")
            return self.versions.commit(base, {"part": part})
        except BaseException:
            self.versions.files.remove(f"{self.folder}/data/{part}")
            raise

    def current(self, version: int | None = None) -> str:
        """The folder of a version, the latest by default."""
        number = self.versions.latest() if version is None else version
        if not number:
            raise ValueError(f"{self.folder} has no version yet")
        return f"{self.folder}/data/{self.versions.content(number)['part']}"

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions; no reader of older ones may be at work."""
        used = {content["part"] for content in self.versions.forget(keep)}
        for part in set(self.versions.files.names(f"{self.folder}/data")) - used:
            self.versions.files.remove(f"{self.folder}/data/{part}")
