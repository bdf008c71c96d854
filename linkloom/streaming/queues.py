"""A queue with acknowledgement on shared files.

Entries are appended in runs: a run is a folder of text files that becomes part of the queue by one rename, so a reader sees
whole runs only. As a stream source (format ``linkloom_queue``) the queue is read from one run number to another; the numbers
are the offsets that Spark keeps in its checkpoint, so a batch that was interrupted is read again as it was. When a batch is
done, Spark commits its end, and the queue notes it as acknowledged; ``trim`` removes runs up to there.

The files are listed and read in Python workers through Arrow's file systems.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from linkloom.operators.notefiles import opened
from linkloom.sources.versions import Conflict, Versions


def enqueue(entries: DataFrame, folder: str, column: str = "value") -> int:
    """Append entries (texts without line breaks) as one run; its number."""
    versions, part = Versions(entries.sparkSession, folder), uuid4().hex
    entries.selectExpr(f"CAST(`{column}` AS STRING) AS value").where("value IS NOT NULL").write.text(f"{folder}/data/{part}")
    while True:
        try:
            return versions.commit(versions.latest(), {"part": part})
        except Conflict:  # another run was appended; this one comes after it
            continue


def acknowledged(folder: str) -> int:
    """The last run that a reader has finished."""
    system, base = opened(folder)
    return max(_numbers(system, posixpath.join(base, "_done"), r"(\d+)"), default=0)


def trim(spark: SparkSession, folder: str) -> None:
    """Remove the entries of acknowledged runs; their numbers stay taken."""
    versions = Versions(spark, folder)
    done = acknowledged(folder)
    for number in versions.numbers():
        if number <= done:
            versions.files.remove(f"{folder}/data/{versions.content(number)['part']}")


def _numbers(system: fs.FileSystem, folder: str, pattern: str) -> list[int]:
    infos = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [int(m.group(1)) for m in (re.fullmatch(pattern, i.base_name) for i in infos) if m]


def _texts(lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])


class RunFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class QueueReader(DataSourceStreamReader):
    def __init__(self, folder: str, runs: int):
        self.folder, self.runs = folder, runs
        self.start = 0  # the run up to which batches have been planned

    def initialOffset(self) -> dict:
        return {"run": 0}

    def latestOffset(self) -> dict:
        system, base = opened(self.folder)
        latest = max(_numbers(system, posixpath.join(base, "_versions"), r"v(\d+)\.json"), default=0)
        return {"run": min(latest, self.start + self.runs) if self.runs else latest}

    def partitions(self, start: dict, end: dict) -> list[RunFile]:
        system, base = opened(self.folder)
        self.start = max(self.start, end["run"])
        files = []
        for number in range(start["run"] + 1, end["run"] + 1):
            with system.open_input_stream(posixpath.join(base, "_versions", f"v{number}.json")) as told:
                part = json.loads(told.read())["part"]
            infos = system.get_file_info(fs.FileSelector(posixpath.join(base, "data", part)))
            files += [i.path for i in infos if i.size and i.base_name.startswith("part-")]
        return [RunFile(path) for path in sorted(files)]

    def read(self, partition: RunFile) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        rest = b""
        with system.open_input_stream(partition.path) as data:
            while block := data.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield _texts(lines)
        if rest:
            yield _texts([rest])

    def commit(self, end: dict) -> None:
        system, base = opened(self.folder)
        folder = posixpath.join(base, "_done")
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(posixpath.join(folder, str(end["run"]))):
            pass


class QueueSource(DataSource):
    """Stream of ``value string``; options ``path`` and ``runs`` (runs of a batch at most, 0: all)."""

    @classmethod
    def name(cls) -> str:
        return "linkloom_queue"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options["path"], int(self.options.get("runs", 0)))


def read_queue(spark: SparkSession, folder: str, runs: int = 0) -> DataFrame:
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("linkloom_queue").option("path", folder).option("runs", runs).load()
