"""First arrival of each key for good, without state that grows in the stream.

Known keys lie in the shared folder, one segment per batch, in partitions by a hash of the key. Beside each partition of a
segment is a Bloom filter of its keys. A batch asks the filters first: keys that none of them may hold are new and no stored
key is read for them; the others are looked up exactly, in their partitions only. Segments of like size are merged, so their
number stays small. A batch that is repeated after a failure finds its epoch in the manifest and changes nothing.
"""

from __future__ import annotations

import math
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.sources.versions import Versions
from linkloom.streaming.flows import run_available

BITS_PER_KEY, PROBES = 12, 8  # about three false alarms in a thousand


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of keys in a filter: one row for each probe."""
    value = hashes.view(np.uint64)
    step = (value >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((value + turns * step) % np.uint64(bits)).astype(np.int64)


def filter_of(hashes: np.ndarray) -> bytes:
    size = max(64, 8 * math.ceil(len(hashes) * BITS_PER_KEY / 8))
    out = np.zeros(size, bool)
    out[probes(hashes, size).ravel()] = True
    return np.packbits(out).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    flat = np.frombuffer(bits, np.uint8)
    at = probes(hashes, 8 * len(flat))
    return ((flat[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def _filters(rows: pa.Table) -> pa.Table:
    hashes = rows.column("h").to_numpy()
    return pa.table({"bucket": rows.column("bucket").slice(0, 1), "bits": pa.array([filter_of(hashes)], pa.binary())})


def _asked(rows: pa.Table, filters: pa.Table) -> pa.Table:
    hashes = rows.column("h").to_numpy()
    known = np.zeros(len(hashes), bool)
    for bits in filters.column("bits").to_pylist():
        known |= may_hold(bits, hashes)
    return rows.append_column("maybe", pa.array(known))


class FirstArrivals:
    """Keeps what has been seen below ``folder``; ``keys`` name the columns of a key (null is a value), ``order`` the arrival."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str, buckets: int = 64, fanout: int = 8):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, f"{folder}/store")
        self.keys, self.order, self.buckets, self.fanout = keys, order, buckets, fanout
        self.looked_up = 0  # keys of the last batch that had to be looked up

    def state(self) -> tuple[int, dict]:
        number = self.versions.latest()
        return number, self.versions.content(number) or {"epoch": -1, "segments": {}}

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").schema(schema).parquet(
            *[f"{self.folder}/{kind}/segment={n}" for n in names])

    def _keys_kind(self, rows: DataFrame) -> str:
        return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in self.keys)

    def _store(self, rows: DataFrame, name: str) -> int:
        """Write keys (with h and bucket) as a segment with its filters; how many there are."""
        rows.select(*self.keys, "h", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/keys/segment={name}")
        kind = f"{self._keys_kind(rows)}, h bigint, segment string, bucket int"
        stored = self._read("keys", [name], kind).select("bucket", "h")
        stored.groupBy("bucket").applyInArrow(_filters, "bucket int, bits binary").write.parquet(f"{self.folder}/filters/segment={name}")
        return stored.count()

    def step(self, batch: DataFrame, epoch: int) -> None:
        """Write the rows of a batch whose key is seen for the first time to ``rows/batch=<epoch>``."""
        base, state = self.state()
        if epoch <= state["epoch"]:
            return
        others = [c for c in batch.columns if c not in self.keys]
        first = batch.groupBy(*self.keys).agg(F.min_by(F.struct(*others), self.order).alias("row")).withColumn("h", F.xxhash64(*self.keys))
        first = first.withColumn("bucket", F.pmod("h", F.lit(self.buckets)).cast("int"))
        place = f"{self.folder}/asked/batch={epoch}"
        names = list(state["segments"])
        kind = T.StructType([*first.schema.fields, T.StructField("maybe", T.BooleanType())])
        if names:
            filters = self._read("filters", names, "bucket int, bits binary").select("bucket", "bits")
            asked = first.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_asked, kind)
        else:
            asked = first.withColumn("maybe", F.lit(False))
        asked.write.mode("overwrite").parquet(place)
        asked = self.spark.read.schema(kind).parquet(place)
        maybe = asked.where("maybe")
        buckets = {r["bucket"]: r["count"] for r in maybe.groupBy("bucket").count().collect()}  # no more than buckets
        self.looked_up = sum(buckets.values())
        new = asked.where("NOT maybe")
        if buckets:
            known = self._read("keys", names, f"{self._keys_kind(batch)}, h bigint, segment string, bucket int").where(
                F.col("bucket").isin(list(buckets)))
            k = known.select(F.col("h").alias("_h"), *[F.col(c).alias(f"_{c}") for c in self.keys])
            same = (F.col("h") == F.col("_h"))
            for c in self.keys:
                same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
            new = new.unionByName(maybe.join(k, same, "left_anti"))
        new.select(*self.keys, "row.*").select(batch.columns).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={epoch}")
        name = f"s{uuid4().hex}"
        # the rows just written are the new keys
        done = self.spark.read.schema(batch.schema).parquet(f"{self.folder}/rows/batch={epoch}").select(*self.keys)
        done = done.withColumn("h", F.xxhash64(*self.keys)).withColumn("bucket", F.pmod("h", F.lit(self.buckets)).cast("int"))
        count = self._store(done, name)
        if count:
            state["segments"][name] = count
        state["epoch"] = epoch
        self._merge(state, batch)
        self.versions.commit(base, state)
        self.versions.files.remove(place)

    def _merge(self, state: dict, batch: DataFrame) -> None:
        tiers: dict[int, list[str]] = {}
        for name, count in state["segments"].items():
            tiers.setdefault(int(math.log(count, self.fanout)), []).append(name)
        for names in tiers.values():
            if len(names) >= self.fanout:
                name = f"s{uuid4().hex}"
                rows = self._read("keys", names, f"{self._keys_kind(batch)}, h bigint, segment string, bucket int")
                total = self._store(rows.select(*self.keys, "h", "bucket"), name)
                for old in names:
                    del state["segments"][old]
                state["segments"][name] = total

    def run(self, captures: DataFrame) -> DataFrame:
        """Process what has arrived; all first arrivals so far, those of earlier runs too."""
        run_available(captures, self.step, self.folder)
        return self.spark.read.schema(captures.schema).parquet(f"{self.folder}/rows").drop("batch")
