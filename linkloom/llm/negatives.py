"""Hard negatives of labelled vectors, by a secondary-sort shuffle of scored pairs.

A pair is scored inside the task that reads its row, against a block of anchors of bounded size that every task has. Scores
travel packed into keys (anchor, descending score, positive before negative, id); they are dealt by anchor and sorted within
partitions, so an anchor's pairs come by one after another, best first. The iterator that reads them opens a window at each
positive and gives it the negatives that follow; it holds a few open windows and never the pairs of an anchor.

Pairs that cannot be in the answer stay in the task that scored them: of the same label only the best few of the task can be
among the best few of all, and then, with the positives known, only the best few in each positive's window. This is the
combining step of a shuffle and changes no result. Anchors go block by block, so neither a task nor the driver ever holds
more than one block; each block costs two scans of the rows and no shuffle of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import stored

BLOCK_BYTES = 16 << 20  # vectors of a block of anchors
TILE_BYTES = 32 << 20  # scores that a task holds at once
KEY = struct.Struct(">IQBQ")
KEY_KIND = np.dtype([("anchor", ">u4"), ("score", ">u8"), ("negative", "u1"), ("id", ">u8")])
SIGN = np.uint64(1 << 63)
LEAST = np.iinfo(np.int64).min
POSITIVE, NEGATIVE = 0, 1


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, falling score, kind, rising id."""
    keys = np.empty(len(anchor), KEY_KIND)
    keys["anchor"], keys["negative"] = anchor, kind
    keys["score"] = ~(score.astype(np.int64).view(np.uint64) ^ SIGN)
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ SIGN
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.size), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, number = KEY.unpack(key)
    return anchor, (1 << 63) - 1 - score, kind, number - (1 << 63)


class Block:
    """Some anchors: ids, labels, vectors padded with zeros to one width, and, once known, what their positives allow."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.windows: list[tuple[np.ndarray, np.ndarray]] = []  # per place of a positive: least and largest score of a negative

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Integer inner products, anchors by rows: exact, whatever the size of the components."""
        width = max(1, self.vectors.shape[1])
        small = 2.0 ** 26 / width ** 0.5  # sums of products of such components are whole below 2 ** 53
        plain_a = np.abs(self.vectors).max(axis=1, initial=0) <= small
        plain_r = np.abs(rows).max(axis=1, initial=0) <= small
        if plain_a.all() and plain_r.all():
            return (self.vectors @ rows.T).astype(np.int64)
        out = np.empty((len(self.vectors), len(rows)), np.int64)
        out[np.ix_(plain_a, plain_r)] = self.vectors[plain_a] @ rows[plain_r].T
        whole = lambda values: np.array([[int(x) for x in v] for v in values], object).reshape(values.shape)
        for a, r in ((~plain_a, plain_r | True), (plain_a, ~plain_r)):
            if a.any() and r.any():
                out[np.ix_(a, r)] = (whole(self.vectors[a]) @ whole(rows[r]).T).astype(np.int64)  # beyond a long: OverflowError
        return out


class Best:
    """The best ``k`` pairs of each group seen so far, by falling score, then id; pairs with an equal id all count."""

    def __init__(self, groups: int, k: int, least: np.ndarray | None = None):
        self.k, self.held = k, np.empty((4, 0), np.int64)
        self.least = np.full(groups, LEAST) if least is None else least.copy()  # lower scores are of no use

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        every = np.concatenate([self.held, np.stack([group, score, ids, row])], axis=1)
        every = every[:, np.lexsort((every[2], ~every[1], every[0]))]
        new = np.flatnonzero(np.append(True, every[0][1:] != every[0][:-1]))
        rank = np.arange(every.shape[1]) - np.repeat(new, np.diff(np.append(new, every.shape[1])))
        last = rank == self.k - 1
        self.least[every[0][last]] = every[1][last]
        self.held = every[:, rank < self.k]


def _tiles(batches: Iterator[pa.RecordBatch], block: Block):
    """Rows a tile at a time: number of the first row, ids, labels, scores; the first tiles are small, to learn what is useless."""
    width, most = block.vectors.shape[1], max(64, TILE_BYTES // (8 * max(1, len(block.ids))))
    size, seen = 64, 0
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        vectors = padded(batch.column("v"), width)
        at = 0
        while at < len(ids):
            end = min(len(ids), at + min(size, most))
            yield seen + at, ids[at:end], labels[at:end], block.scores(vectors[at:end])
            at, size = end, size * 2
        seen += len(ids)


def padded(listed: pa.ListArray, width: int | None = None) -> np.ndarray:
    """A list column of numbers as a matrix of whole ones; missing components are 0, those beyond ``width`` meet nothing."""
    n = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(n.max(initial=0)) if width is None else width
    flat = np.floor(listed.flatten().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(n)), n)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((len(n), width))
    inside = column < width
    out[row[inside], column[inside]] = flat[inside]
    return out


def _alike(block, k: int):
    def find(batches: Iterator[pa.RecordBatch]):
        """Keys of the best rows of each anchor's label in this task, the anchor itself among them."""
        here = block.value
        best = Best(len(here.ids), k)
        for first, ids, labels, scores in _tiles(batches, here):
            a, r = np.nonzero((here.labels[:, None] == labels) & (scores >= best.least[:, None]))
            best.add(a, scores[a, r], ids[r], first + r)
        yield pa.RecordBatch.from_arrays([packed(best.held[0], best.held[1], POSITIVE, best.held[2])], ["key"])
    return find


def _unlike(block, k: int):
    def find(batches: Iterator[pa.RecordBatch]):
        """Keys of the best rows of other labels in the window of each positive."""
        here = block.value
        bests = [Best(len(here.ids), k, least) for least, _ in here.windows]
        for first, ids, labels, scores in _tiles(batches, here):
            other = here.labels[:, None] != labels
            for best, (_, most) in zip(bests, here.windows):
                a, r = np.nonzero(other & (scores >= best.least[:, None]) & (scores <= most[:, None]))
                best.add(a, scores[a, r], ids[r], first + r)
        held = np.concatenate([b.held for b in bests], axis=1) if bests else np.empty((4, 0), np.int64)
        held = held[:, np.unique(held[[0, 3]], axis=1, return_index=True)[1]]  # a pair may be in several windows
        yield pa.RecordBatch.from_arrays([packed(held[0], held[1], NEGATIVE, held[2])], ["key"])
    return find


def by_anchor(keys: DataFrame, tasks: int):
    """The secondary sort: keys dealt by their anchor, and in each partition in the order of their bytes."""
    return keys.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(
        tasks, partitionFunc=lambda key: int.from_bytes(key[:4], "big"))


def _first(block, k: int):
    def read(pairs):
        """The first ``k`` rows of each anchor but itself."""
        now, taken, met = None, 0, False
        for key, _ in pairs:
            anchor, score, _, number = unpacked(key)
            if anchor != now:
                now, taken, met = anchor, 0, False
            if not met and number == block.value.ids[anchor] and score == block.value.own[anchor]:
                met = True  # the anchor, or a row that no result could tell from it
            elif taken < k:
                taken += 1
                yield anchor, taken, number, score
    return read


def _opened(lower: int, upper: int, k: int):
    def read(pairs):
        """Negatives of each positive: windows open at positives and close when full or passed."""
        now, windows = None, []
        for key, _ in pairs:
            anchor, score, kind, number = unpacked(key)
            if anchor != now:
                now, windows = anchor, []
            if kind == POSITIVE:
                windows.append([number, score, 0])
                continue
            windows = [w for w in windows if w[2] < k and lower * w[1] <= 100 * score]
            for window in windows:
                if 100 * score <= upper * window[1]:
                    window[2] += 1
                    yield anchor, window[0], window[2], number, window[1], score
    return read


def _window(score: int, lower: int, upper: int) -> tuple[int, int]:
    """Least and largest score of a negative; scores fit a long."""
    return max(LEAST, -(-lower * score // 100)), min(-LEAST - 1, upper * score // 100)


def vectors_of(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """Columns id, label, v (scaled components as doubles) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite
    return rows.where(used).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(
        vector, lambda x: x.cast("double") * scale).alias("v"))


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100, scale: int = 256,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the column ``id`` (the key). Keys and labels are whole numbers. Rows with a null key, label
    or vector, or a component that is null or not finite, take no part. A score is the integer inner product of the
    components times ``scale``, rounded down; vectors of different lengths meet in their common components. Positives of an
    anchor are its ``positives`` best other rows of its label; negatives of a positive are the ``negatives`` best rows of
    other labels with ``lower`` * positive score <= 100 * negative score <= ``upper`` * positive score (``upper`` is 100 at
    most). Ties go to the smaller key. Rows that repeat a key are rows of their own, as anchors too. A score beyond a long is an
    error. No anchors, no positives or an empty table give no rows. Other columns are not looked at.
    """
    if upper > 100:
        raise ValueError("a window opens at its positive: upper is 100 at most")
    rows, spark = vectors_of(rows, key, vector, label, scale), rows.sparkSession
    # equal anchors have equal answers: one stands for all of them
    asked = stored(rows.where(anchors).groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("copies")))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, block_bytes // (8 * max(1, width or 0)))
    blocks = -(-n // each)
    found = []
    for number in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == number).toArrow()  # about ``each`` rows
        if not own.num_rows:
            continue
        ids, labels = (own.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        block = Block(ids, labels, padded(own.column("v").combine_chunks()))
        block.own = np.array([block_score(v) for v in block.vectors], object)
        sent = spark.sparkContext.broadcast(block)
        kind = "anchor int, place int, id long, score long"
        best = by_anchor(rows.mapInArrow(_alike(sent, positives + 1), "key binary"), tasks).mapPartitions(_first(sent, positives))
        best = stored(spark.createDataFrame(best, kind, verifySchema=False))
        told = best.toArrow()  # no more than ``positives`` for each anchor of the block
        ranges = [(np.full(len(ids), -LEAST - 1), np.full(len(ids), LEAST)) for _ in range(positives)]
        for anchor, place, _, score in zip(*(told.column(c).to_pylist() for c in told.column_names)):
            ranges[place - 1][0][anchor], ranges[place - 1][1][anchor] = _window(score, lower, upper)
        block.windows = ranges
        again = spark.sparkContext.broadcast(block)

        def keys(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                anchor, number, score = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "id", "score"))
                yield pa.RecordBatch.from_arrays([packed(anchor, score, POSITIVE, number)], ["key"])

        pairs = best.mapInArrow(keys, "key binary").unionByName(rows.mapInArrow(_unlike(again, negatives), "key binary"))
        names = [int(i) for i in ids]
        copies = own.column("copies").to_pylist()
        opened = by_anchor(pairs, tasks).mapPartitions(_opened(lower, upper, negatives)).flatMap(
            lambda r: [(names[r[0]], *r[1:])] * copies[r[0]])
        found.append(stored(spark.createDataFrame(
            opened, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
            verifySchema=False)))
        sent.unpersist()
        again.unpersist()
    if not found:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, found)


def block_score(vector: np.ndarray) -> int:
    return sum(int(x) ** 2 for x in vector)
