"""Word windows that occur before, found by super-k-mer partitioning.

The minimiser of a window is the place with the least hash among its runs of ``minimiser`` words. Neighbouring windows with
the same minimiser travel together, as one packed string, to the bucket of that minimiser's hash; equal windows have equal
minimisers, so they meet there, where sorting counts them.

A minimiser that very many windows share would make its bucket grow without bound. Such minimisers are counted first; their
windows do not travel as strings but under a 128-bit hash, in blocks by that hash. Of equal ones that a task holds only the
first travels: the others are known to come later and leave the task as runs. Both ways give the same answer, so the limit
between them changes cost only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import bytetext as B
from linkloom.llm import framed
from linkloom.llm.tables import numbered, quoted, stored

FLUSH_BYTES = 8 << 20  # packed strings that a task holds before it hands them on
BUCKET_BYTES = 8 << 20  # packed strings of one bucket, about
GROUP_BYTES = 32 << 20  # strings with one minimiser that a task may hold at once
LIMIT = GROUP_BYTES // 160  # so many runs: a run is some 30 words


class Shape:
    """The sizes that decide which windows share a minimiser."""

    def __init__(self, window: int, minimiser: int):
        self.window, self.minimiser = window, minimiser

    def runs(self, data: np.ndarray, bounds: np.ndarray):
        """Per run of windows with one minimiser: text number, first word, windows, minimiser's hash; and the words."""
        starts, ends, firsts = B.words(data, bounds)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(firsts))
        if len(starts) < self.window:
            none = np.empty(0, np.int64)
            return (none, none, none, none.astype(np.uint64)), (starts, ends, firsts)
        grams = B.sequence_hash(B.range_hash(B.prefix_hash(data), starts, ends), self.minimiser)
        least = B.sliding_argmin(grams, self.window - self.minimiser + 1)
        valid = np.flatnonzero(text[:len(least)] == text[self.window - 1:])
        least = least[valid]
        new = B.runs_of(least, text[valid])
        count = np.diff(np.append(new, len(valid)))
        first = valid[new]
        return (text[first], first, count, grams[least[new]]), (starts, ends, firsts)

    def seen(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Hashes of the minimisers of all runs that travel."""
        return self.runs(data, bounds)[0][3], None


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values for each window of the words that begin at ``starts``."""
    return tuple(B.sequence_hash(B.range_hash(B.prefix_hash(data, seed), starts, ends), window) for seed in (0, 1))


def counter(shape, at_least: int):
    def count(batches: Iterator[pa.RecordBatch]):
        """Minimisers that this task meets ``at_least`` times: one met ``limit`` times in all is among them in some task."""
        values, alike = [], []
        for _, data, bounds in B.chunks(batches):
            minimisers, identity = shape.seen(data, bounds)
            values.append(minimisers)
            alike.append(identity)
        values = np.concatenate(values) if values else np.empty(0, np.uint64)
        if alike and alike[0] is not None:  # runs with equal strings travel once
            values = values[np.unique(B.mix(values ^ B.mix(np.concatenate(alike))), return_index=True)[1]]
        values, counts = np.unique(values, return_counts=True)
        often = counts >= at_least
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))],
                                         ["minimiser", "n"])
    return count


def hot_minimisers(texts: DataFrame, shape, limit: int, tasks: int) -> np.ndarray:
    """Hashes of minimisers that ``limit`` runs share; any other one has less than twice as many.

    A task tells of the minimisers it meets ``limit / tasks`` times (at least once), and what is told is summed. The list
    has no more entries than runs / limit; with more tasks than ``limit``, their number is the limit, so that the list
    stays as small as the runs of one task.
    """
    limit = max(limit, tasks)
    told = texts.mapInArrow(counter(shape, limit // max(1, tasks)), "minimiser long, n long")
    hot = told.groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") >= limit).select("minimiser")
    return np.sort(np.array([r[0] for r in hot.collect()], np.int64).view(np.uint64))


def dealt(number: np.ndarray, columns: list[np.ndarray], first: int) -> Iterator[tuple[int, bytes]]:
    """Rows of numbers in one packed block for each ``number``, as (first + number, block)."""
    order = np.argsort(number, kind="stable")
    new = B.runs_of(number[order])
    for lo, hi in zip(new, np.append(new[1:], len(order))):
        part = order[lo:hi]
        yield first + int(number[part[0]]), framed.pack([c[part] for c in columns], b"", np.zeros(hi - lo, np.int32))


def gathered(blocks: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns of ``dealt`` blocks, joined."""
    parts = [framed.unpack(b, kinds)[0] for b in blocks]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def _packer(shape: Shape, buckets: int, hot: np.ndarray):
    def pack(batches: Iterator[pa.RecordBatch]):
        """Packed runs by bucket; from ``buckets`` on single windows of hot minimisers by their hash, from twice that on runs that
        are known to come later."""
        held: list[tuple] = []
        singles: list[tuple] = []
        size = 0

        def flush_singles():
            if not singles:
                return
            h1, h2, key, row, start = (np.concatenate([s[i] for s in singles]) for i in range(5))
            singles.clear()
            later = later_ones(h1, h2, key, row, start)
            travels = np.ones(len(h1), bool)
            travels[later] = False
            known = [c.astype(k) for c, k in zip(joined(row[later], start[later]), RUN_KINDS)]
            yield from dealt(known[0] % buckets, known, 2 * buckets)
            columns = [c[travels].astype(k) for c, k in zip((row, key, start, h1, h2), SINGLE_KINDS)]
            yield from dealt((columns[3] % np.uint64(buckets)).astype(np.int64), columns, buckets)

        def flush():
            nonlocal size
            yield from flush_singles()
            if not held:
                size = 0
                return
            columns = [np.concatenate([h[i] for h in held]) for i in range(5)]
            strings = [s for h in held for s in h[5]]
            bucket = columns[4] % np.uint64(buckets)
            order = np.lexsort((columns[4], bucket))
            bucket = bucket[order]
            new = B.runs_of(bucket)
            for lo, hi in zip(new, np.append(new[1:], len(order))):
                part = order[lo:hi]
                mine = [strings[i] for i in part]
                value = framed.pack([c[part] for c in columns], b"".join(mine), np.fromiter(map(len, mine), np.int32, len(mine)))
                yield int(bucket[lo]), value
            held.clear()
            size = 0

        def blocks(flushed):
            rows = list(flushed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["bucket", "block"])

        for batch, data, bounds in B.chunks(batches):
            row = batch.column("row").to_numpy(zero_copy_only=False)
            key = batch.column("key").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            (text, first, count, gram), (starts, ends, _) = shape.runs(data, bounds)
            if not len(text):
                continue
            begin = first - np.searchsorted(starts, bounds)[text]  # word number in its text
            special = np.isin(gram, hot)
            if special.any():
                h1, h2 = _hashes(data, starts, ends, shape.window)
                which = B.spread(first[special], count[special])
                own = np.repeat(np.flatnonzero(special), count[special])
                singles.append((h1[which], h2[which], key[text[own]], row[text[own]], begin[own] + which - first[own]))
                size += SINGLE_BYTES * len(which)
            plain = ~special
            text, first, count, gram, begin = (c[plain] for c in (text, first, count, gram, begin))
            keep = B.IS_WORD[data]
            after = ends[ends < len(data)]
            keep[after] = True  # one separator after each word
            place = np.cumsum(keep)[starts] - 1
            line = data[keep]
            line[~B.IS_WORD[line]] = 32
            line = line.tobytes()
            lo = place[first]
            last = first + count + shape.window - 2
            hi = place[last] + (ends - starts)[last]
            strings = [line[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
            held.append((row[text], key[text], begin.astype(np.int32), count.astype(np.int16), gram, strings))
            size += int((hi - lo).sum())
            if size >= FLUSH_BYTES:
                yield from blocks(flush())
        yield from blocks(flush())
    return pack


BLOCK_KINDS = ["<i8", "<i8", "<i4", "<i2", "<u8"]
SINGLE_KINDS = ["<i8", "<i8", "<i4", "<u8", "<u8"]  # row, key, start and both hashes
SINGLE_BYTES = 36
RUN_KINDS = ["<i8", "<i4", "<i4"]  # row, first start, number


def later_ones(h1, h2, key, row, start) -> np.ndarray:
    """Which of these windows are equal to another one that begins earlier."""
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    some = order[twin]
    some = some[np.lexsort((start[some], row[some], key[some], h2[some], h1[some]))]
    later = np.ones(len(some), bool)
    later[B.runs_of(h1[some], h2[some])] = False
    return some[later]


def joined(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single windows as runs of neighbours: row, first start, number."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = B.runs_of(row, start - np.arange(len(start)))
    return row[new], start[new], np.diff(np.append(new, len(row)))


def _finder(window: int, buckets: int):
    def find(batches: Iterator[pa.RecordBatch]):
        def runs(row: np.ndarray, start: np.ndarray, n: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (row, start, n)], ["row", "start", "n"])

        def solve(bucket: int, blocks: list[bytes]):
            if bucket >= 2 * buckets:
                return runs(*gathered(blocks, RUN_KINDS))
            if bucket >= buckets:
                row, key, start, h1, h2 = gathered(blocks, SINGLE_KINDS)
                found = later_ones(h1, h2, key, row, start)
                return runs(*joined(row[found], start[found]))
            parts = [framed.unpack(b, BLOCK_KINDS) for b in blocks]
            row, key, begin, count, gram = (np.concatenate([p[0][i] for p in parts]) for i in range(5))
            lengths = np.concatenate([p[2] for p in parts]).astype(np.int64)
            data = np.concatenate([p[1] for p in parts])
            at = np.cumsum(lengths) - lengths
            # a minimiser that came once has no equal windows
            order = np.argsort(gram, kind="stable")
            new = B.runs_of(gram[order])
            several = np.repeat(np.diff(np.append(new, len(order))) > 1, np.diff(np.append(new, len(order))))
            members = np.sort(order[several])
            count = count[members].astype(np.int64)
            hashes = [], []
            for lo, hi in B.shares(np.append(0, np.cumsum(lengths[members]))):
                some = members[lo:hi]
                part = data[B.spread(at[some], lengths[some])]
                starts, ends, firsts = B.words(part, np.append(0, np.cumsum(lengths[some])))
                which = B.spread(firsts[:-1], count[lo:hi])
                for h, values in zip(hashes, _hashes(part, starts, ends, window)):
                    h.append(values[which])
            h1, h2 = (np.concatenate(h) if h else np.empty(0, np.uint64) for h in hashes)
            row, key = np.repeat(row[members], count), np.repeat(key[members], count)
            start = B.spread(begin[members].astype(np.int64), count)
            found = later_ones(h1, h2, key, row, start)
            return runs(*joined(row[found], start[found]))

        held, now = [], None
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if held and bucket != now:
                    yield solve(now, held)
                    held = []
                now = bucket
                held.append(block)
        if held:
            yield solve(now, held)
    return find


def extent(rows: DataFrame) -> tuple[int, int]:
    """Bytes of text, and tasks that read them."""
    told = rows.select(F.octet_length("text").alias("bytes"), F.spark_partition_id().alias("task"))
    size, tasks = told.agg(F.sum("bytes"), F.count_distinct("task")).first()
    return size or 0, tasks


def later_windows(rows: DataFrame, window: int, minimiser: int, limit: int) -> DataFrame:
    """Runs of windows that also start earlier (smaller key, then row, then place): columns row, start, n, in words.

    ``rows`` has row, key (a whole number; null is last) and text. ``limit``: windows of a minimiser that more runs share
    go by their hash; the list of those is at most the number of runs over ``limit``.
    """
    shape = Shape(window, minimiser)
    size, tasks = extent(rows)
    buckets = max(1, 3 * size // BUCKET_BYTES)
    texts = rows.select("row", "key", "text")
    hot = hot_minimisers(texts, shape, limit, tasks)
    packed = texts.mapInArrow(_packer(shape, buckets, hot), "bucket long, block binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _finder(window, buckets), "row long, start long, n long")


def _cutter(window: int):
    def cut(batches: Iterator[pa.RecordBatch]):
        for batch, data, bounds in B.chunks(batches):
            starts, ends, firsts = B.words(data, bounds)
            runs = batch.column("runs")
            flat = runs.flatten()
            n_runs = pc.list_value_length(runs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(firsts[:-1], n_runs)
            length = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64) + window - 1
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + length, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept = np.flatnonzero(~gone)
            text = np.searchsorted(firsts, kept, "right") - 1
            lengths = (ends - starts)[kept] + 1
            last = np.append(text[1:] != text[:-1], True) if len(kept) else np.empty(0, bool)
            lengths[last] -= 1
            line = np.append(data, np.uint8(32))[B.spread(starts[kept], lengths)]
            line[(np.cumsum(lengths) - 1)[~last]] = 32
            sizes = np.bincount(text, lengths, len(bounds) - 1).astype(np.int64)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            n_words = np.diff(firsts)
            n_removed = np.add.reduceat(np.append(gone, False), firsts[:-1]) * (n_words > 0) if len(n_words) else n_words
            given = [c for c in batch.schema.names if c not in ("text", "runs")]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, given), pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64)),
                 pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(line.tobytes()))],
                [*given, "n_words", "n_removed", "kept_text"])
    return cut


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, minimiser: int = 3,
                 limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc (the whole input row without its text), n_words, n_removed, kept_text (the words that
    stay, joined by one space).

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a row with a smaller key, of
    equal or null (last) keys in an earlier row, or earlier in the same text. Null and empty texts have no words; texts
    shorter than a window stay whole. Keys are whole numbers. An empty table gives an empty table. A text is read whole; one
    may have up to 2 ** 28 bytes. The input row is in ``doc``, so its column names clash with nothing.
    """
    rows = numbered(docs).select(
        "row", F.col(f"doc.{quoted(key)}").cast("long").alias("key"),
        F.struct(*[F.col(f"doc.{quoted(c)}").alias(c) for c in docs.columns if c != text]).alias("doc"),
        F.coalesce(F.col(f"doc.{quoted(text)}"), F.lit("")).alias("text"))
    runs = later_windows(rows, window, minimiser, limit).groupBy("row").agg(
        F.collect_list(F.struct("start", "n")).alias("runs"))  # no more than a text has words
    made = T.StructType([rows.schema["row"], rows.schema["doc"], T.StructField("n_words", T.LongType()),
                         T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return rows.drop("key").join(stored(runs), "row", "left").mapInArrow(_cutter(window), made).drop("row")
