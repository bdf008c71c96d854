"""Byte strings of a fixed length that occur more than once, by a common-prefix-aware distributed merge sort of suffixes.

Sorting the suffix at every byte would move each byte hundreds of times. It is enough to sort the suffixes at anchors: the
anchor of a 400-byte string is the place with the least hash among its 16-byte grams, so equal strings have equal anchors
at equal offsets, and neighbouring strings mostly share one. A member is such a run of strings: the bytes from the anchor
on, which are sorted, and the bytes before it.

Each task sorts its members and cuts them by range; a range travels as a front-coded run (length of the prefix shared with
the entry before, and the rest). A reducer merges the runs of its range with a loser tree whose nodes remember the prefix
that a loser shares with the last winner, so no known prefix is compared again. Members whose neighbour in the result shares
the whole gram may hold equal strings, and only there strings are compared, by a 128-bit hash.

Members that are alike within a task travel once. Grams that very many members share are counted first, and their strings go
by their hash, as in ``windows``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import bytetext as B
from linkloom.llm import framed
from linkloom.llm.tables import keyed_once, quoted, stored
from linkloom.llm.windows import RUN_KINDS, dealt, extent, gathered, hot_minimisers, joined

RUN_BYTES = 6 << 20  # bytes of text whose members are sorted together
RANGE_BYTES = 8 << 20  # bytes of members in one range, about
GROUP_BYTES = 64 << 20  # strings of one gram that a task may hold at once
LIMIT = GROUP_BYTES // 400  # members of one gram that a task may hold at once
SAMPLE_BYTES = 16 << 20  # text from which the ends of the ranges are taken: they decide the balance only
KINDS = ["<i8", "<i4", "<i2", "<i2", "<i2"]  # row, start, strings, shared prefix, bytes before the anchor
SINGLE_KINDS = ["<i8", "<i4", "<u8", "<u8"]  # row, start and both hashes
SINGLE_BYTES = 28


class Shape:
    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def members(self, data: np.ndarray, bounds: np.ndarray):
        """Text number, first start, number of starts, gram's hash and anchor of each run of strings with one anchor."""
        if len(data) < self.length:
            none = np.empty(0, np.int64)
            return none, none, none, none.astype(np.uint64), none
        prefix = B.prefix_hash(data)
        at = np.arange(len(data) - self.gram + 1)
        grams = B.range_hash(prefix, at, at + self.gram)
        least = B.sliding_argmin(grams, self.length - self.gram + 1)
        sizes = np.maximum(np.diff(bounds) - self.length + 1, 0)
        valid = B.spread(bounds[:-1], sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        least = least[valid]
        new = B.runs_of(least, text)
        return text[new], valid[new], np.diff(np.append(new, len(valid))), grams[least[new]], least[new]

    def seen(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all members' grams, and values that only alike members share."""
        _, first, count, gram, _ = self.members(data, bounds)
        return gram, B.range_hash(B.prefix_hash(data), first, first + count - 1 + self.length)


def _heads(shape: Shape):
    def heads(batches: Iterator[pa.RecordBatch]):
        for _, data, bounds in B.chunks(batches):
            anchors = shape.members(data, bounds)[4]
            whole = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([whole[a:a + shape.gram] for a in anchors.tolist()], pa.binary())], ["head"])
    return heads


def _front_coded(entries: list[bytes]) -> np.ndarray:
    """Length of the prefix that each entry shares with the one before."""
    lengths = np.fromiter(map(len, entries), np.int64, len(entries))
    width = int(lengths.max(initial=0))
    grid = np.frombuffer(b"".join(e.ljust(width, b"\0") for e in entries), np.uint8).reshape(len(entries), width)
    shared = np.zeros(len(entries), np.int64)
    if len(entries) > 1:
        differs = grid[1:] != grid[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return shared


def _sorter(shape: Shape, ends: list[bytes], hot: np.ndarray):
    """Sorted front-coded runs by range; behind the ranges single strings of hot grams by their hash."""
    parts = len(ends) + 1

    def sort(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        singles: list[tuple] = []
        size = 0

        def flush_singles():
            if not singles:
                return
            h1, h2, row, start = (np.concatenate([s[i] for s in singles]) for i in range(4))
            singles.clear()
            # equal strings: all of them are repeats; the first also travels, to meet those of other tasks
            alike = repeated(h1, h2)
            known = [c.astype(k) for c, k in zip(joined(row[alike], start[alike]), RUN_KINDS)]
            yield from dealt(2 * (known[0] % parts), known, 2 * parts)
            travels = np.ones(len(h1), bool)
            travels[alike] = False
            travels[alike[B.runs_of(h1[alike], h2[alike])]] = True
            columns = [c[travels].astype(k) for c, k in zip((row, start, h1, h2), SINGLE_KINDS)]
            yield from dealt(2 * (columns[2] % np.uint64(parts)).astype(np.int64) + 1, columns, 2 * parts)

        def flush():
            nonlocal size
            right = [r for h in held for r in h[3]]
            left = [r for h in held for r in h[4]]
            row, start, count = (np.concatenate([h[i] for h in held]) if held else np.empty(0, np.int64) for i in range(3))
            held.clear()
            size = 0
            order = sorted(range(len(right)), key=lambda i: (right[i], left[i]))
            ranges, blocks = map(list, zip(*flush_singles())) if singles else ([], [])
            cuts = [0, *[bisect_left(order, e, key=lambda i: right[i]) for e in ends], len(order)]
            for number, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                part = order[lo:hi]
                if not part:
                    continue
                # alike members: all of them are repeats; the first also travels as an entry, to meet those of other tasks
                alike = [b > 0 and right[i] == right[part[b - 1]] and left[i] == left[part[b - 1]] for b, i in enumerate(part)]
                entries = [i for i, a in zip(part, alike) if not a]
                twins = [i for b, i in enumerate(part) if alike[b] or (b + 1 < len(part) and alike[b + 1])]
                for kind, own in ((0, twins), (1, entries)):
                    if not own:
                        continue
                    own = np.array(own)
                    columns = [row[own].astype("<i8"), start[own].astype("<i4"), count[own].astype("<i2")]
                    if kind:
                        mine, before = [right[i] for i in own], [left[i] for i in own]
                        shared = _front_coded(mine)
                        rest = [m[s:] + b for m, s, b in zip(mine, shared.tolist(), before)]
                        columns += [shared.astype("<i2"), np.fromiter(map(len, before), "<i2", len(own))]
                    else:
                        rest = [b""] * len(own)
                        columns += [np.zeros(len(own), "<i2")] * 2
                    ranges.append(2 * number + kind)
                    blocks.append(framed.pack(columns, b"".join(rest), np.fromiter(map(len, rest), np.int64, len(own))))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(blocks, pa.binary())], ["range", "block"])

        for batch, data, bounds in B.chunks(batches):
            row = batch.column("row").to_numpy(zero_copy_only=False)
            text, first, count, gram, anchor = shape.members(data, bounds)
            special = np.isin(gram, hot)
            if special.any():
                which = B.spread(first[special], count[special])
                own = np.repeat(np.flatnonzero(special), count[special])
                h1, h2 = (B.range_hash(B.prefix_hash(data, seed), which, which + shape.length) for seed in (0, 1))
                singles.append((h1, h2, row[text[own]], which - bounds[text[own]]))
                size += SINGLE_BYTES * len(which)
            plain = ~special
            text, first, count, anchor = (c[plain] for c in (text, first, count, anchor))
            whole = data.tobytes()
            end = first + count - 1 + shape.length
            held.append((row[text], first - bounds[text], count,
                         [whole[a:b] for a, b in zip(anchor.tolist(), end.tolist())],
                         [whole[a:b] for a, b in zip(first.tolist(), anchor.tolist())]))
            size += len(data)
            if size >= RUN_BYTES:
                yield from flush()
        yield from flush()
    return sort


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    most = min(len(a), len(b))
    step = 32
    while known < most:
        if a[known:known + step] == b[known:known + step]:
            known = min(known + step, most)
        elif step > 1:
            step //= 4 if step > 2 else 2
            step = max(step, 1)
        else:
            break
    return known


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs: (run, place in it, length of the prefix shared with the entry given before).

    ``shared`` has the prefix that each entry of a run shares with its predecessor there. A loser tree: each node keeps the
    run that lost there and the prefix it shares with the winner that beat it. Of two entries that follow the same winner,
    the one that shares more of it is smaller; only equal lengths are compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    current = [runs[i][0] if i < len(runs) and runs[i] else None for i in range(k)]
    loser, prefix = [0] * k, [0] * k

    def play(a: int, pa_: int, b: int, pb: int):
        """Winner and its prefix, loser and its prefix with the winner."""
        x, y = current[a], current[b]
        if y is None:
            return a, pa_, b, 0
        if x is None:
            return b, pb, a, 0
        if pa_ > pb:
            return a, pa_, b, pb
        if pb > pa_:
            return b, pb, a, pa_
        n = _shared(x, y, pa_)
        return (a, pa_, b, n) if x[n:n + 1] <= y[n:n + 1] else (b, pb, a, n)

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        a, pa_ = build(2 * node)
        b, pb = build(2 * node + 1)
        a, pa_, loser[node], prefix[node] = play(a, pa_, b, pb)
        return a, pa_

    best, known = build(1)
    while current[best] is not None:
        yield best, place[best], known
        place[best] += 1
        at = place[best]
        if at < len(runs[best]):
            current[best], known = runs[best][at], shared[best][at]
        else:
            current[best], known = None, 0
        node = (best + k) // 2
        while node:
            other, theirs = loser[node], prefix[node]
            if current[other] is not None:
                if current[best] is None or theirs > known:
                    best, known, loser[node], prefix[node] = other, theirs, best, known
                elif theirs == known:
                    best, known, loser[node], prefix[node] = play(best, known, other, theirs)
            node //= 2


def repeated(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Places whose pair of values occurs more than once."""
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    some = order[twin]
    some = some[np.lexsort((h2[some], h1[some]))]
    new = B.runs_of(h1[some], h2[some])
    size = np.diff(np.append(new, len(some)))
    return some[np.repeat(size > 1, size)]


def _merger(shape: Shape, parts: int):
    def solve(number: int, blocks: list[bytes]):
        if number >= 2 * parts:
            row, start, h1, h2 = gathered(blocks, SINGLE_KINDS)
            found = repeated(h1, h2)
            return joined(row[found], start[found])
        runs, shared, lefts, columns = [], [], [], []
        for block in blocks:
            (row, start, count, prefix, before), data, lengths = framed.unpack(block, KINDS)
            rest, at, own, own_left, last = data.tobytes(), 0, [], [], b""
            for n, p, b in zip(lengths.tolist(), prefix.tolist(), before.tolist()):
                last = last[:p] + rest[at:at + n - b]
                own.append(last)
                own_left.append(rest[at + n - b:at + n])
                at += n
            runs.append(own)
            lefts.append(own_left)
            shared.append(prefix.tolist())
            columns.append((row, start, count))
        merged = list(merge(runs, shared))
        known = np.fromiter((m[2] for m in merged), np.int64, len(merged))
        close = np.zeros(len(merged) + 1, bool)
        close[:-1] = known >= shape.gram  # with the one before
        some = [merged[i] for i in np.flatnonzero(close[:-1] | close[1:])]
        strings = [lefts[r][i] + runs[r][i] for r, i, _ in some]
        row, start, count = (np.array([columns[r][c][i] for r, i, _ in some], np.int64) for c in range(3))
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        hashes = [], []
        for lo, hi in B.shares(np.append(0, np.cumsum(sizes))):
            data = np.frombuffer(b"".join(strings[lo:hi]), np.uint8)
            which = B.spread(np.cumsum(sizes[lo:hi]) - sizes[lo:hi], count[lo:hi])
            for seed in (0, 1):
                hashes[seed].append(B.range_hash(B.prefix_hash(data, seed), which, which + shape.length))
        found = repeated(*[np.concatenate(h) if h else np.empty(0, np.uint64) for h in hashes])
        row, start = np.repeat(row, count), B.spread(start, count)
        return joined(row[found], start[found])

    def find(batches: Iterator[pa.RecordBatch]):
        def out(columns):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["row", "start", "n"])

        held, now = [], None
        for batch in batches:
            for number, block in zip(batch.column("range").to_pylist(), batch.column("block").to_pylist()):
                if number % 2 == 0:
                    yield out(gathered([block], RUN_KINDS) if number >= 2 * parts else framed.unpack(block, KINDS)[0][:3])
                    continue
                if held and number != now:
                    yield out(solve(now, held))
                    held = []
                now = number
                held.append(block)
        if held:
            yield out(solve(now, held))
    return find


def repeated_strings(rows: DataFrame, length: int, gram: int, limit: int) -> DataFrame:
    """Runs of starts whose ``length`` bytes also start elsewhere: columns row, start, n. ``rows`` has row and text."""
    shape = Shape(length, gram)
    size, tasks = extent(rows)
    texts = rows.select("row", "text")
    ranges = max(1, 3 * size // RANGE_BYTES)
    heads = sorted(r[0] for r in texts.sample(min(1.0, SAMPLE_BYTES / max(1, size)), 7).mapInArrow(
        _heads(shape), "head binary").collect()) if ranges > 1 else []
    ends = sorted({bytes(heads[len(heads) * i // ranges]) for i in range(1, ranges)}) if heads else []
    hot = hot_minimisers(texts, shape, limit, tasks)
    packed = texts.mapInArrow(_sorter(shape, ends, hot), "range long, block binary")
    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(
        _merger(shape, len(ends) + 1), "row long, start long, n long")


def _cutter(length: int):
    def cut(batches: Iterator[pa.RecordBatch]):
        for batch, data, bounds in B.chunks(batches):
            runs = batch.column("runs")
            flat = runs.flatten()
            n_runs = pc.list_value_length(runs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = flat.field(0).to_numpy(zero_copy_only=False) + np.repeat(bounds[:-1], n_runs)
            end = start + flat.field(1).to_numpy(zero_copy_only=False) + length - 1
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, start, 1)
            np.add.at(depth, end, -1)
            gone = np.cumsum(depth[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            heads = bounds[:-1][np.diff(bounds) > 0]
            first[heads] = gone[heads]
            total = lambda marks: np.diff(np.append(0, np.cumsum(marks))[bounds])
            removed = total(gone)
            offsets = np.append(0, np.cumsum(np.diff(bounds) - removed)).astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [
                None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~gone].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"), pa.array(np.diff(bounds)), pa.array(removed.astype(np.int64)),
                 pa.array(total(first).astype(np.int64)), kept], ["row", "key", "n_bytes", "n_removed", "n_spans", "kept"])
    return cut


def drop_repeated_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, gram: int = 16,
                          limit: int = LIMIT) -> DataFrame:
    """One row per input row: row, key, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay).

    A text's UTF-8 bytes go where a string of ``length`` bytes covers them that also starts anywhere else, in the same text
    or another one. Null and empty texts have no bytes; texts shorter than ``length`` stay whole; a repeated row is another
    text. An empty table gives an empty table. A text is read whole; one may have up to 2 ** 28 bytes.
    """
    rows = keyed_once(docs, key, text).select("row", "key", F.col(quoted(text)).alias("text"))
    runs = repeated_strings(rows, length, gram, limit).groupBy("row").agg(
        F.collect_list(F.struct("start", "n")).alias("runs"))  # no more than a text has bytes
    kind = dict(rows.dtypes)["key"]
    return rows.join(stored(runs), "row", "left").mapInArrow(
        _cutter(length), f"row long, key {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
