"""Whole texts as byte arrays: words, hashes of byte ranges, sliding minima. Used inside tasks, a few MB at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts handled together; one longer text is a chunk by itself
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """BASE ** i and BASE ** -i for i < n, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _POWERS[i] = np.cumprod(full)
    return _POWERS


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES):
    """Yield (batch slice, bytes of all its texts joined, bounds of the texts in them)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        bounds = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        for at, end in shares(bounds, limit):
            yield batch.slice(at, end - at), data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at]


def shares(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with ``limit`` bytes at most, or a single longer text."""
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, end
        at = end


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def prefix_hash(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running polynomial sums from which ``range_hash`` gets the hash of any range; each seed gives another hash."""
    value = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(value[data] * powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of the bytes in each range, wherever the range lies."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def sequence_hash(values: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit value of each ``n`` neighbouring values (none if there are fewer than n)."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    total = np.full(len(values) - n + 1, seed, np.uint64)
    for i in range(n):
        total = total * BASE + values[i:len(values) - n + 1 + i]
    return mix(total)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where each window of ``width`` values has its leftmost minimum, judged by the upper 36 bits."""
    index = np.uint64((1 << 28) - 1)
    if len(values) > int(index):
        raise ValueError("a text of more than 2 ** 28 bytes does not fit into a window index")
    best = (values & ~index) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[:len(best) - (width - span)], best[width - span:])
    return (best & index).astype(np.int64)


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Places where a new run of equal values begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = columns[0][1:] != columns[0][:-1]
        for column in columns[1:]:
            new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all given ranges, one after another."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


LONG_BYTES = 256  # ranges beyond get a hash of another kind


def sure_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """``range_hash`` that also keeps long ranges apart: polynomial sums modulo 2 ** 64 fail on some made-up long strings."""
    out = range_hash(prefix_hash(data, seed), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_BYTES).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=bytes([seed]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out
