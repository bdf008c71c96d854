"""Columns of numbers and one column of byte strings as a single compressed value, for blocks that travel in one row."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

HEAD = struct.Struct("<III")
CODEC = pa.Codec("zstd", compression_level=5)  # what travels is written and read by disks: a tenth less of it for little time


def pack(columns: list[np.ndarray], strings: bytes, lengths: np.ndarray) -> bytes:
    """All columns have one value for each string; ``lengths`` are the strings' lengths."""
    body = b"".join([c.tobytes() for c in columns] + [lengths.astype("<i4").tobytes(), strings])
    return HEAD.pack(len(lengths), len(body), len(strings)) + CODEC.compress(body, asbytes=True)


def unpack(value: bytes, kinds: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The columns, the joined strings as bytes, their lengths."""
    n, size, _ = HEAD.unpack_from(value)
    body = pa.decompress(memoryview(value)[HEAD.size:], size, codec="zstd", asbytes=True)
    at, out = 0, []
    for kind in [*kinds, "<i4"]:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out[:-1], np.frombuffer(body, np.uint8, -1, at) if at < len(body) else np.empty(0, np.uint8), out[-1]
