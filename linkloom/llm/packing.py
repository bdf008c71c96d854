"""Documents as token sequences of a bounded length, by bulk-synchronous best fit.

Pieces of documents and gaps of open sequences are sorted by size. In each round all pieces that are left look for their
successor among the gaps, the smallest one that holds them, in a sweep from the largest size down; a gap takes one piece a
round, and of pieces that want the same gap the first by rank (longest, then order in their class) gets it. Gaps shrink,
and the round is repeated; sequences are opened for the longest pieces that fit nowhere.

A size is at most the capacity, so the sorted order is held as size classes: a class of pieces is a range of ranks, a class
of gaps a range of sequence numbers, and a match binds a range of one to a range of the other. A round thus handles no more
rows than there are sizes, however many pieces there are. Ranks are given out by Spark, in parts of each class; every piece
then finds the range that holds its rank.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from linkloom.llm.tables import keyed, stored

PART_ROWS = 1_000_000  # pieces of one size that one task ranks


def encoder(path: str, specials: dict[str, int]) -> tiktoken.Encoding:
    """The byte-level encoder of a vocabulary file; its special strings in a text become their ids."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)


def fallback(path: str, specials: dict[str, int]) -> Tokenizer:
    """The same encoder by the tokenizers library, from the JSON file beside the vocabulary; no run of white space is too long for it."""
    tokenizer = Tokenizer.from_file(str(Path(path).with_suffix(".json")))
    if any(tokenizer.token_to_id(name) != number for name, number in specials.items()):
        raise ValueError("the JSON file beside the vocabulary has other special strings")
    return tokenizer


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids, and n: only the first piece may be shorter than the capacity."""
    return sorted({0, *range(n, 0, -capacity)})


def _pieces(path: str, specials: dict[str, int], end_id: int, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]):
        encode, slow = encoder(path, specials).encode, None

        def ids_of(text: str) -> list[int]:
            nonlocal slow
            try:
                return encode(text, allowed_special="all")
            except ValueError:  # its patterns give up on runs of some million spaces
                slow = slow or fallback(path, specials)
                return slow.encode(text, add_special_tokens=False).ids

        for batch in batches:
            out = ([], [], [], [], [], [], [])
            for row, key, text in zip(*[batch.column(c).to_pylist() for c in ("row", "key", "text")]):
                ids = np.array([*ids_of(text), end_id], "<u4")
                cuts = cut_points(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[a:b]
                    for column, value in zip(out, (row, key, piece, a, b - a, zlib.crc32(part.tobytes()), part.view("<i4") if with_ids else None)):
                        column.append(value)
            kinds = (pa.int64(), batch.schema.field("key").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            if with_ids:
                arrays.append(pa.array(out[6], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["row", "key", "piece", "start", "length", "ids_crc32", "ids"][:len(arrays)])
    return pieces


def rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Matches of whole ranges: (size, first rank, how many, first sequence, offset in the sequence)."""
    left = {size: n for size, n in counts.items() if n}
    given = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first sequence, how many)
    opened, matches = 0, []
    while left:
        longest = max(left)
        if not any(room >= longest for room in gaps):
            # nothing holds the longest: open as many sequences as its class alone needs
            n = -(-left[longest] // (capacity // longest))
            gaps.setdefault(capacity, []).append((opened, n))
            opened += n
        waiting: list[tuple[int, int, int]] = []  # ranges of gaps seen so far, the smallest room last
        after: dict[int, list[tuple[int, int]]] = {}
        for size in sorted({*left, *gaps}, reverse=True):
            waiting += [(size, first, n) for first, n in gaps.get(size, ())]
            while waiting and left.get(size):
                room, first, n = waiting.pop()
                m = min(n, left[size])
                matches.append((size, given[size], m, first, capacity - room))
                given[size] += m
                left[size] -= m
                if room > size:
                    after.setdefault(room - size, []).append((first, m))
                if n > m:
                    waiting.append((room, first + m, n - m))
            if not left.get(size, 1):
                del left[size]
        for room, first, n in waiting:
            after.setdefault(room, []).append((first, n))
        gaps = {room: _joined(ranges) for room, ranges in after.items()}
    return matches


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, n in sorted(ranges):
        if out and sum(out[-1]) == first:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((first, n))
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2,
         vocabulary: str | None = None, specials: dict[str, int] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked for.

    A document is its ids and ``end_id``; null text is empty, so it is the end id alone. Documents longer than the capacity
    are cut into pieces of it, the first of which may be shorter. Pieces stand in their sequence without gaps from 0. Rows
    with equal or null keys are documents of their own; an empty table gives an empty table; texts are read whole.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    specials = {"<|endoftext|>": 50256} if specials is None else specials
    rows = keyed(docs, key, text).select("row", "key", F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    ids = ", ids array<int>" if with_ids else ""
    pieces = stored(rows.mapInArrow(
        _pieces(path, specials, end_id, capacity, with_ids),
        f"row long, key {kind}, piece int, start long, length long, ids_crc32 long{ids}"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = max(1, -(-max(counts.values(), default=0) // PART_ROWS))
    # ranks within a size: places in a part of the class, after the parts before
    part = F.pmod(F.xxhash64("row", "piece"), F.lit(parts)).cast("int")
    placed = pieces.withColumn("part", part)
    sizes = placed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("row", "piece")
    ranked = placed.withColumn("place", F.row_number().over(order) - 1).join(before, ["length", "part"])
    spark = docs.sparkSession
    matches = spark.createDataFrame(rounds(counts, capacity) or [(0, 0, 0, 0, 0)],
                                    "length long, first long, n long, sequence long, offset long")
    rank = F.col("before") + F.col("place")
    found = ranked.join(F.broadcast(matches), "length").where((rank >= F.col("first")) & (rank < F.col("first") + F.col("n")))
    return found.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                        (F.col("sequence") + rank - F.col("first")).alias("sequence_id"), "offset", *["ids"] * with_ids)
