"""Byte-level BPE over a vocabulary of ranks, each distinct word of the corpus encoded once.

Texts are cut into pre-tokens, and these are exploded with their positions. Positions stay with their chunk of documents, as
numbers of the chunk's own list of words; the words themselves are shuffled, so that all chunks' occurrences of a word meet in
one bucket and each distinct word is encoded once there. Its ids go back to every chunk that asked, where texts are
reassembled by position. A word travels once for each chunk, however often it stands there, so frequent words are no burden.

Pre-tokens are found for a whole chunk at once from the class of each character (letter, number, white space, other). The
classes are read off the tiktoken library, which decides what is a letter.

Decoding joins ids with the table of token bytes, which has the size of the vocabulary, inside the tasks that hold the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from linkloom.llm import bytetext as B
from linkloom.llm import framed

CHUNK_BYTES = 12 << 20  # texts whose words share a list; one longer text is a chunk by itself
PIECE_BYTES = 1 << 20  # text in which pre-tokens are found together
TASK_BYTES = 64 << 20  # text for each task of a shuffle
SLICE_IDS = 1 << 18  # ids written or decoded together
LETTER, NUMBER, OTHER, SPACE = range(4)
# The letters after an apostrophe that are a pre-token with it.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def classes() -> np.ndarray:
    """The class of each code point, as the tiktoken library's patterns see it."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    alone = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        matched = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=alone, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(matched).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def pre_tokens(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts (in bytes) of the pre-tokens of the joined texts; each ends where the next one or its text ends.

    The pattern takes runs of letters, of numbers and of other characters, each with one space before it; an apostrophe that
    stands alone between them takes the letters of a contraction; white space before other characters leaves its last one.
    """
    if not len(data):
        return np.empty(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(codes)
    kind = classes()[codes]
    heads = np.searchsorted(at, np.unique(bounds[:-1][np.diff(bounds) > 0]))  # first character of each text
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= head[:-1]
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)
    of = kind[run]
    start = np.zeros(n + 1, bool)
    # white space: all of it before the end of a text, else its last character goes on its own or with what follows
    space = of == SPACE
    start[run[space]] = True
    start[end[space & ~head[end]] - 1] = True
    # other runs begin where they begin, or one space before
    plain = ~space
    after_space = np.zeros(len(run), bool)
    after_space[1:] = codes[run[1:] - 1] == 32
    after_space &= ~head[run]
    start[run[plain & ~after_space]] = True
    # contractions
    lone = np.flatnonzero((end - run == 1) & (codes[run] == ord("'")) & ~after_space & ~head[end])
    if len(lone):
        lone = lone[of[lone + 1] == LETTER]
        first, last = run[lone + 1], end[lone + 1]
        taken = np.isin(codes[first], [ord(c) for c in ONE_LETTER]).astype(np.int64)
        second = codes[np.minimum(first + 1, n - 1)]
        for a, b in TWO_LETTERS:
            taken[(codes[first] == ord(a)) & (second == ord(b)) & (last - first > 1)] = 2
        some = taken > 0
        first, last, taken = first[some], last[some], taken[some]
        start[first] = False
        more = last - first > taken
        start[first[more] + taken[more]] = True
    return at[np.flatnonzero(start[:n])]


ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _pieces(data: np.ndarray, bounds: np.ndarray, limit: int) -> np.ndarray:
    """Bounds of the texts, with more of them inside texts over ``limit`` bytes.

    A text may be cut before a single space between two plain letters or digits: a pre-token begins there, whatever is around.
    """
    out = [bounds]
    for i in np.flatnonzero(np.diff(bounds) > limit).tolist():
        text = data[bounds[i]:bounds[i + 1]]
        places = np.flatnonzero((text[1:-1] == 32) & ALNUM[text[:-2]] & ALNUM[text[2:]]) + 1
        # the first such place after every ``limit`` bytes
        found = np.searchsorted(places, np.arange(limit, len(text), limit))
        out.append(bounds[i] + places[np.unique(found[found < len(places)])])
    return np.sort(np.concatenate(out), kind="stable")


def _distinct(h1: np.ndarray, h2: np.ndarray, times: np.ndarray | None = None):
    """Of equal pairs of hashes: a place of each, how often it stands (``times`` each), and the number of every pair."""
    order = np.lexsort((h2, h1))
    new = B.runs_of(h1[order], h2[order])
    size = np.diff(np.append(new, len(order)))
    number = np.empty(len(order), np.uint32)
    number[order] = np.repeat(np.arange(len(new), dtype=np.uint32), size)
    count = size if times is None else np.add.reduceat(times[order], new) if len(new) else size
    return order[new], count, number


class Chunk:
    """Documents whose words share a list. Of a text nothing stays but its distinct words, a megabyte of text at a time."""

    def __init__(self):
        self.size, self.rows, self.keys, self.counts = 0, [], [], []
        self.parts: list[tuple] = []  # per piece of text: hashes, counts and lengths of its words, their bytes, numbers

    def add(self, batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> None:
        cuts = _pieces(data, bounds, PIECE_BYTES)
        sizes = []
        for lo, hi in B.shares(cuts, PIECE_BYTES):
            part, at = data[cuts[lo]:cuts[hi]], cuts[lo:hi + 1] - cuts[lo]
            starts = pre_tokens(part, at)
            sizes.append(np.diff(np.searchsorted(starts, at)))
            ends = np.append(starts[1:], len(part))[:len(starts)]
            h1, h2 = (B.sure_hash(part, starts, ends, seed) for seed in (0, 1))
            place, count, number = _distinct(h1, h2)
            lengths = (ends - starts)[place]
            self.parts.append((h1[place], h2[place], count, lengths, part[B.spread(starts[place], lengths)], number))
        text = np.searchsorted(bounds, cuts[:-1], "right") - 1
        self.counts.append(np.bincount(np.minimum(text, len(bounds) - 2), np.concatenate(sizes), len(bounds) - 1).astype(np.int64))
        self.rows.append(np.array(batch.column("row").to_numpy(zero_copy_only=False)))
        self.keys.append(batch.column("key").take(pa.array(np.arange(len(batch)))))  # a copy: the batch can go
        self.size += len(data)

    def packed(self, buckets: int) -> pa.RecordBatch:
        """One row: the chunk's number, rows, keys, packed numbers of all words; its distinct words by bucket, packed."""
        h1, h2, times, lengths = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        data = np.concatenate([p[4] for p in self.parts])
        starts = np.cumsum(lengths) - lengths
        place, count, number = _distinct(h1, h2, times)
        rank = np.argsort(-count, kind="stable")  # the most frequent first: their numbers are short
        of = np.empty(len(rank), np.uint32)
        of[rank] = np.arange(len(rank), dtype=np.uint32)
        number, place = of[number], place[rank]
        heads = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        numbers = np.concatenate([number[h:][p[5]] for h, p in zip(heads, self.parts)])
        counts, rows = np.concatenate(self.counts), np.concatenate(self.rows)
        told = framed.pack([counts.astype("<i4")], _planes(numbers), np.zeros(len(counts), np.int64))
        bucket = (h1[place] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # rising numbers in each bucket
        new = B.runs_of(bucket[order])
        blocks = []
        for lo, hi in zip(new, np.append(new[1:], len(order))):
            some = order[lo:hi]
            first, length = starts[place[some]], lengths[place[some]]
            blocks.append(framed.pack([np.diff(some, prepend=0).astype("<i4")], data[B.spread(first, length)].tobytes(), length))
        keys = pa.concat_arrays(self.keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[:1]), *(pa.ListArray.from_arrays([0, len(rows)], c) for c in (pa.array(rows), keys)),
             pa.array([told], pa.binary()), pa.array([bucket[order][new].tolist()], pa.list_(pa.int64())),
             pa.array([blocks], pa.list_(pa.binary()))], ["chunk", "rows", "keys", "told", "buckets", "blocks"])


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by byte, the lowest first: the high bytes of frequent words are alike."""
    return numbers.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: np.ndarray) -> np.ndarray:
    return data.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _chunked(buckets: int, chunk_bytes: int):
    def chunk(batches: Iterator[pa.RecordBatch]):
        now = Chunk()
        for batch, data, bounds in B.chunks(batches, limit=PIECE_BYTES):
            if now.size and now.size + len(data) > chunk_bytes:
                yield now.packed(buckets)
                now = Chunk()
            now.add(batch, data, bounds)
        if now.rows:
            yield now.packed(buckets)
    return chunk


def _exploded(batches: Iterator[pa.RecordBatch]):
    """The words of a chunk, one row for each bucket."""
    for batch in batches:
        chunks = batch.column("chunk").to_pylist()
        for i, chunk in enumerate(chunks):
            buckets, blocks = batch.column("buckets")[i].values, batch.column("blocks")[i].values
            yield pa.RecordBatch.from_arrays([buckets, pa.array([chunk] * len(buckets), pa.int64()), blocks], ["bucket", "chunk", "block"])


def _solver(path: str):
    def solve(batches: Iterator[pa.RecordBatch]):
        """Each distinct word of a bucket is encoded once; its ids go to all chunks that asked."""
        encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path),
                                   special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            out = []
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if bucket != now:
                    known.clear()
                    now = bucket
                (gaps,), data, lengths = framed.unpack(block, ["<i4"])
                data, ends = data.tobytes(), np.cumsum(lengths, dtype=np.int64)
                ids = []
                for a, b in zip((ends - lengths).tolist(), ends.tolist()):
                    word = data[a:b]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encode(word)
                    ids.append(found)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for some in ids for i in some), "<u4", int(sizes.sum()))
                out.append(framed.pack([gaps], flat.tobytes(), sizes * 4))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["chunk", "block"])
    return solve


def _reassemble(chunks: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a chunk's texts, from its words' numbers and the ids of its words."""
    parts = [framed.unpack(b, ["<i4"]) for b in words.column("block").to_pylist()]
    number = np.concatenate([np.cumsum(p[0][0], dtype=np.int64) for p in parts]) if parts else np.empty(0, np.int64)
    sizes = np.concatenate([p[2] for p in parts]).astype(np.int64) // 4 if parts else np.empty(0, np.int64)
    ids = np.concatenate([p[1] for p in parts]).view("<u4") if parts else np.empty(0, "<u4")
    at = np.empty(len(number), np.int64)
    size = np.empty(len(number), np.int64)
    at[number], size[number] = np.cumsum(sizes) - sizes, sizes
    key_kind = chunks.schema.field("keys").type.value_type
    made = []
    for i in range(chunks.num_rows):
        (counts,), planes, _ = framed.unpack(chunks.column("told")[i].as_py(), ["<i4"])
        numbers = _from_planes(planes)
        first = np.append(0, np.cumsum(counts, dtype=np.int64))
        rows, keys = chunks.column("rows")[i].values, chunks.column("keys")[i].values
        for lo, hi in B.shares(first, SLICE_IDS):
            some = numbers[first[lo]:first[hi]]
            flat = ids[B.spread(at[some], size[some])]
            ends = np.append(0, np.cumsum(size[some]))[first[lo:hi + 1] - first[lo]]
            offsets = (4 * ends).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
            made.append(pa.table({"row": rows[lo:hi], "key": keys[lo:hi].cast(key_kind), "ids": packed.cast(pa.binary())}))
    kinds = pa.schema([("row", pa.int64()), ("key", key_kind), ("ids", pa.binary())])
    return pa.concat_tables(made) if made else kinds.empty_table()


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: row (its place), key, ids (binary: unsigned 32-bit little-endian numbers).

    The ids are those of the tiktoken library without special tokens: their strings are ordinary text. Null and empty texts
    have no ids. Texts are read whole, whatever their length; rows may repeat keys or have none; an empty table gives an
    empty table. Other columns of the input are not looked at, so their names clash with nothing.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # both readers below take all columns of this exchange, so Spark makes it once
    chunks = rows.mapInArrow(
        _chunked(tasks, chunk_bytes), f"chunk long, rows array<long>, keys array<{kind}>, told binary, buckets array<long>, "
        "blocks array<binary>").repartition(tasks, "chunk")
    words = chunks.mapInArrow(_exploded, "bucket long, chunk long, block binary").repartition(tasks, "bucket").sortWithinPartitions(
        "bucket").mapInArrow(_solver(path), "chunk long, block binary")
    return chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(
        _reassemble, f"row long, key {kind}, ids binary")


def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, joined; where each id's bytes begin, and how many they are (-1: no such id)."""
    ranks = sorted(ranks_of(path).items(), key=lambda item: item[1])
    sizes = np.full(ranks[-1][1] + 1, -1, np.int64)
    sizes[[rank for _, rank in ranks]] = [len(token) for token, _ in ranks]
    real = np.maximum(sizes, 0)
    return np.frombuffer(b"".join(token for token, _ in ranks), np.uint8), np.cumsum(real) - real, sizes


def decode(rows: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows with the bytes of their ids (in the form of ``encode``) as column ``decoded``; null ids: null.

    Ids need not be those of whole characters. An id that the vocabulary does not have is an error.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def spell(batches: Iterator[pa.RecordBatch]):
        table, at, size = token_table(path)
        for batch, data, bounds in B.chunks(batches, ids, 4 * SLICE_IDS):
            out = []
            for a in range(0, len(data), 4 * SLICE_IDS):  # more than one slice: a single long text
                some = data[a:a + 4 * SLICE_IDS].view("<u4").astype(np.int64)
                if len(some) and (some.max() >= len(size) or size[some].min() < 0):
                    raise ValueError("an id that the vocabulary does not have")
                out.append((table[B.spread(at[some], size[some])], size[some]))
            spelled = np.concatenate([o[0] for o in out]) if out else np.empty(0, np.uint8)
            ends = np.append(0, np.cumsum(np.concatenate([o[1] for o in out]) if out else np.empty(0, np.int64)))[bounds // 4]
            column = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(spelled.tobytes())])
            real = batch.column(batch.schema.get_field_index(ids)).is_valid()
            column = pc.if_else(real, column, pa.scalar(None, pa.large_binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(spell, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))
