"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

All ways to cut a text into pieces form a lattice. Forward filtering sums the weights of all ways to reach each place;
backward sampling then draws the last piece, the one before it and so on, each with its share of the weight that ends there,
so a segmentation is drawn with exactly its probability. Numbers are drawn from the row's key and the place in the text, so
a row is cut the same way wherever and whenever it is read.

No piece has a word mark inside, so the lattice falls apart into words; the different words of a few hundred kilobytes are
filtered together, place by place.
The vocabulary file has merge ranks, not probabilities; a piece of rank r weighs (r + 1) ** -sharpness, as word frequencies
fall with their rank. Characters without a piece are cut into byte pieces, and so is a word mark that the text itself holds;
that keeps decoding lossless.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkloom.llm import bytetext as B

MARK = "▁"
WORD = re.compile(rf"{MARK}|\n| *[^ \n{MARK}]+| +")
CHUNK_BYTES = 1 << 20  # texts whose words' lattices are built together: some 200 bytes for each character of a new word


class Vocabulary:
    def __init__(self, path: str, sharpness: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        rank = 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                # inside words only the first characters can be marks
                if MARK not in piece.lstrip(MARK):
                    self.pieces[piece] = (i, math.pow(rank + 1, -sharpness))
                rank += 1
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.pieces))
        self.byte_weight = math.pow(rank + 1, -sharpness)
        # the pieces by a hash of their characters, and a table that most other strings miss
        names = list(self.pieces)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        prefix = _prefix(_codes("".join(names)))
        ends = np.cumsum(lengths)
        hashes = B.range_hash(prefix, ends - lengths, ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([self.pieces[n][0] for n in names], np.int32)[order]
        self.weights = np.array([self.pieces[n][1] for n in names])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and the pieces' numbers in the sorted table."""
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        real = self.hashes[at] == hashes[some]
        return some[real], at[real]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Running sums over characters, for ``bytetext.range_hash``."""
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(B.mix(codes.astype(np.uint64) + np.uint64(1)) * B.powers(len(codes) + 1)[0][:len(codes)], out=out[1:])
    return out


class Lattice:
    """The lattices of many words at once; words are sorted by falling length.

    Node ``base[w] + j`` is the place after j characters of word w. ``sums[node, n - 1]`` is the weight of the ways to a node
    whose last piece has n characters or fewer, ``whole[node]`` that of all ways, and ``pieces[node, n - 1]`` the piece of n
    characters that begins there (below 0: the bytes of a character without a piece).
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = _codes("".join(words)).copy()
        ends = np.cumsum(lengths)
        word_of = np.repeat(np.arange(len(words)), lengths)
        # a mark of the text's own stands alone as a word and is no piece
        codes[(codes == ord(MARK))] = OWN_MARK
        codes[codes == 32] = ord(MARK)
        k = vocabulary.longest
        nodes = len(codes) + len(words)
        begins = np.arange(len(codes)) + word_of  # node before each character
        self.base = ends - lengths + np.arange(len(words))
        self.last = self.base + lengths
        prefix, left = _prefix(codes), ends[word_of] - np.arange(len(codes))
        found = []
        for n in range(1, k + 1):
            start = np.flatnonzero(left >= n)
            some, at = vocabulary.find(B.range_hash(prefix, start, start + n))
            found.append((begins[start[some]], at))
        k = max([1, *(n for n, (some, _) in enumerate(found, 1) if len(some))])  # longest piece in these words
        self.pieces = np.zeros((nodes, k), np.int32)
        weights = np.zeros((k, nodes))
        for n, (some, at) in enumerate(found[:k]):
            self.pieces[some, n] = vocabulary.ids[at]
            weights[n, some] = vocabulary.weights[at]
        lone = np.flatnonzero(weights[0, begins] == 0)
        self.pieces[begins[lone], 0] = -1 - codes[lone].astype(np.int64)
        size = 1 + (codes[lone] > 0x7F) + (codes[lone] > 0x7FF).astype(np.int64) + ((codes[lone] > 0xFFFF) & (codes[lone] != OWN_MARK))
        weights[0, begins[lone]] = vocabulary.byte_weight ** size
        total = np.zeros(nodes)
        total[self.base] = 1
        self.sums, self.whole = np.full((nodes, k), np.inf), np.ones(nodes)
        for j in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
            some = self.base[:np.searchsorted(-lengths, -j, "right")] + j
            run = np.zeros(len(some))
            for n in range(1, min(j, k) + 1):
                run = run + total[some - n] * weights[n - 1][some - n]
                self.sums[some, n - 1] = run
            self.whole[some] = total[some] = run
            tiny = some[run < 1e-200]
            for n in range(min(j, k) if len(tiny) else 0):  # only ratios between the last nodes matter
                total[tiny - n] *= 1e200


OWN_MARK = 0x110000  # no character


def _sample(words: list[str], first: np.ndarray, seeds: np.ndarray, text_of: np.ndarray, vocabulary: Vocabulary):
    """Ids of all words, and how many each has. ``first``: place of each word in its text."""
    different = sorted(set(words), key=len, reverse=True)
    number_of = {word: i for i, word in enumerate(different)}
    number = np.fromiter(map(number_of.__getitem__, words), np.int64, len(words))
    lattice = Lattice(different, vocabulary)
    node, start = lattice.last[number], lattice.base[number]
    counts = np.zeros(len(words), np.int64)
    active = np.arange(len(words))
    drawn = []
    while len(active):
        now = node[active]
        place = B.mix(seeds[text_of[active]] + B.mix((first[active] + now - start[active]).astype(np.uint64)))
        # below 1 by more than a product rounds
        drawn_weight = (place >> np.uint64(11)).astype(np.float64) / (1 << 53) * (1 - 2 ** -50) * lattice.whole[now]
        n = (lattice.sums[now] <= drawn_weight[:, None]).sum(axis=1) + 1
        before = now - n
        drawn.append((active, lattice.pieces[before, n - 1]))
        counts[active] += 1
        node[active] = before
        active = active[before != start[active]]
    ends = np.cumsum(counts)
    ids = np.empty(ends[-1] if len(ends) else 0, np.int32)
    for step, (some, piece) in enumerate(drawn):
        ids[ends[some] - 1 - step] = piece
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids, counts
    spelled = [list(map(vocabulary.byte_ids.__getitem__, (MARK if c == OWN_MARK else chr(c)).encode()))
               for c in (-1 - ids[lone]).tolist()]
    sizes = np.ones(len(ids), np.int64)
    sizes[lone] = [*map(len, spelled)]
    at = np.cumsum(sizes) - sizes
    out = np.repeat(ids, sizes)
    out[B.spread(at[lone], sizes[lone])] = [i for s in spelled for i in s]
    return out, np.add.reduceat(sizes, ends - counts)


def _encode(path: str, sharpness: float):
    def encode(batches: Iterator[pa.RecordBatch]):
        vocabulary = Vocabulary(path, sharpness)
        for batch, _, _ in B.chunks(batches, limit=CHUNK_BYTES):
            words, sizes = [], []
            for text in batch.column("text").to_pylist():
                found = WORD.findall(" " + text) if text else []
                words += found
                sizes.append(len(found))
            sizes = np.array(sizes, np.int64)
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            if words:
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                at = np.cumsum(lengths) - lengths
                heads = np.cumsum(sizes) - sizes
                text_of = np.repeat(np.arange(len(sizes)), sizes)
                ids, counts = _sample(words, at - at[np.minimum(heads, len(at) - 1)][text_of], seeds, text_of, vocabulary)
                totals = np.bincount(text_of, counts, len(sizes)).astype(np.int64)
            else:
                ids, totals = np.empty(0, np.int32), np.zeros(len(sizes), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(totals)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "key", "text")] + [listed],
                                             ["row", "key", "text", "ids"])
    return encode


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           sharpness: float = 1.0) -> DataFrame:
    """One row per input row: row, key, text, ids. A null text is empty, and an empty text has no ids.

    A text begins with a word mark of its own, which decoding takes off. Rows with equal keys and texts are cut alike; null
    keys share a seed. Texts are cut whole, whatever their length; an empty table gives an empty table.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(key)).alias("seed"))
    kind = dict(rows.dtypes)["key"]
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    return rows.mapInArrow(_encode(path, sharpness), f"row long, key {kind}, text string, ids array<int>")


SLICE_IDS = 200_000  # ids decoded together


def decode(rows: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows with the text of their ids as column ``decoded`` (null ids: null).

    Ids are decoded some hundred thousand at a time, whatever the size of a batch; of a longer single row all at once.
    """
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")

    def texts(batches: Iterator[pa.RecordBatch]):
        table = Vocabulary(path, 1.0).bytes_of
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        starts, spelled = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            counts = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, end in B.shares(np.append(0, np.cumsum(counts)), SLICE_IDS):
                part = batch.slice(at, end - at)
                listed = part.column(part.schema.get_field_index(ids))
                flat = listed.flatten().to_numpy(zero_copy_only=False)
                n, mine = sizes[flat], counts[at:end]
                data = spelled[B.spread(starts[flat], n)]
                ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(mine))]
                # a text begins with a mark of its own
                keep = np.ones(len(data), bool)
                keep[ends[:-1][np.diff(ends) > 0]] = False
                ends = np.append(0, np.cumsum(keep))[ends]
                made = pa.Array.from_buffers(pa.large_string(), end - at, [
                    None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])
                made = pc.if_else(listed.is_valid(), made, pa.scalar(None, pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "decoded"])

    return rows.mapInArrow(texts, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
