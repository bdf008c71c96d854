"""How five filters interact, for every order in which they can be applied.

What a filter removes at a step depends on the filters before it only as a set, so everything follows from the 32 coalitions
of filters: how many documents each coalition removes. Documents are reduced to the set of filters they fail (a mask) and
counted by part and mask; that table, 32 rows a part at most, is all that the rest reads.

Step counts are differences of coalitions. The shares of the filters are Shapley values, found as the exact solution of a
constrained least squares problem: an additive model of the coalition removals, weighted by the Shapley kernel, whose values
must sum to what all filters remove together. Its normal equations are solved in rationals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import bytetext as B
from linkloom.llm.tables import stored

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")  # the filter that looks at other documents
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[bounds])


def _mark(min_words: int, distinct_percent: int, capital_percent: int):
    def mark(batches: Iterator[pa.RecordBatch]):
        """The filters A to D that each text fails, and the identity of the text for E."""
        for batch, data, bounds in B.chunks(batches):
            starts, ends, firsts = B.words(data, bounds)
            n = np.diff(firsts)
            text = np.repeat(np.arange(len(n)), n)
            word = B.mix(B.sure_hash(data, starts, ends) + B.mix(text.astype(np.uint64)))
            distinct = np.bincount(text[np.unique(word, return_index=True)[1]], minlength=len(n))
            chars = _per_text((data & 0xC0) != 0x80, bounds)
            fails = ((n < min_words) + 2 * (100 * distinct < distinct_percent * n)
                     + 4 * (100 * _per_text(CAPITAL[data], bounds) > capital_percent * chars)
                     + 8 * (_per_text(MARKS[data], bounds) > 0))
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part"), pa.array(fails.astype(np.int32)), pa.array(digests, pa.binary())],
                ["key", "part", "mask", "digest"])
    return mark


def tally(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
          min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> DataFrame:
    """Documents by part and the set of filters they fail: columns part, mask (bit 0: A), n, good, toxic.

    A: fewer than ``min_words`` words; B: different words under ``distinct_percent`` of the words; C: more than
    ``capital_percent`` of the code points are A-Z; D: any of ``#$%&*|``; E: the same text under a smaller key. Null texts and
    parts are empty; an empty text has no words and fails A (and E, unless its key is the smallest). Rows that repeat a key
    are rows of their own and no copies of each other; a row without a key has no smaller one and no label. Labels that
    repeat a key count once, as good or toxic if any of them is. Texts are read whole. Other columns are not looked at. An
    empty table gives an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = rows.mapInArrow(_mark(min_words, distinct_percent, capital_percent), "key long, part string, mask int, digest binary")
    # rows without a key are dealt by their text, so that they do not meet in one task
    alone = F.when(F.col("key").isNull(), F.col("digest")).otherwise(F.lit(b""))
    marks = marks.groupBy("key", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")).withColumn("alone", alone)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("alone", F.lit(b""))
    marks = marks.withColumn("place", F.coalesce("key", F.lit(0)))
    marks = stored(marks.join(known.withColumnRenamed("key", "place"), ["place", "alone"], "left").select(
        "key", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))
    # every row with a key counts as a copy first; then those with the smallest key of their text are taken back
    keyed = F.col("key").isNotNull()
    every = marks.select("part", F.when(keyed, F.col("mask") + COPY).otherwise(F.col("mask")).alias("mask"), "n", "good", "toxic")
    first = marks.where(keyed).groupBy("digest", "key", "mask", "good", "toxic").agg(
        F.collect_list(F.struct("part", "n")).alias("parts"))  # rows of one key with one text, by part
    first = first.groupBy("digest").agg(F.min(F.struct("key", "mask", "good", "toxic", "parts")).alias("of")).select(
        "of.mask", "of.good", "of.toxic", F.inline("of.parts"))
    back = first.select("part", "good", "toxic", F.inline(F.array(
        F.struct((F.col("mask") + COPY).alias("mask"), (-F.col("n")).alias("n")), F.struct("mask", "n"))))
    return every.unionByName(back).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]).where("n > 0")


class Shares:
    """Shapley values of a game of ``n`` players as the exact solution of its weighted least squares problem.

    The values x minimise sum w(S) * (v(S) - sum of x over S) ** 2 over all coalitions S but the empty and the whole one,
    where w(S) = (n - 1) / (C(n, |S|) * |S| * (n - |S|)), and sum to v(whole). With a multiplier for that condition the
    normal equations are n + 1 linear ones; their matrix is the same for all games and is inverted once.
    """

    def __init__(self, n: int):
        self.n = n
        self.weight = {s: Fraction(n - 1, math.comb(n, size) * size * (n - size)) for s in range(1, (1 << n) - 1)
                       if (size := s.bit_count())}
        rows = [[sum((w for s, w in self.weight.items() if s >> i & s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)]
                for i in range(n)] + [[Fraction(1)] * n + [Fraction(0)]]
        self.inverse = _inverse(rows)

    def of(self, removed: list[int]) -> list[Fraction]:
        """``removed[S]``: the value of coalition S, 0 for the empty one."""
        right = [sum((w * removed[s] for s, w in self.weight.items() if s >> i & 1), Fraction(0)) for i in range(self.n)]
        right.append(Fraction(removed[-1]))
        return [sum((a * b for a, b in zip(row, right)), Fraction(0)) for row in self.inverse[:self.n]]


def _inverse(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    n = len(matrix)
    rows = [[*row, *(Fraction(i == j) for j in range(n))] for i, row in enumerate(matrix)]
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [row[n:] for row in rows]


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _steps(counts: dict[int, tuple[int, int, int]], shares: Shares, letters: str):
    """(order, step, counts) of one part, for every order of its filters."""
    n = len(letters)
    # what each coalition removes: documents that fail any of its filters; all, good and toxic ones
    removed = [[sum(c[of] for mask, c in counts.items() if mask & s) for s in range(1 << n)] for of in range(3)]
    total = sum(c[0] for c in counts.values())
    orders = math.factorial(n)
    shapley = [int(orders * x) for x in shares.of(removed[0])]  # the sum over all orders is whole
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here, good, toxic = (r[after] - r[before] for r in removed)
            yield ("".join(letters[j] for j in order), step, total - removed[0][after], here, removed[0][1 << i] - here,
                   counts.get(1 << i, (0,))[0], good, toxic, shapley[i])
            before = after


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of filters and step, from the columns part, mask, n, good, toxic.

    Columns: part, filter_order, step, kept (after the step), removed (at it), redundant (failing the step's filter, but
    removed before), unique_fails (failing that filter only), good_lost, toxic_lost, shapley (removed by that filter, summed
    over all orders). A part has at most one input row per mask; no parts give no rows.
    """
    def expand(batches: Iterator[pa.RecordBatch]):
        shares = Shares(len(letters))
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
                rows = list(zip(*_steps({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}, shares, letters)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows[0])), pa.array(rows[0]), pa.array(rows[1], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in rows[2:]]], ["part", "filter_order", "step", *COUNTS])

    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return masks.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
