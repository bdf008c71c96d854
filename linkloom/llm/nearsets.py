"""Near copies by a chosen-path set similarity join, confirmed on full shingle sets.

Every document has a signature of minwise values of its shingle set; documents with equal sets are one. A tree starts with
all documents and branches them by the value at a coordinate it selects (on average 1 / similarity coordinates, so a pair
that similar is expected to stay together on one branch); nodes with one document are dropped, small nodes are compared
exhaustively by signature, and large nodes are branched again. A large node is also dealt into small parts that all hold a
few random pivots of the node, so a crowd of copies, which no coordinate takes apart, is found without meeting in one task. What
is then still large is compared block by block, until every two documents of the node have been compared or are connected.
Independent trees are repeated until the expected recall is reached.

Comparing only joins documents into candidate groups. In each group, sets are then built from the full texts and searched
exactly: from a document on to those it links with, comparing each only with documents not reached yet. Only links between
groups of documents are made, so neither a node nor a group gives all its pairs. A group of more text than a task should
hold is dealt into parts that all share blocks of its documents, until what is not connected has met all of the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import bytetext as B
from linkloom.llm.tables import keyed_once, numbered, quoted, read_from, stored

COORDINATES = 64
NEAR = 0.6  # share of equal coordinates from which two documents are candidates: 7 deviations below a similarity of 0.85
LEAF = 256  # documents of a node that are compared with each other
PIVOTS = 8
BLOCK = 1024  # documents of a node that DEPTH levels leave large, in a block that meets all of the node
DEPTH = 4
GROUP_BYTES = 8 << 20  # text of a candidate group that one task searches


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit values of each text's shingles, and the bounds of the texts in them."""
    data = B.LOWER[data]
    starts, ends, firsts = B.words(data, bounds)
    words = B.range_hash(B.prefix_hash(data), starts, ends)
    shingles = B.sequence_hash(words, size)
    counts = np.diff(firsts)
    inside = B.spread(firsts[:-1], np.maximum(counts - size + 1, 0))
    sizes = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))  # too short for a shingle: all words as one
    sizes[short] = 1
    at = np.append(0, np.cumsum(sizes))
    values = np.empty(at[-1], np.uint64)
    place = np.ones(at[-1], bool)
    place[at[short]] = False
    values[place] = shingles[inside]
    for text in short.tolist():
        n = int(counts[text])
        values[at[text]] = B.sequence_hash(words[firsts[text]:firsts[text] + n], n, n)[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    heads = at[:-1][sizes > 0]
    new[heads] = True
    return values[new], np.append(0, np.cumsum(new))[at]


def _signatures(size: int):
    seeds = B.mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]):
        for batch, data, bounds in B.chunks(batches):
            values, at = shingle_sets(data, bounds, size)
            n = np.diff(at)
            some = np.flatnonzero(n)
            signature = np.zeros((len(n), COORDINATES), np.int32)
            identity = np.zeros((2, len(n)), np.int64)
            if len(some):
                heads = at[:-1][some]
                for i in range(COORDINATES):
                    least = np.minimum.reduceat((values ^ seeds[i]) * (seeds[COORDINATES + i] | np.uint64(1)), heads)
                    signature[some, i] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for i in range(2):
                    identity[i, some] = np.add.reduceat(B.mix(values ^ seeds[i]), heads).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES),
                                              pa.array(signature.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"), pa.array(n.astype(np.int64)), pa.array(identity[0]),
                 pa.array(identity[1]), listed], ["row", "key", "n", "s1", "s2", "signature"])
    return sign


def trees_for(similarity: float, recall: float) -> int:
    """Trees until a pair of this similarity has met with this probability, taking a path of DEPTH nodes for each.

    With 1 / similarity branches on average a pair stays together on a path of d nodes with a chance of at least 1 / (1 + d / 2).
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - 1 / (1 + DEPTH / 2)))


def _branched(rows: DataFrame, level: int, trees: int, similarity: float) -> DataFrame:
    """Children of the rows' nodes: columns node, row, signature. A second coordinate is taken as often as needed on average."""
    second = 1 / similarity - 1
    if level == 0:
        rows = rows.withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(trees)).cast("array<long>")))
    pick = F.xxhash64("node", F.lit(level))
    one = F.pmod(pick, F.lit(COORDINATES)).cast("int")
    more = F.pmod(F.shiftrightunsigned(pick, 20), F.lit(1000)) < int(1000 * second)
    other = F.pmod(F.shiftrightunsigned(pick, 32), F.lit(COORDINATES)).cast("int")
    coordinate = F.explode(F.when(more & (other != one), F.array(one, other)).otherwise(F.array(one)))
    rows = rows.withColumn("coordinate", coordinate)
    value = F.get("signature", F.col("coordinate"))
    return rows.select(F.xxhash64("node", "coordinate", value, F.lit(level)).alias("node"), "row", "signature")


def _compare(batches: Iterator[pa.RecordBatch]):
    """Within each part: links (row, smaller row) that join documents with similar signatures, no more than documents."""
    def solve(rows: np.ndarray, signatures: np.ndarray):
        left, links = np.arange(len(rows)), []
        while len(left):
            reached, left = [left[0]], left[1:]
            root = rows[reached[0]]
            while reached and len(left):
                near = (signatures[left] == signatures[reached.pop()]).sum(axis=1) >= NEAR * COORDINATES
                links += [(int(r), int(root)) for r in rows[left[near]] if r != root]
                reached += left[near].tolist()
                left = left[~near]
        return links

    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush(last: bool):
        if not kept:
            return []
        part, rows, signatures = (np.concatenate([k[i] for k in kept]) for i in range(3))
        new = B.runs_of(part)
        ends = np.append(new[1:], len(part))
        kept.clear()
        if not last and len(new):  # the last part may go on in the next batch
            kept.append((part[new[-1]:], rows[new[-1]:], signatures[new[-1]:]))
            new, ends = new[:-1], ends[:-1]
        return [link for a, b in zip(new.tolist(), ends.tolist()) if b - a > 1 for link in solve(rows[a:b], signatures[a:b])]

    def out(links):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
                                          ["a", "b"])

    for batch in batches:
        part, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "row"))
        flat = batch.column("signature").flatten().to_numpy(zero_copy_only=False)
        kept.append((part, row, flat.reshape(len(part), COORDINATES)))
        yield out(flush(False))
    yield out(flush(True))


def _candidates(signed: DataFrame, trees: int, similarity: float) -> DataFrame:
    """What links between documents with near signatures that met in a node connect: (a, b) for every document a but the
    smallest b of its component; ``signed`` has row, signature."""
    links, rows = None, signed
    for level in range(DEPTH):
        children = _branched(rows, level, trees, similarity)
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        nodes = stored(children.drop("signature").join(sizes, "node"))
        members = nodes.join(signed, "row")
        parts = F.ceil(F.col("size") / LEAF).cast("int")
        own = F.pmod(F.xxhash64("row"), parts)
        pivot = (parts > 1) & (F.pmod(F.xxhash64("row", "node"), F.ceil(F.col("size") / PIVOTS)) == 0)
        dealt = members.withColumn("number", F.explode(
            F.when(pivot, F.sequence(F.lit(0), parts - 1).cast("array<long>")).otherwise(F.array(own.cast("long")))))
        # pivots first: the parts of a node link its documents with the same ones
        found = dealt.select(F.xxhash64("node", "number").alias("part"), "row", "signature", pivot.alias("lead")).repartition(
            "part").sortWithinPartitions("part", F.desc("lead"), "row").mapInArrow(_compare, "a long, b long").distinct()
        links = found if links is None else links.unionByName(found)
        rows = members.where(F.col("size") > LEAF).select("node", "row", "signature")
        if rows.isEmpty():
            return connected(links).select(F.col("row").alias("a"), F.col("root").alias("b"))
    # no coordinate took these nodes apart: all that is not connected in them is compared, block by block
    members = rows.select(F.col("node").alias("root"), "row", F.lit(1).cast("long").alias("size"))
    return _large_links(stored(members), signed, _compare, BLOCK, links)


def connected(links: DataFrame) -> DataFrame:
    """Columns row, root: the smallest row that each linked row reaches, by alternating large and small stars.

    A star makes no more links than it is given. All is done when every row has one link to a smaller row, and that has none.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def large(pairs: DataFrame) -> DataFrame:
        """Larger neighbours of b hang below the least of all neighbours of b and itself."""
        sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
        return stored(pairs.join(least, "b").select("a", F.least("b", "least").alias("b")).distinct())

    def small(pairs: DataFrame) -> DataFrame:
        """a and its smaller neighbours hang below the least of them."""
        least = pairs.groupBy("a").agg(F.min("b").alias("least"))
        return stored(pairs.join(least, "a").select(
            F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct())

    def settled(pairs: DataFrame) -> bool:
        ends = pairs.select(F.explode(F.array(
            F.struct(F.col("a").alias("row"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("b").alias("row"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("end")).select("end.*")
        ups = ends.groupBy("row").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ups.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()

    while not settled(links):
        links = small(large(links))
    return links.select(F.col("a").alias("row"), F.col("b").alias("root"))


def _linked(size: int, percent: int):
    def search(rows: np.ndarray, values: np.ndarray, at: np.ndarray):
        """Links (row, root) of documents connected by similar sets."""
        sizes = np.diff(at)
        left, links = np.arange(len(rows)), []
        while len(left):
            reached, left = [left[0]], left[1:]
            root = int(rows[reached[0]])
            while reached and len(left):
                one = reached.pop()
                mine = values[at[one]:at[one + 1]]
                fits = (100 * sizes[left] >= percent * sizes[one]) & (100 * sizes[one] >= percent * sizes[left])
                some = left[fits & (sizes[left] > 0)]
                if not len(some) or not len(mine):
                    continue
                theirs = values[B.spread(at[some], sizes[some])]
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                shared = np.add.reduceat(hit, np.cumsum(sizes[some]) - sizes[some])
                near = 100 * shared >= percent * (sizes[some] + sizes[one] - shared)
                links += [(int(r), root) for r in rows[some[near]]]
                reached += some[near].tolist()
                left = left[~np.isin(left, some[near])]
        return links

    def link(batches: Iterator[pa.RecordBatch]):
        def solve(held):
            rows = np.array([r for r, _ in held], np.int64)
            texts = [t.encode() for _, t in held]
            bounds = np.append(0, np.cumsum([*map(len, texts)]))
            values, sizes = [], []
            for lo, hi in B.shares(bounds):
                some, at = shingle_sets(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), bounds[lo:hi + 1] - bounds[lo], size)
                values.append(some)
                sizes.append(np.diff(at))
            return search(rows, np.concatenate(values), np.append(0, np.cumsum(np.concatenate(sizes))))

        held, now, found = [], None, []
        for batch in batches:
            for part, row, text in zip(*[batch.column(c).to_pylist() for c in ("part", "row", "text")]):
                if part != now and held:
                    found += solve(held)
                    held = []
                now = part
                held.append((row, text))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
            found = []
        if held:
            found = solve(held)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
    return link


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 85,
                recall: float = 0.99) -> DataFrame:
    """One row per input row: row, doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of ``words``-word shingles (A-Z in lower case) have ``percent`` of their union in
    common; component_id is the smallest key that links lead to, itself included, and the first row of that key is kept. Texts
    with fewer words have their whole sequence as one shingle. Null and empty texts have no shingles and are linked with
    nothing; null keys come after all others. Equal sets are always linked, repeated rows too. ``recall`` is that of a single
    pair; in a group every further link adds to it. An empty table gives an empty table; texts are read whole.
    """
    return _grouped(keyed_once(docs, key, text, copy=True).select("row", "key", F.col(quoted(text)).alias("text")), words, percent, recall)


def _grouped(rows: DataFrame, words: int, percent: int, recall: float) -> DataFrame:
    kind = dict(rows.dtypes)["key"]
    signed = stored(rows.mapInArrow(
        _signatures(words), f"row long, key {kind}, n long, s1 long, s2 long, signature array<int>"))
    same = ["n", "s1", "s2"]
    first = stored(signed.where("n > 0").groupBy(*same).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")))
    alone = signed.join(first.select(F.col("first").alias("row")), "row", "left_semi").select("row", "signature")
    roots = _candidates(stored(alone), trees_for(percent / 100, recall), percent / 100).toDF("row", "root")
    groups = roots.unionByName(roots.select(F.col("root").alias("row"), "root").distinct())
    with_text = rows.select("row", "text").join(groups, "row")
    # a group of more text than a task should hold is compared block by block
    bytes_of = stored(with_text.groupBy("root").agg(F.sum(F.octet_length("text")).alias("bytes")))
    large = bytes_of.where(F.col("bytes") > GROUP_BYTES).select("root")
    small = with_text.join(large, "root", "left_anti").select(F.col("root").alias("part"), "row", "text")
    link = _linked(words, percent)
    # a group is searched as a whole, so a row is linked once, with the row that names its component
    links = small.repartition("part").sortWithinPartitions("part").mapInArrow(link, "a long, b long")
    if not large.isEmpty():
        texts = with_text.join(large, "root").select("root", "row", F.octet_length("text").cast("long").alias("size"), "text")
        texts = stored(texts)
        links = links.unionByName(_large_links(texts.select("root", "row", "size"), texts.select("row", "text"), link, GROUP_BYTES // 2))
    root = links.toDF("row", "root")
    order = F.struct(F.col("key").isNull(), "key", "row")
    named = signed.drop("signature").join(first.where("rows > 1").drop("rows"), same, "left").withColumn(
        "first", F.coalesce("first", "row")).join(root.withColumnRenamed("row", "first"), "first", "left").withColumn(
        "root", F.coalesce("root", "first"))
    named = stored(named.drop("s1", "s2"))
    least = stored(named.groupBy("root").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    named = named.join(least, "root", "left")
    lone = F.col("least").isNull()
    return named.select("row", F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.when(lone, F.col("key")).otherwise(F.col("least.key")).alias("component_id"),
                        (lone | (F.col("row") == F.col("least.row"))).alias("kept"))


def _large_links(members: DataFrame, content: DataFrame, link, half: int, known: DataFrame | None = None) -> DataFrame:
    """What links of groups that are too large for a task connect, the links ``known`` included: (a, b) for every row a but the
    smallest b of its component; ``members`` has root, row, size, ``content`` what ``link`` compares.

    Each turn takes blocks of a group's documents, of the size ``half`` each (half of what a task should hold), and compares them with all of the group, which
    is dealt into parts of the same size: all links of these documents are then known. What is not connected with most of
    the group is left for the next turn, with twice as many blocks at once. In the end every two documents of a group
    have been compared or are connected, so nothing depends on chance. Links become components at once: the next turn's are
    links between these, and only where they differ.
    """
    state = members.select("root", "row", "size", F.lit(False).alias("done"))
    none = members.select(F.col("row").alias("a"), F.col("row").alias("b")).limit(0)
    roots = (none.toDF("row", "component") if known is None else connected(known).withColumnRenamed("root", "component"))
    turn = 0
    while True:
        left = stored(state.join(roots, "row", "left").withColumn("component", F.coalesce("component", "row")))
        sums = left.groupBy("root", "component").agg(F.sum("size").alias("bytes"))
        most = sums.groupBy("root").agg(F.max(F.struct("bytes", "component")).alias("most"), F.sum("bytes").alias("bytes"))
        state = left.join(most, "root").withColumn("open", ~F.col("done") & (F.col("component") != F.col("most.component")))
        open_bytes = state.where("open").groupBy("root").agg(F.sum("size").alias("open_bytes"))
        blocks = F.ceil(F.col("open_bytes") / half).cast("int")
        block = F.pmod(F.xxhash64("row", F.lit(turn)), F.col("blocks")).cast("int")
        state = stored(state.join(open_bytes, "root").withColumn("blocks", blocks).select(
            "root", "row", "size", "done", F.ceil(F.col("bytes") / half).cast("int").alias("parts"),
            F.least("blocks", F.lit(1 << turn)).alias("taken"),
            F.when(F.col("open") & (block < (1 << turn)), block).alias("block")))
        if state.isEmpty():
            return roots.toDF("a", "b")
        # a document is in its own part beside each block, and in its block beside each part
        own = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
        beside = lambda n, pair: F.transform(F.sequence(F.lit(0), n - 1), pair)
        places = F.array_union(
            beside(F.col("taken"), lambda i: F.struct(own.alias("part"), i.alias("block"))),
            F.when(F.col("block").isNull(), F.array().cast("array<struct<part:int,block:int>>")).otherwise(
                beside(F.col("parts"), lambda i: F.struct(i.alias("part"), F.col("block").alias("block")))))
        # the block first: all parts beside it link their documents with the same ones
        lead = F.coalesce(F.col("block") == F.col("place.block"), F.lit(False)).alias("lead")
        dealt = state.select("row", "root", "block", F.explode(places).alias("place")).select(
            "row", F.xxhash64("root", "place.part", "place.block").alias("part"), lead)
        found = content.join(dealt, "row").repartition("part").sortWithinPartitions("part", F.desc("lead"), "row").mapInArrow(
            link, "a long, b long").distinct()
        for side in ("a", "b"):
            found = found.join(roots.withColumnsRenamed({"row": side, "component": "of"}), side, "left").withColumn(
                side, F.coalesce("of", side)).drop("of")
        moved = connected(found)
        if not moved.isEmpty():
            further = roots.join(moved.withColumnRenamed("row", "component"), "component", "left").select(
                "row", F.coalesce("root", "component").alias("component"))
            roots = stored(further.unionByName(moved.withColumnRenamed("root", "component")))
        state = state.select("root", "row", "size", (F.col("done") | F.col("block").isNotNull()).alias("done"))
        turn += 1


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
              recall: float = 0.99) -> DataFrame:
    """The input rows that are kept, with all their columns: one of each group."""
    rows = numbered(docs, copy=True)
    texts = read_from(rows, key, text).select("row", "key", F.col(quoted(text)).alias("text"))
    stay = _grouped(texts, words, percent, recall).where("kept").select("row")
    return rows.join(stay, "row", "left_semi").select("doc.*")
