"""Related links: exact top-k by weighted shared items, for all links at once.

Every link carries items (its tags, its collection) with weights; the score of two links is the sum
of the weights they share. Pairs are only built inside items of bounded size. An item that many
links share is never paired up: links that share sets of such items are grouped, and of each big
group only its k+1 first members (in tie-break order) can ever be in a top-k, because everything in
the group that precedes them scores at least as much. Groups that shrink below the bound are paired.
The answer is the same as that of the full self join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.strings import wikilink_slug
from linkloom.operators.changes import number_rows
from linkloom.operators.relational import tags_of
from linkloom.session import ensure_checkpoint_dir

# largest group of links that is paired up directly: bounds the pairs at HOT_DEGREE per edge
HOT_DEGREE = 1000
# copies of a big group's short list, so that its members meet it in many tasks
SALTS = 32
# most items of a link that its rows carry along
WIDE_LINK = 64

# items of pairs that are compared at once
PAIR_CELLS = 1 << 21

Weigh = Callable[[Column], Column]


def plain_weight(shared: Column) -> Column:
    """Score of an array of shared items: one each."""
    return F.size(shared)


def tag_and_collection_weight(shared: Column) -> Column:
    """Three for a tag (even item), one for the collection (odd item; a link has at most one)."""
    return 3 * F.size(shared) - 2 * F.size(F.filter(shared, lambda x: x.bitwiseAND(1) == 1))


@dataclass(frozen=True)
class Order:
    """Tie-break among equal scores; ``column`` is a target column, also the identity that is ranked."""

    column: str = "rel_id"


def _rank(pairs: DataFrame, k: int, order: Order) -> DataFrame:
    """Best k per link. A window group limit keeps k rows per link and task before the shuffle."""
    if order.column != "rel_id":
        # one entry per identity: its best score, carried by its first link
        pairs = pairs.groupBy("link_id", order.column).agg(
            F.max("score").alias("score"), F.min_by("rel_id", F.struct(-F.col("score"), F.col("rel_id"))).alias("rel_id"))
    w = Window.partitionBy("link_id").orderBy(F.desc("score"), F.col(order.column))
    return pairs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def _pair_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    r = right.withColumnRenamed("link_id", "rel_id")
    return left.join(r, key).where(F.col("link_id") != F.col("rel_id"))


def _first_members(members: DataFrame, k: int, order: Order) -> DataFrame:
    """Of each group, the members that can be in a top-k: the first k+1 identities, two links each."""
    w = Window.partitionBy("group")
    if order.column == "rel_id":
        ranked = members.withColumn("rank", F.row_number().over(w.orderBy("rel_id")))
        return ranked.where(F.col("rank") <= k + 1).drop("rank")
    two = members.withColumn("twin", F.row_number().over(
        Window.partitionBy("group", order.column).orderBy("rel_id"))).where("twin <= 2").drop("twin")
    ranked = two.withColumn("rank", F.dense_rank().over(w.orderBy(order.column)))
    return ranked.where(F.col("rank") <= k + 1).drop("rank")


def top_shared(items: DataFrame, targets: DataFrame, k: int, min_score: int = 1, order: Order = Order(),
               hot_degree: int = HOT_DEGREE, weigh: Weigh = plain_weight, wide_link: int = WIDE_LINK) -> DataFrame:
    """(link_id, rel_id, score, pos): best k other targets of every link.

    items: (link_id, item bigint), one row per link and item; ``weigh`` sums the weights of an item array.
    targets: (rel_id[, order column]), one row per eligible right-hand link.
    """
    degrees = items.groupBy("item").agg(F.count("*").alias("n"))
    widths = items.groupBy("link_id").agg(F.count("*").alias("n"))
    # the only eager step: two maxima tell which of the cases below occur at all
    largest = degrees.agg(F.lit("item").alias("side"), F.max("n").alias("n")).unionAll(widths.agg(F.lit("link"), F.max("n")))
    most = {row["side"]: row["n"] or 0 for row in largest.collect()}
    if most["item"] > hot_degree:
        pairs = _split_pairs(items, degrees, targets, k, order, hot_degree, weigh)
    else:
        best = k if order.column == "rel_id" else None
        any_wide = most["link"] > wide_link
        pairs = _small_pairs(items, targets, weigh, wide_link, any_wide, best)
        if best and not any_wide:
            return pairs.where(F.col("score") >= min_score).select("link_id", "rel_id", "score", "pos")
        pairs = pairs.drop("pos")
    return _finish(pairs, targets, k, min_score, order)


def _small_pairs(items: DataFrame, targets: DataFrame, weigh: Weigh, wide_link: int, any_wide: bool,
                 best: int | None = None) -> DataFrame:
    """All scored pairs where every item is on few links, or those that hold the ``best`` of every link by score and id.

    A link's items travel with each of its rows as an array, so a pair is scored where it meets and
    kept only at the first item it shares: pairs are neither counted nor shuffled. Links with too many
    items to carry are counted pair by pair.
    """
    bags = items.groupBy("link_id").agg(F.array_sort(F.collect_list("item")).alias("bag"))
    narrow = bags.where(F.size("bag") <= wide_link) if any_wide else bags
    if best:
        pairs = _best_of_items(narrow, targets, weigh, best)
    else:
        left = narrow.select("link_id", "bag", F.explode("bag").alias("item"))
        right = narrow.join(targets.select(F.col("rel_id").alias("link_id")), "link_id", "left_semi").select(
            F.col("link_id").alias("rel_id"), F.col("bag").alias("rel_bag"), F.explode("bag").alias("item"))
        both = F.array_intersect("bag", "rel_bag")
        met = left.join(right, "item").where((F.col("link_id") != F.col("rel_id")) & (both[0] == F.col("item")))
        pairs = met.select("link_id", "rel_id", weigh(both).cast("bigint").alias("score"))
    if not any_wide:
        return pairs
    pairs = pairs.drop("pos")
    flagged = items.join(bags.where(F.size("bag") > wide_link).select("link_id", F.lit(True).alias("wide")), "link_id", "left")
    wide, rest = flagged.where("wide").select("link_id", "item"), flagged.where("wide IS NULL").select("link_id", "item")
    eligible = targets.select(F.col("rel_id").alias("link_id"))
    counted = _pair_up(wide, items.select("link_id", "item").join(eligible, "link_id", "left_semi"), "item").unionByName(
        _pair_up(rest, wide.join(eligible, "link_id", "left_semi"), "item"))
    return pairs.unionByName(_counted(counted, weigh))


def _best_of_items(bags: DataFrame, targets: DataFrame, weigh: Weigh, best: int) -> DataFrame:
    """Each link's best pairs (link_id, rel_id, score, pos) among links (link_id, bag).

    A pair carries its whole score in the item where it first meets, so the best of a link are among the best of its items; the
    other pairs are never rows. An item's links meet in one task, which holds some items at a time. What a link has from
    an item travels as one row.
    """
    eligible = targets.select(F.col("rel_id").alias("link_id")).distinct().withColumn("eligible", F.lit(True))
    weights = F.transform("bag", lambda x: weigh(F.array(x)).cast("bigint"))
    rows = bags.where(F.col("link_id").isNotNull()).join(eligible, "link_id", "left").select(
        F.explode("bag").alias("item"), F.col("link_id").cast("bigint").alias("link_id"), "bag", weights.alias("weights"),
        F.coalesce("eligible", F.lit(False)).alias("eligible"))
    found = rows.repartition("item").sortWithinPartitions("item", "link_id").mapInArrow(
        _groups_of("item", _best_pairs, best), "link_id bigint, rel_id array<bigint>, lost array<bigint>")
    return found.repartition("link_id").sortWithinPartitions("link_id").mapInArrow(
        _groups_of("link_id", _ranked, best), "link_id bigint, rel_id bigint, score bigint, pos int")


def _groups_of(key: str, solve: Callable[[list[pa.RecordBatch], int], Iterator[pa.RecordBatch]], best: int):
    """Rows sorted by a key, handed on with all rows of a key together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1].column(key)[-1].as_py() != keys[0]):
                yield from solve([*held, batch.slice(0, cut)], best)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from solve(held, best)
    return run


def _ranked(batches: list[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """The best pairs of whole links, from their best of each item."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    if not rows.num_rows:
        return
    link, rels, lost = (rows.column(c).chunk(0) for c in ("link_id", "rel_id", "lost"))
    link = np.repeat(link.to_numpy(), pc.list_value_length(rels).to_numpy())
    rels, lost = (x.flatten().to_numpy() for x in (rels, lost))
    order = np.lexsort((rels, lost, link))
    link, rels, lost = link[order], rels[order], lost[order]
    pos = np.arange(len(link)) - np.searchsorted(link, link) + 1
    top = pos <= best
    yield pa.RecordBatch.from_arrays([pa.array(link[top]), pa.array(rels[top]), pa.array(-lost[top]), pa.array(pos[top].astype(np.int32))],
                                     ["link_id", "rel_id", "score", "pos"])


def _best_pairs(batches: list[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """Best pairs of whole items, a row for each link of an item that has any; the rows come by item and link.

    ``lost`` is the score, negated so that it sorts as the best do. Most links of an item share nothing else. Only those that
    do are scored pair by pair; of the others, which all have the item's own weight, a link needs no more than the first by id.
    """
    rows = pa.Table.from_batches(batches).combine_chunks()
    if not rows.num_rows:
        return
    item, link, eligible = (rows.column(c).chunk(0).to_numpy(zero_copy_only=False) for c in ("item", "link_id", "eligible"))
    bag, weight = (rows.column(c).chunk(0) for c in ("bag", "weights"))
    n = len(item)
    sizes = pc.list_value_length(bag).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), sizes)
    value, each = (x.flatten().to_numpy(zero_copy_only=False) for x in (bag, weight))
    once = np.ones(len(row), bool)  # an item that a link has twice counts once
    once[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value, each = row[once], value[once], each[once]
    own = np.zeros(n, np.int64)
    mine = value == item[row]
    own[row[mine]] = each[mine]
    row, value, each = row[~mine], value[~mine], each[~mine]
    start = np.searchsorted(item, item)
    # what the rows of an item share beside it: cells by item, value and row, and of each cell the eligible rows it meets
    order = np.lexsort((row, value, start[row]))
    row, value, each = row[order], value[order], each[order]
    new = np.ones(len(row), bool)
    new[1:] = (start[row[1:]] != start[row[:-1]]) | (value[1:] != value[:-1])
    run = np.cumsum(new) - 1
    partners = np.flatnonzero(eligible[row])
    first = np.searchsorted(run[partners], run)
    meets = np.searchsorted(run[partners], run, "right") - first
    cells = np.flatnonzero(meets > eligible[row])  # others than the row itself
    cells = cells[np.argsort(row[cells], kind="stable")]
    others = np.flatnonzero(eligible)
    low = np.searchsorted(others, start)
    count = np.searchsorted(others, np.searchsorted(item, item, "right")) - low
    heads = np.flatnonzero(np.append(True, (start[1:] != start[:-1]) | (link[1:] != link[:-1])))
    lengths = np.diff(np.append(heads, n))
    twins = np.repeat(lengths, lengths)  # rows of the same link in the item, the row itself among them
    cost = np.bincount(row[cells], meets[cells], n).astype(np.int64)
    done = np.cumsum(cost + np.minimum(count, best + twins + cost))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIR_CELLS)))
        at = cells[np.searchsorted(row[cells], lo):np.searchsorted(row[cells], hi)]
        left, right = np.repeat(row[at], meets[at]), row[partners[_spread(first[at], meets[at])]]
        apart = link[left] != link[right]
        pair = (left * n + right)[apart]
        pairs, of = np.unique(pair, return_inverse=True)
        score = np.bincount(of, np.repeat(each[at], meets[at])[apart], len(pairs)).astype(np.int64)
        least = np.full(len(pairs), np.iinfo(np.int64).max)
        np.minimum.at(least, of, np.repeat(value[at], meets[at])[apart])
        left, right = pairs // n, pairs % n
        here = least > item[left]  # else the pair first meets in a smaller item
        # the first by id, enough of them to leave the best ones without the link itself and the pairs above
        known = np.bincount(left - lo, minlength=hi - lo)
        some = np.minimum(count[lo:hi], best + twins[lo:hi] + known)
        plain_left = np.repeat(np.arange(lo, hi), some)
        plain_right = others[_spread(low[lo:hi], some)]
        plain = plain_left * n + plain_right
        found = np.searchsorted(pairs, plain)
        seen = np.zeros(len(plain), bool)
        inside = found < len(pairs)
        seen[inside] = pairs[found[inside]] == plain[inside]
        fresh = ~seen & (link[plain_left] != link[plain_right])
        score = np.append(score[here] + own[left[here]], own[plain_left[fresh]])
        left, right = np.append(left[here], plain_left[fresh]), np.append(right[here], plain_right[fresh])
        # the rows stand by link, so an order by score and place leaves ties by id
        order = np.lexsort((right, -score, left))
        left, right, score = left[order], right[order], score[order]
        top = np.arange(len(left)) - np.searchsorted(left, left) < best
        left, right, score = left[top], right[top], score[top]
        heads = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else left
        bounds = pa.array(np.append(heads, len(left)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(link[left[heads]]), pa.ListArray.from_arrays(bounds, pa.array(link[right])),
                                          pa.ListArray.from_arrays(bounds, pa.array(-score))], ["link_id", "rel_id", "lost"])
        lo = hi


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _counted(pairs: DataFrame, weigh: Weigh, *extra: Column) -> DataFrame:
    score = F.sum(weigh(F.array("item")))
    for part in extra:
        score = score + part
    return pairs.groupBy("link_id", "rel_id").agg(score.cast("bigint").alias("score"))


def _split_pairs(items: DataFrame, degrees: DataFrame, targets: DataFrame, k: int, order: Order, hot_degree: int,
                 weigh: Weigh) -> DataFrame:
    """Scored pairs that hold every link's top k, where some items are on very many links."""
    hot = degrees.where(F.col("n") > hot_degree).select("item")
    # hot items of each link, as one sorted array that travels with its rows
    hot_edges = items.join(hot, "item", "left_semi")
    profile = hot_edges.groupBy("link_id").agg(F.array_sort(F.collect_list("item")).alias("hot"))
    none = F.array().cast("array<bigint>")

    # 1. pairs inside small items; what they share among hot items is added from the profiles
    cold = items.join(hot, "item", "left_anti").join(profile, "link_id", "left").withColumn("hot", F.coalesce("hot", none))
    cold_right = cold.join(targets.select(F.col("rel_id").alias("link_id")), "link_id", "left_semi").select(
        "link_id", "item", F.col("hot").alias("rel_hot"))
    found = [_counted(_pair_up(cold, cold_right, "item"), weigh, F.first(weigh(F.array_intersect("hot", "rel_hot"))))]

    # 2. groups of links by shared sets of hot items, grown one item at a time while they stay big
    ensure_checkpoint_dir(items.sparkSession)
    profile = profile.checkpoint()
    order_cols = [] if order.column == "rel_id" else [order.column]
    members = profile.select("link_id", "hot", F.explode("hot").alias("item")).select(
        "link_id", "hot", F.array("item").alias("group"))
    while True:
        big = members.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > hot_degree).select("group")
        big = big.checkpoint()
        right = members.select(F.col("link_id").alias("rel_id"), F.col("hot").alias("rel_hot"), "group").join(
            targets.select("rel_id", *order_cols), "rel_id")
        small = members.join(big, "group", "left_anti")
        small_right = right.join(big, "group", "left_anti").drop(*order_cols)
        found.append(_scored(small.join(small_right, "group"), weigh))
        if big.isEmpty():
            break
        large = members.join(big, "group", "left_semi")
        short = _first_members(right.join(big, "group", "left_semi"), k, order).drop(*order_cols)
        # the short list is copied over salts, so no task meets a whole big group
        salted = short.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = large.withColumn("salt", F.pmod(F.hash("link_id"), F.lit(SALTS)))
        found.append(_scored(spread.join(salted, ["group", "salt"]), weigh))
        later = F.filter("hot", lambda x: x > F.element_at("group", -1))
        members = large.select("link_id", "hot", "group", F.explode(later).alias("item")).select(
            "link_id", "hot", F.concat("group", F.array("item")).alias("group")).checkpoint()

    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.groupBy("link_id", "rel_id").agg(F.max("score").alias("score"))


def _scored(pairs: DataFrame, weigh: Weigh) -> DataFrame:
    shared = F.array_intersect("hot", "rel_hot")
    return pairs.where(F.col("link_id") != F.col("rel_id")).select(
        "link_id", "rel_id", weigh(shared).cast("bigint").alias("score"))


def _finish(pairs: DataFrame, targets: DataFrame, k: int, min_score: int, order: Order) -> DataFrame:
    if min_score > 1:
        pairs = pairs.where(F.col("score") >= min_score)
    if order.column != "rel_id":
        pairs = pairs.join(targets.select("rel_id", order.column), "rel_id")
    return _rank(pairs, k, order)


# ---- the related-link rankings -----------------------------------------------------------------


def _targets(links: DataFrame) -> DataFrame:
    return links.where((F.col("status") == "parsed") & F.col("title").isNotNull()).select(
        F.col("id").alias("rel_id"), "title")


def _tag_items(link_tags: DataFrame) -> DataFrame:
    return link_tags.select("link_id", F.col("tag_id").cast("bigint").alias("item"))


def related_top(links: DataFrame, link_tags: DataFrame, k: int = 5, scope_user: bool = False,
                hot_degree: int = HOT_DEGREE) -> DataFrame:
    """Best k related links by number of shared tags, ties by id: (link_id, rel_id, shared_tags, pos, title, slug).

    ``scope_user`` keeps to links of the same owner, by making each tag private to its owner.
    """
    items = _tag_items(link_tags)
    if scope_user:
        owner = links.select(F.col("id").alias("link_id"), "user_id")
        items = items.join(owner, "link_id")
        private = items.select(F.col("item").alias("tag"), "user_id").distinct()
        none = links.select("id").limit(0)
        private = number_rows(private, F.concat_ws(":", "tag", "user_id"), none).withColumnsRenamed({"tag": "item", "id": "own"})
        items = items.join(private, ["item", "user_id"]).select("link_id", F.col("own").cast("bigint").alias("item"))
    targets = _targets(links)
    top = top_shared(items, targets, k, hot_degree=hot_degree)
    # slugs are made once for each target, before it meets the links that it is related to
    named = targets.withColumn("slug", wikilink_slug(F.col("title")))
    return top.join(named, "rel_id").select("link_id", "rel_id", F.col("score").alias("shared_tags"), "pos", "title", "slug")


def related_weighted(links: DataFrame, link_tags: DataFrame, collections: DataFrame, k: int = 8,
                     hot_degree: int = HOT_DEGREE) -> DataFrame:
    """Best k by 3 x shared tags + same collection, ties by id.

    The collection is one more shared item of weight 1; items are kept apart by their last bit.
    """
    tags = link_tags.select("link_id", (F.col("tag_id") * 2).cast("bigint").alias("item"))
    filed = links.where(F.col("collection_id").isNotNull()).select(
        F.col("id").alias("link_id"), (F.col("collection_id") * 2 + 1).cast("bigint").alias("item"))
    targets = _targets(links)
    top = top_shared(tags.unionByName(filed), targets, k, hot_degree=hot_degree, weigh=tag_and_collection_weight)
    slugs = collections.select(F.col("id").alias("collection_id"), F.col("slug").alias("collection"))
    about = links.select(F.col("id").alias("rel_id"), "title", "collection_id", wikilink_slug(F.col("title")).alias("slug")).join(
        slugs, "collection_id", "left")
    return top.join(about, "rel_id").select(
        "link_id", "rel_id", "pos", "score", "title", "slug",
        F.coalesce("collection", F.lit("unsorted")).alias("collection"),
        F.floor(F.col("score") / 3).cast("bigint").alias("shared_tags"), (F.col("score") % 3 == 1).alias("same_collection"))


def strong_related(links: DataFrame, link_tags: DataFrame, k: int = 10, min_shared: int = 2,
                   hot_degree: int = HOT_DEGREE) -> DataFrame:
    """Best k among links with at least ``min_shared`` common tags, ties by id."""
    top = top_shared(_tag_items(link_tags), _targets(links), k, min_shared, hot_degree=hot_degree)
    return top.select("link_id", "rel_id", F.col("score").alias("shared_tags"), "pos")


def backlinks(links: DataFrame, link_tags: DataFrame, k: int = 10, min_shared: int = 2,
              hot_degree: int = HOT_DEGREE) -> DataFrame:
    """Distinct titles with at least two common tags, best shared count first, then title; at most k per link."""
    top = top_shared(_tag_items(link_tags), _targets(links), k, min_shared, Order("title"), hot_degree)
    titled = links.where(F.col("title").isNotNull()).select(F.col("id").alias("link_id"))
    return top.join(titled, "link_id", "left_semi").select(
        "link_id", "title", wikilink_slug(F.col("title")).alias("slug"), F.col("score").alias("shared_tags"), "pos")


def backlink_edges(links: DataFrame, link_tags: DataFrame, k: int = 5, hot_degree: int = HOT_DEGREE) -> DataFrame:
    """The backlink graph as distinct (target, source) slugs: the inverted top-k lists of parsed, titled links.

    Kept as edges: a target that everything points to would not fit one row.
    """
    # both ends are parsed and titled, so tags of other links are never paired
    own = tags_of(link_tags, _targets(links).select(F.col("rel_id").alias("id")))
    top = related_top(links, own, k, hot_degree=hot_degree)
    sources = _targets(links).select(F.col("rel_id").alias("link_id"), wikilink_slug(F.col("title")).alias("source"))
    return top.join(sources, "link_id").select(F.col("slug").alias("target"), "source").distinct()


def graph_lines(edges: DataFrame, ordered: bool = True) -> DataFrame:
    """Text lines of the graph section, ordered by target then source unless the caller sorts them with others."""
    line = F.concat(F.lit("- [["), "source", F.lit("]] → [["), "target", F.lit("]]"))
    lines = edges.select("target", "source", line.alias("line"))
    return lines.orderBy("target", "source") if ordered else lines


def mermaid_lines(edges: DataFrame, ordered: bool = True) -> DataFrame:
    line = F.concat(F.lit("    "), "source", F.lit(" --> "), "target")
    lines = edges.select("target", "source", line.alias("line"))
    return lines.orderBy("target", "source") if ordered else lines
