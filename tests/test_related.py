"""Top-k by shared items against brute force, with the split for large groups forced on."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.operators import related


def fixture_rows(seed, links=60, tags=9):
    rnd = random.Random(seed)
    rows = [(i, f"Title {rnd.randrange(20)}" if rnd.random() > 0.1 else None, "parsed" if rnd.random() > 0.2 else "failed",
             rnd.choice([None, 1, 2, 3])) for i in range(links)]
    edges = set()
    for i in range(links):
        if rnd.random() > 0.6:
            edges.add((i, 0))  # one tag on a large share of the links
        for _ in range(rnd.randrange(5)):
            edges.add((i, int(tags * rnd.random() ** 2)))
    return rows, sorted(edges)


def shared(edges):
    by_link = defaultdict(set)
    for link, tag in edges:
        by_link[link].add(tag)
    return by_link


def brute(rows, edges, weight_tags=1, weight_collection=0):
    by_link, where = shared(edges), {r[0]: r[3] for r in rows}
    for a, *_ in rows:
        for b, title, state, _ in rows:
            if a != b and state == "parsed" and title is not None:
                same = weight_collection if where[a] is not None and where[a] == where[b] else 0
                score = weight_tags * len(by_link[a] & by_link[b]) + same
                if score:
                    yield a, b, score, title


def frames(spark, rows, edges):
    links = spark.createDataFrame(rows, "id bigint, title string, status string, collection_id bigint")
    return links, spark.createDataFrame(edges, "link_id bigint, tag_id bigint")


@pytest.mark.parametrize("seed,hot", [(1, 1000), (1, 3), (2, 8)])
def test_top_five(spark, seed, hot):
    rows, edges = fixture_rows(seed)
    best = defaultdict(list)
    for a, b, score, _ in brute(rows, edges):
        best[a].append((-score, b))
    want = {(a, b, -s, i + 1) for a, found in best.items() for i, (s, b) in enumerate(sorted(found)[:5])}
    got = related.related_top(*frames(spark, rows, edges), hot_degree=hot)
    assert {(r.link_id, r.rel_id, r.shared_tags, r.pos) for r in got.collect()} == want


@pytest.mark.parametrize("hot", [1000, 4])
def test_weighted(spark, hot):
    rows, edges = fixture_rows(5)
    links, tags = frames(spark, rows, edges)
    collections = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, slug string")
    best = defaultdict(list)
    for a, b, score, _ in brute(rows, edges, 3, 1):
        best[a].append((-score, b))
    want = {(a, b, -s, i + 1) for a, found in best.items() for i, (s, b) in enumerate(sorted(found)[:8])}
    got = related.related_weighted(links, tags, collections, hot_degree=hot).collect()
    assert {(r.link_id, r.rel_id, r.score, r.pos) for r in got} == want
    assert all(r.score == 3 * r.shared_tags + int(r.same_collection) for r in got)


@pytest.mark.parametrize("hot", [1000, 4])
def test_backlinks_by_title(spark, hot):
    rows, edges = fixture_rows(7, links=80, tags=5)
    best = defaultdict(dict)
    for a, b, score, title in brute(rows, edges):
        if score >= 2 and rows[a][1] is not None:
            best[a][title] = max(score, best[a].get(title, 0))
    want = {(a, title, score, i + 1) for a, found in best.items()
            for i, (title, score) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:10])}
    got = related.backlinks(*frames(spark, rows, edges), hot_degree=hot)
    assert {(r.link_id, r.title, r.shared_tags, r.pos) for r in got.collect()} == want


def test_wide_links(spark):
    # links with more items than the carried profile allows are counted pair by pair
    rows = [(i, f"T{i}", "parsed", None) for i in range(12)]
    edges = [(i, t) for i in range(12) for t in range(200) if i < 2 or (t * 7 + i) % 11 == 0]
    best = defaultdict(list)
    for a, b, score, _ in brute(rows, edges):
        best[a].append((-score, b))
    want = {(a, b, -s) for a, found in best.items() for s, b in sorted(found)[:5]}
    got = related.related_top(*frames(spark, rows, edges))
    assert {(r.link_id, r.rel_id, r.shared_tags) for r in got.collect()} == want


def test_scope_user(spark):
    links = spark.createDataFrame([(1, "A", "parsed", 1), (2, "B", "parsed", 1), (3, "C", "parsed", 2)],
                                  "id bigint, title string, status string, user_id bigint")
    edges = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "link_id bigint, tag_id bigint")
    pairs = {(r.link_id, r.rel_id) for r in related.related_top(links, edges, scope_user=True).collect()}
    assert pairs == {(1, 2), (2, 1)}


@pytest.mark.parametrize("k", [1, 3, 8])
def test_only_the_best_of_an_item_leave_it(spark, k):
    rnd = random.Random(k)
    edges = sorted({(link, rnd.randrange(12)) for link in range(60) for _ in range(rnd.randrange(1, 5))})
    items = spark.createDataFrame(edges, "link_id long, item long")
    targets = [link for link in range(60) if link % 3]
    rows = spark.createDataFrame([(link,) for link in targets], "rel_id long")
    bags = items.groupBy("link_id").agg(F.array_sort(F.collect_list("item")).alias("bag"))
    near = related._best_of_items(bags, rows, related.plain_weight, k)
    assert near.groupBy("link_id").count().agg(F.max("count")).first()[0] <= 4 * k  # no more than k for each of its items
    of = {link: {i for own, i in edges if own == link} for link in range(60)}
    want = set()
    for link in of:
        met = sorted((-len(of[link] & of[other]), other) for other in targets if other != link and of[link] & of[other])
        want |= {(link, other, -less, pos + 1) for pos, (less, other) in enumerate(met[:k])}
    got = related.top_shared(items, rows, k)
    assert {(r.link_id, r.rel_id, r.score, r.pos) for r in got.collect()} == want


def test_links_that_share_one_item_leave_as_their_best_only(spark):
    """Pairs that share nothing but one item are not scored one by one, and a link leaves the step once, with its best."""
    items = spark.createDataFrame([(link, item) for link in range(300) for item in (0, 1 + link % 2, 10 + link)], "link_id long, item long")
    rows = spark.createDataFrame([(link,) for link in range(300)], "rel_id long")
    bags = items.groupBy("link_id").agg(F.array_sort(F.collect_list("item")).alias("bag"))
    near = related._best_of_items(bags, rows, related.plain_weight, 5).collect()
    want = {(link, other, 2) for link in range(300) for other in [o for o in range(300) if o % 2 == link % 2 and o != link][:5]}
    assert len(near) == 1500 and {(r.link_id, r.rel_id, r.score) for r in near} == want
    two = spark.createDataFrame([(link, [link % 30, 30 + link % 7]) for link in range(300)], "link_id long, bag array<long>")
    sent = related._best_of_items(two, rows, related.plain_weight, 5).groupBy("link_id").count().collect()
    assert len(sent) == 300 and all(r["count"] == 5 for r in sent)
    alone = spark.createDataFrame([(link, link % 30) for link in range(300)], "link_id long, item long")
    got = related.top_shared(alone, rows, 3).collect()
    assert {(r.link_id, r.rel_id, r.score, r.pos) for r in got} == {
        (link, other, 1, n + 1) for link in range(300)
        for n, other in enumerate([o for o in range(link % 30, 300, 30) if o != link][:3])}
