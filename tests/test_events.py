"""Deduplication and admission against plain loops; streams against their batch forms."""

import datetime as dt
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import dedup, ratelimit
from linkloom.streaming import firsts, flows, stateful

START = dt.datetime(2024, 1, 1)


def captures(n=600, keys=4, seed=3, hours=200):
    rnd = random.Random(seed)
    return sorted((rnd.choice("aaaab" if keys < 5 else "abcdefgh"), START + dt.timedelta(seconds=rnd.randrange(hours * 3600)), i)
                  for i in range(n))


def greedy(rows, ttl):
    until, kept = {}, set()
    for key, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in until or ts >= until[key]:
            until[key] = ts + dt.timedelta(seconds=ttl)
            kept.add((key, seq))
    return kept


@pytest.mark.parametrize("hot,cells,ttl", [(10_000, 1440, 3600), (20, 24, 3600), (20, 7, 86400), (20, 1, 5000), (20, 60, 600)])
def test_ttl(spark, hot, cells, ttl):
    rows = captures()
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id bigint")
    got = dedup.ttl_dedup(df, ["key"], ttl_seconds=ttl, hot_rows=hot, cells=cells)
    assert {(r.key, r.event_id) for r in got.collect()} == greedy(rows, ttl)


def test_ttl_is_exact_at_the_end(spark):
    rows = [("a", START, 1), ("a", START + dt.timedelta(seconds=99), 2), ("a", START + dt.timedelta(seconds=100), 3)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id bigint")
    for hot in (100, 1):
        got = dedup.ttl_dedup(df, ["key"], ttl_seconds=100, hot_rows=hot, cells=3)
        assert {r.event_id for r in got.collect()} == {1, 3}


def admit(rows, most, span):
    logs, out = defaultdict(deque), {}
    for key, ms, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        log = logs[key]
        while log and log[0] <= ms - span:
            log.popleft()
        out[seq] = (len(log) < most, len(log))
        if len(log) < most:
            log.append(ms)
    return out


@pytest.mark.parametrize("most,span,density", [(3, 1000, 400), (5, 2000, 900), (2, 700, 90), (10, 5000, 700)])
def test_admission(spark, most, span, density):
    rnd = random.Random(most)
    rows, at = [], 1_700_000_000_000
    for seq in range(700):
        at += rnd.choice([0, 1, rnd.randrange(2 * density), 0 if rnd.random() < 0.9 else 9000])
        rows.append((rnd.choice("xxxy"), at, seq))
    keyed = spark.createDataFrame([(s, ms, k, most, span) for k, ms, s in rows], "seq bigint, ms bigint, key string, most int, span bigint")
    got = {r.seq: (r.allowed, r.used) for r in ratelimit.replay(keyed).collect()}
    assert got == admit(rows, most, span)


def write_batches(spark, rows, schema, folder, parts=4):
    """The rows in time order as files whose times follow that order."""
    import os
    import time

    size, known = len(rows) // parts + 1, set()
    for i in range(parts):
        df = spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1)
        df.write.mode("append").json(str(folder))
        new = set(folder.glob("*.json")) - known
        known |= new
        for file in new:
            os.utime(file, (time.time() - 1000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_ttl_stream_equals_batch(spark, tmp_path):
    rows = sorted(captures(300), key=lambda r: r[1])
    schema = "key string, ts timestamp, event_id bigint"
    batch_rows = [(k, t, s) for k, t, s in rows]
    stream = write_batches(spark, batch_rows, schema, tmp_path / "in")
    out = flows.collect_batches(stateful.ttl_dedup_stream(stream, ["key"], ttl_seconds=7200), str(tmp_path / "run"))
    found = {(r.key, r.seq): r.verdict for r in out.collect()}
    assert len(found) == len(rows)
    assert {k for k, v in found.items() if v == "kept"} == greedy(rows, 7200)
    assert "late" not in found.values()


def test_state_outlives_a_pause(spark, tmp_path):
    """State is kept by event time: a stream that stands still for longer than the window forgets nothing."""
    import time

    def slow(batch, epoch):
        time.sleep(3)
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={epoch}"))

    rows = [("a", START, 1), ("b", START, 2), ("b", START, 3), ("a", START + dt.timedelta(seconds=1), 4)]
    stream = write_batches(spark, rows, "key string, ts timestamp, event_id bigint", tmp_path / "in")
    flows.run_available(stateful.ttl_dedup_stream(stream, ["key"], ttl_seconds=2), slow, str(tmp_path / "run"))
    found = {r.seq: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: "kept", 2: "kept", 3: "repeat", 4: "repeat"}


def test_rate_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows = sorted((1_700_000_000_000 + rnd.randrange(60_000), s, rnd.choice("ab")) for s in range(300))
    schema = "seq bigint, ms bigint, key string, most int, span bigint"
    keyed = [(s, ms, k, 4, 3000) for ms, s, k in rows]
    stream = write_batches(spark, keyed, schema, tmp_path / "in")
    out = flows.collect_batches(stateful.rate_limit_stream(stream), str(tmp_path / "run"))
    got = {r.seq: (r.allowed, r.used) for r in out.collect()}
    assert got == admit([(k, ms, s) for ms, s, k in rows], 4, 3000)


def test_capture_flow_in_batches(spark, tmp_path):
    pages = [(i, f"https://e.org/{i % 5}", f"<title>Page {i % 5}</title><article><p>Body {i % 5}</p></article>") for i in range(12)]
    corpus = spark.createDataFrame(pages[:5], "page_id bigint, url string, html string")
    schema = "seq bigint, user_id bigint, url string, saved_at timestamp"
    caps = [(i, i % 2, f"https://e.org/{i % 5}", START) for i in range(12)]
    stream = write_batches(spark, caps, schema, tmp_path / "in", 3)
    flow = flows.CaptureFlow(spark, corpus, str(tmp_path / "run"), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    flow.run(stream)
    links = flow.table("links").collect()
    assert {(r.url, r.user_id) for r in links} == {(u, k) for _, k, u, _ in caps}
    assert len(links) == len({r.id for r in links}) == 10
    assert {r.title for r in links} == {f"Page {i}" for i in range(5)}
    assert flow.table("feed").count() == 10 and flow.table("docs").count() == 10
    note = flow.table("notes").where("path like '%page-3.md'").first()
    assert "# Page 3\n\nBody 3" in note.content


def test_first_arrivals_over_restarts(spark, tmp_path):
    """Three runs over the same folders, each with new files; the store is made anew each time, as after a restart."""
    rnd, want, seen = random.Random(4), {}, []
    kind = "user string, url string, seq long"
    for turn in range(3):
        rows = [(rnd.choice("aaab") if rnd.random() > 0.1 else None, f"u{rnd.randrange(60)}", turn * 1000 + i) for i in range(150)]
        for user, url, seq in rows:
            want.setdefault((user, url), (turn, seq))
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = firsts.FirstArrivals(spark, str(tmp_path / "out"), ["user", "url"], "seq", buckets=4, fanout=2)
        got = store.run(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        assert {((r.user, r.url), r.seq) for r in got.collect()} == {(k, s) for k, (_, s) in want.items()}
        assert got.count() == len(want)
        seen.append(store.looked_up)
    assert seen[0] == 0 < seen[1]
    assert sum(store.state()[1]["segments"].values()) == len(want)
    before = store.state()
    store.step(spark.createDataFrame([("a", "other", 1)], kind), before[1]["epoch"])  # a repeated batch
    assert store.state() == before


def test_segments_of_keys_are_merged(spark, tmp_path):
    store = firsts.FirstArrivals(spark, str(tmp_path / "out"), ["id"], "seq", buckets=2, fanout=2)
    for epoch in range(3):
        store.step(spark.range(epoch * 10, epoch * 10 + 20).selectExpr("id", "id AS seq"), epoch)
        assert spark.read.parquet(f"{tmp_path}/out/rows/batch={epoch}").count() == (10 if epoch else 20)
    sizes = store.state()[1]["segments"].values()
    assert sum(sizes) == 40 and len(sizes) == 2


def test_filters_hold_their_keys():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(-2**63, 2**63 - 1, (2, 20_000))
    bits = firsts.filter_of(keys)
    assert firsts.may_hold(bits, keys).all() and firsts.may_hold(bits, others).mean() < 0.01


@pytest.mark.parametrize("files", [1, 3])
def test_capture_flow_reads_a_table_of_one_file_or_a_folder(spark, tmp_path, files):
    from linkloom.plans import catalog
    from linkloom.sources.views import Tables

    rows = [(i, f"https://e.example/{i % 4}", f"<title>Page {i % 4}</title><article><p>text</p></article>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    if files == 1:
        pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    else:
        pages.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog()["capture_flow"].run(Tables(spark, str(tmp_path))).collect()
    assert sorted((r.seq, r.title, r.path) for r in got) == [
        (i, f"Page {i % 4}", f"collections/unsorted/page-{i % 4}.md") for i in range(12)]
