"""The state processor against a plain loop: a hot key, rows out of order, state that goes."""

import datetime as dt
import random

import pytest

from linkloom.streaming import flows, ttl

START = dt.datetime(2024, 1, 1)


def greedy(rows, seconds):
    until, kept = {}, set()
    for key, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in until or ts >= until[key]:
            until[key] = ts + dt.timedelta(seconds=seconds)
            kept.add((key, seq))
    return kept


@pytest.mark.parametrize("few", [1000, 40, 0])
def test_stream_equals_batch_with_a_hot_key(spark, tmp_path, few):
    rnd, kind = random.Random(3), "key string, ts timestamp, event_id long"
    rows = [(rnd.choice("aaaabcdef"), START + dt.timedelta(seconds=i * 20 + rnd.randrange(600)), i) for i in range(500)]
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ttl.use_state_store(spark)
    try:
        for turn in range(2):  # the second file comes after a restart
            spark.createDataFrame(rows[turn * 250:turn * 250 + 250], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
            flows.collect_batches(ttl.ttl_dedup_processor(stream, ["key"], ttl_seconds=900, delay="20 minutes", few=few), str(tmp_path / "out"))
        # rows of another key move the watermark past all windows, and once more past their own cells
        for late in (2, 4):
            spark.createDataFrame([("end", START + dt.timedelta(days=late), 10_000 + late)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
            out = flows.collect_batches(ttl.ttl_dedup_processor(stream, ["key"], ttl_seconds=900, delay="20 minutes", few=few), str(tmp_path / "out"))
        got = [tuple(r) for r in out.select("key", "seq", "verdict").collect() if r["key"] != "end"]
        assert len(got) == len(rows) == len({g[:2] for g in got})
        assert {g[:2] for g in got if g[2] == "kept"} == greedy(rows, 900)
        state = spark.read.format("statestore").option("stateVarName", "until").load(str(tmp_path / "out/checkpoint"))
        assert {r["key"][0] for r in state.collect()} <= {"end"}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
