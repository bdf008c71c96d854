"""The queue: nothing lost, nothing repeated, whatever is interrupted."""

import pytest
from pyspark.sql import functions as F

from linkloom.streaming import feed, flows, queues


def values(spark, folder):
    return sorted(r.link_id for r in spark.read.parquet(f"{folder}/rows").collect())


def test_restart_in_mid_batch(spark, tmp_path):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    entries = lambda *v: spark.createDataFrame([(x,) for x in v], "value string").repartition(2)
    assert queues.enqueue(entries("1", "x2", "3", ""), queue) == 1
    assert queues.enqueue(entries("4", '"5', "6,7", "8"), queue) == 2
    failing = [True]

    def step(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={epoch}")
        if failing.pop() if failing else False:
            raise RuntimeError("after the rows are written, before the batch is done")

    ids = lambda: feed.link_ids(queues.read_queue(spark, queue))
    with pytest.raises(Exception, match="before the batch is done"):
        flows.run_available(ids(), step, out)
    assert queues.acknowledged(queue) == 0
    queues.enqueue(entries("9"), queue)
    flows.run_available(ids(), step, out)  # the interrupted batch again, as it was
    assert values(spark, out)[:4] == [1, 3, 4, 8]
    flows.run_available(ids(), step, out)
    assert values(spark, out) == [1, 3, 4, 8, 9]
    queues.enqueue(entries("10", "nonsense"), queue)
    flows.run_available(ids(), step, out)
    flows.run_available(ids(), step, out)  # nothing new
    assert values(spark, out) == [1, 3, 4, 8, 9, 10]
    assert queues.acknowledged(queue) >= 3
    queues.trim(spark, queue)
    queues.enqueue(entries("11"), queue)
    flows.run_available(ids(), step, out)
    assert values(spark, out) == [1, 3, 4, 8, 9, 10, 11]


def test_interrupted_append_is_not_seen(spark, tmp_path):
    queue = str(tmp_path / "queue")
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("a task fails")).cast("string")).otherwise("1").alias("value"))
    with pytest.raises(Exception, match="a task fails"):
        queues.enqueue(bad, queue)
    queues.enqueue(spark.createDataFrame([("7",)], "value string"), queue)
    flows.run_available(feed.link_ids(queues.read_queue(spark, queue)),
                        lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/rows/batch={epoch}"), str(tmp_path))
    assert values(spark, str(tmp_path)) == [7]
