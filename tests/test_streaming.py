"""Streams: maintained results equal results from scratch, with retractions."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from deltaspark.collection import T, W, Collection
from deltaspark.streaming import diagnostics, maintain
from deltaspark.streaming.upsert_stream import upserts


def rows(c):
    return sorted((*[r[x] for x in c.data], r[W]) for r in c.consolidate().df.collect())


def test_maintained_operators_equal_scratch(spark, tmp_path):
    rng = random.Random(8)
    make = lambda: Collection.from_raw(spark, [(rng.randrange(4), rng.randrange(5), rng.randrange(3), rng.choice((1, 1, -1))) for _ in range(40)], "k long, v long")
    left, right = make(), make().map("k", F.col("v").alias("u"))
    join = maintain.Join(spark, f"file://{tmp_path}/j", "k long, v long", "k long, u long", ["k"])
    count = maintain.Reduce(spark, f"file://{tmp_path}/c", "k long, v long", ["k"], lambda c: c.map("k").count("n"))
    at = lambda c, t: Collection(c.df.where(F.col(T) == t).drop(T))
    joined = counted = None
    for t in range(3):
        a, b = join.step(t, at(left, t), at(right, t)), count.step(t, at(left, t))
        joined, counted = (a, b) if joined is None else (joined.concat(a), counted.concat(b))
        assert rows(joined) == rows(left.snapshot(t).join(right.snapshot(t), ["k"]))
        assert rows(counted) == rows(left.snapshot(t).map("k").count("n"))


def test_stream_of_changes(spark, tmp_path):
    source = str(tmp_path / "in")
    count = maintain.Reduce(spark, f"file://{tmp_path}/state", "k long", ["k"], lambda c: c.count("n"))
    log = diagnostics.watch(spark)
    for change in ([(1, 1), (1, 1), (2, 1)], [(1, -1), (3, 1)]):
        spark.createDataFrame(change, f"k long, {W} long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(f"k long, {W} long").option("maxFilesPerTrigger", 1).parquet(source)
        run = maintain.stream(stream, lambda c, epoch: count.step(epoch, c), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
        run.awaitTermination()
    out = Collection(spark.read.parquet(f"{tmp_path}/out").drop("epoch"))
    assert rows(out) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    assert any(r["kind"] == "progress" for r in log.reports)
    spark.streams.removeListener(log)


def test_upsert_stream(spark, tmp_path):
    rng = random.Random(14)
    source, schema = str(tmp_path / "in"), "key string, val string, time long"
    events = [(rng.choice("xyz"), rng.choice((None, "p", "q")), t) for t in range(30)]

    def feed(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        run = upserts(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        run.awaitTermination()

    for a in (0, 10, 20):
        feed(events[a : a + 10])
    expected, now = [], {}
    for key, val, time in events:
        if val != now.get(key):
            expected += [(time, w, key, v) for w, v in ((-1, now.get(key)), (1, val)) if v is not None]
        now[key] = val
    assert sorted((r.time, r.w, r.key, r.val) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(expected)
    with pytest.raises(StreamingQueryException):  # too late
        feed([(events[29][0], "p", 3)])


def test_epochs_again_and_a_new_process(spark, tmp_path):
    """An epoch that is tried twice counts once, and state lives in the folder; enough epochs for sums."""
    rng = random.Random(15)
    epochs = [[(rng.randrange(3), rng.choice((1, 1, -1))) for _ in range(3)] for _ in range(7)]
    change = lambda e: Collection(spark.createDataFrame(epochs[e], f"k long, {W} long"))
    fresh = lambda: maintain.Reduce(spark, f"file://{tmp_path}/c", "k long", ["k"], lambda c: c.count("n"), 3)
    held, total = {}, {}
    for e in range(7):
        if e in (2, 4):
            fresh().step(e, change(e)).df.collect()  # the try that failed afterwards
        for r in fresh().step(e, change(e)).df.collect():
            total[r.k, r.n] = total.get((r.k, r.n), 0) + r[W]
        for k, w in epochs[e]:
            held[k] = held.get(k, 0) + w
        assert {k for k, w in total.items() if w} == {(k, n) for k, n in held.items() if n}
