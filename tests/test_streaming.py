"""Streams against plain replays: out of order, in many files, and after a restart."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from factlode.operators.ops import request_stats_hourly
from factlode.streaming import requests as rq

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_statistics_of_a_shuffled_replay(spark, sf, tmp_path):
    source, state, out = (f"file://{tmp_path}/{n}" for n in ("in", "state", "out"))
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy(F.rand(1))
    parts = rows.randomSplit([1.0] * 4, seed=2)
    stats = lambda: rq.run_available(rq.hourly(rq.requests_of(rq.events(spark, source)), "60 days"), spark, "stats", ["hour", "endpoint"], state, out)
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):  # two runs: the second goes on from the first's checkpoint
            got = stats()
    want = request_stats_hourly(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def plain(rows, limit, window):
    admitted, out = {}, {}
    for client, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        now = [t for t in admitted.get(client, []) if t > at - window * 10**6]
        ok = len(now) < limit
        out[client, i] = (True, 0) if ok else (False, max((min(now) + window * 10**6 - at) // 10**6 + 1, 1))
        admitted[client] = [*now, at] if ok else now
    return out


def requests(n, seed):
    r = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += r.choice([0, 200_000, 3_000_000, 9_000_000, 40_000_000])
        rows.append((r.choice("abc"), i, at))
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([(i, START + timedelta(microseconds=at), c) for c, i, at in rows], "event_id long, ts timestamp, client string")


def micros(rows):
    zero = int(START.timestamp()) * 10**6
    return [(c, i, at + zero) for c, i, at in rows]


def test_limit_in_batch(spark):
    rows = requests(600, 1)
    got = {(r.client, r.event_id): (r.admitted, r.retry_after) for r in rq.limited(as_frame(spark, rows).repartition(5), 3).collect()}
    want = plain(micros(rows), 3, 60)
    assert got == want and any(not ok for ok, _ in want.values())
    assert rq.limited(as_frame(spark, []), 3).count() == 0


def test_limit_in_a_stream_out_of_order_and_after_a_restart(spark, rocks, tmp_path):
    source, state, out = (f"file://{tmp_path}/{n}" for n in ("in", "state", "out"))
    rows = requests(240, 2)
    # Neighbours in time come in different files; none is later than the watermark allows.
    files = [[r for k, r in enumerate(rows) if k // 60 == f and k % 2 == p] for f in range(4) for p in (1, 0)]
    end = rows[-1][2] + 3600 * 10**6

    def run():
        stream = spark.readStream.schema("event_id long, ts timestamp, client string").option("maxFilesPerTrigger", 1).parquet(source)
        rq.limited_stream(stream, 3, late="1 hour").writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()

    for k, part in enumerate(files):
        as_frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        if k == 3:
            run()
    # A later request of another client moves the watermark past all of these.
    as_frame(spark, [("late", 10**6, end + 2 * 3600 * 10**6)]).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {(r.client, r.event_id): (r.admitted, r.retry_after) for r in spark.read.parquet(out).collect()}
    assert got == plain(micros(rows), 3, 60)
