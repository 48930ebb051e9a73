"""Requests as a stream: running statistics, token usage, and a sliding limit for each client."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factlode.operators.ops import AVG_SQL, ERR_SQL, STATS, _stats
from factlode.plans.registry import query
from factlode.sources.fixtures import fixture
from factlode.streaming import stream_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    """Events of a folder as a stream of its files."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)


def requests_of(rows: DataFrame) -> DataFrame:
    latency, success = (F.col("value") * 100).alias("latency_ms"), (F.col("event_type") != "error").alias("success")
    return rows.select("event_id", "ts", F.col("user_id").cast("string").alias("client"), F.concat(F.lit("ep"), (F.col("event_id") % 7).cast("string")).alias("endpoint"), latency, success)


def usage_of(rows: DataFrame) -> DataFrame:
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    model = F.when(F.col("event_type") == "purchase", "pro").when(F.col("event_type") == "signup", "other").otherwise("flash")
    return rows.select("event_id", "ts", F.col("user_id").cast("string").alias("session_id"), model.alias("model"), (n * 10).alias("prompt_tokens"), (n * 3).alias("completion_tokens"))


def upserts(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch's changed rows under its number: a batch that runs again replaces its own rows."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row written for each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch").cast("long")).alias("r")).select(*keys, "r.*")


def run_available(changes: DataFrame, spark: SparkSession, name: str, keys: list[str], state: str | None = None, out: str | None = None) -> DataFrame:
    """Runs a stream in update mode over all files there are, and gives its newest rows.

    With the same ``state`` and ``out`` it goes on where the last run ended."""
    state, out = state or stream_folder(spark, f"{name}-state"), out or stream_folder(spark, name)
    changes.writeStream.outputMode("update").foreachBatch(upserts(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return newest(spark, out, keys)


def hourly(requests: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count, latencies and error rate of each endpoint and hour; rows later than ``late`` are left out and state is dropped."""
    rows = requests.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "endpoint").agg(*_stats())
    return rows.select(F.col("w.start").alias("hour"), "endpoint", "n", "avg_ms", "max_ms", "error_rate")


def usage(rows: DataFrame) -> DataFrame:
    """Calls and tokens of each model and session so far."""
    return rows.groupBy("session_id", "model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


@query("stream_request_stats", f"SELECT date_trunc('hour', ts) AS hour, endpoint, {STATS.format(AVG_SQL, ERR_SQL)} FROM requests GROUP BY 1, 2")
def stream_request_stats(spark: SparkSession, d: str) -> DataFrame:
    return run_available(hourly(requests_of(events(spark, d, "events.parquet"))), spark, "request-stats", ["hour", "endpoint"])


@query("usage_stream", "SELECT session_id, model, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens FROM usage GROUP BY 1, 2")
def usage_stream(spark: SparkSession, d: str) -> DataFrame:
    return run_available(usage(usage_of(events(spark, d, "events.parquet"))), spark, "usage", ["session_id", "model"])


SECOND = 1_000_000


class Admissions:
    """The times, in microseconds, of a client's admitted requests within the window: never more than the limit."""

    def __init__(self, limit: int, window: int, times: Iterator[int] = ()):
        self.limit, self.window, self.times = limit, window * SECOND, deque(times)

    def ask(self, now: int) -> tuple[bool, int]:
        """Whether a request is admitted, and else after how many seconds to try again."""
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        if len(self.times) < self.limit:
            self.times.append(now)
            return True, 0
        return False, max((self.times[0] + self.window - now) // SECOND + 1, 1)


DECIDED = "client string, event_id long, admitted boolean, retry_after long"


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def limited(requests: DataFrame, limit: int, window: int = 60) -> DataFrame:
    """Each request's admission: fewer than ``limit`` of its client's were admitted in the last ``window`` seconds.

    A client's requests pass in order of time and id; what is held of them is the admitted ones of one
    window, so a client of any number of requests fits one task. Rows without client are one client."""
    rows = requests.select("client", "event_id", _micros("ts").alias("at")).repartition("client").sortWithinPartitions("client", "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            out = []
            for client, at in zip(batch.column("client").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if state is None or client != last:
                    state, last = Admissions(limit, window), client
                out.append(state.ask(at) if at is not None else (True, 0))
            ok, after = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("client"), batch.column("event_id"), pa.array(ok, pa.bool_()), pa.array(after, pa.int64())], names=["client", "event_id", "admitted", "retry_after"])

    return rows.mapInArrow(run, DECIDED)


class Limiter(StatefulProcessor):
    """The same over a stream: requests wait until the watermark has passed them and are then asked in order of time."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.admitted = handle.getListState("admitted", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = list(zip(part["at"].astype(int).tolist(), part["event_id"].astype(int).tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(first or new[0], min(new))
        if first:
            self.handle.registerTimer(first[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((int(a), int(e)) for a, e in self.waiting.get())
        state = Admissions(self.limit, self.window, sorted(int(a) for (a,) in self.admitted.get()))
        due, rest = [w for w in waiting if w[0] <= passed], [w for w in waiting if w[0] > passed]
        out = [(key[0], e, *state.ask(a)) for a, e in due]
        for store, left in ((self.waiting, rest), (self.admitted, [(a,) for a in state.times])):
            store.put(left) if left else store.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["client", "event_id", "admitted", "retry_after"])

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, limit: int, window: int = 60, late: str = "10 minutes") -> DataFrame:
    """``limited`` over a stream. Admission depends on earlier requests, so each is decided once the watermark, ``late``
    behind the newest, has passed it. Needs the RocksDB state store. Requests later than that are dropped."""
    rows = requests.select("client", "event_id", "ts", _micros("ts").alias("at")).withWatermark("ts", late)
    return rows.groupBy("client").transformWithStateInPandas(statefulProcessor=Limiter(limit, window), outputStructType=DECIDED, outputMode="Append", timeMode="EventTime")


@query("rate_limit_sliding")
def rate_limit_sliding(spark: SparkSession, d: str) -> DataFrame:
    return limited(fixture(spark, d, "requests"), 10)
