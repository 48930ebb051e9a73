"""Operations data: request and cost statistics, alerts, limits, sessions, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.functions import r2, r2_sql
from factlode.plans.registry import query
from factlode.sources.fixtures import base, fixture

STATS = "COUNT(*) AS n, {0} AS avg_ms, MAX(latency_ms) AS max_ms, {1} AS error_rate"
AVG_SQL = r2_sql("(CAST(SUM(CAST(latency_ms AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*))")
ERR_SQL = r2_sql("(SUM(CASE WHEN success THEN 0 ELSE 1 END) * 100e0 / COUNT(*))")


def _stats() -> list:
    return [
        F.count("*").alias("n"),
        r2(F.sum(F.col("latency_ms").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("avg_ms"),
        F.max("latency_ms").alias("max_ms"),
        r2(F.count_if(~F.col("success")) * 100.0 / F.count("*")).alias("error_rate"),
    ]


@query("request_stats", f"SELECT coalesce(endpoint, 'all') AS endpoint, {STATS.format(AVG_SQL, ERR_SQL)} FROM requests GROUP BY GROUPING SETS ((endpoint), ())")
def request_stats(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "requests").rollup("endpoint").agg(*_stats()).withColumn("endpoint", F.coalesce("endpoint", F.lit("all")))


@query("request_stats_hourly", f"SELECT date_trunc('hour', ts) AS hour, endpoint, {STATS.format(AVG_SQL, ERR_SQL)} FROM requests GROUP BY 1, 2")
def request_stats_hourly(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "requests").groupBy(F.date_trunc("hour", "ts").alias("hour"), "endpoint").agg(*_stats())


PCT_SQL = "SELECT endpoint, latency_ms, row_number() OVER (PARTITION BY endpoint ORDER BY latency_ms) - 1 AS k, COUNT(*) OVER (PARTITION BY endpoint) AS n FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS rn FROM requests) r WHERE rn <= 100"


@query("latency_percentiles", f"SELECT endpoint, MAX(CASE WHEN k = floor(n * 0.50) THEN latency_ms END) AS p50, MAX(CASE WHEN k = floor(n * 0.95) THEN latency_ms END) AS p95, MAX(CASE WHEN k = floor(n * 0.99) THEN latency_ms END) AS p99 FROM ({PCT_SQL}) q GROUP BY endpoint")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("endpoint").orderBy(F.desc("ts"), F.desc("event_id"))
    last = fixture(spark, d, "requests").withColumn("rn", F.row_number().over(w)).filter("rn <= 100")
    ms = last.groupBy("endpoint").agg(F.sort_array(F.collect_list("latency_ms")).alias("ms"))
    at = lambda q: F.element_at("ms", (F.floor(F.size("ms") * F.lit(q)) + 1).cast("int"))
    return ms.select("endpoint", at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("alerts", f"SELECT endpoint, level FROM (SELECT endpoint, {ERR_SQL} AS e FROM requests GROUP BY endpoint) s, (VALUES ('error_rate', 10e0), ('success', 20e0)) l(level, most) WHERE e > most")
def alerts(spark: SparkSession, d: str) -> DataFrame:
    s = fixture(spark, d, "requests").groupBy("endpoint").agg(*_stats())
    found = F.array(F.when(F.col("error_rate") > 10, "error_rate"), F.when(F.col("error_rate") > 20, "success"))
    return s.select("endpoint", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("level"))


RATES = {"pro": (12, 48), "flash": (1, 4), "other": (3, 9)}


@query("usage_cost", f"SELECT coalesce(u.model, 'all') AS model, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens, CAST(SUM(prompt_tokens * r.p + completion_tokens * r.c) AS DOUBLE) / 1000000e0 AS cost FROM usage u JOIN (VALUES {', '.join(str((k, *v)) for k, v in RATES.items())}) r(model, p, c) ON u.model = r.model GROUP BY GROUPING SETS ((u.model), ())")
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([(k, *v) for k, v in RATES.items()], "model string, p int, c int")
    cost = F.sum(F.col("prompt_tokens") * F.col("p") + F.col("completion_tokens") * F.col("c")).cast("double") / 1000000.0
    joined = fixture(spark, d, "usage").join(F.broadcast(rates), "model")
    return joined.rollup("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), cost.alias("cost")).withColumn("model", F.coalesce("model", F.lit("all")))


@query("rate_count_sliding", "SELECT event_id, COUNT(*) OVER (PARTITION BY client ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, client, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM requests) r")
def rate_count_sliding(spark: SparkSession, d: str) -> DataFrame:
    r = fixture(spark, d, "requests").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return r.select("event_id", F.count("*").over(Window.partitionBy("client").orderBy("s").rangeBetween(-59, 0)).alias("n"))


@query("session_activity", "SELECT client, MIN(ts) AS started, COUNT(*) AS messages FROM (SELECT *, SUM(new) OVER (PARTITION BY client ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY client ORDER BY ts, event_id) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY client ORDER BY ts, event_id)) > 3600 THEN 1 ELSE 0 END AS new FROM requests) a) b GROUP BY client, session")
def session_activity(spark: SparkSession, d: str) -> DataFrame:
    r = fixture(spark, d, "requests")
    return r.groupBy("client", F.session_window("ts", "3600 seconds")).agg(F.min("ts").alias("started"), F.count("*").alias("messages")).select("client", "started", "messages")


STREAK_SQL = "SELECT endpoint, island, COUNT(*) FILTER (NOT success) AS failures FROM (SELECT *, SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT event_id, ts, endpoint, latency_ms < 5000 AS success FROM requests) x) r GROUP BY endpoint, island"


@query("failure_streaks", f"SELECT endpoint, MAX(failures) AS longest, CAST(SUM(CASE WHEN failures >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS opened FROM ({STREAK_SQL}) s GROUP BY endpoint")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    r = fixture(spark, d, "requests").withColumn("success", F.col("latency_ms") < 5000)
    w = Window.partitionBy("endpoint").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = r.withColumn("island", F.sum(F.col("success").cast("int")).over(w)).groupBy("endpoint", "island").agg(F.count_if(~F.col("success")).alias("failures"))
    return s.groupBy("endpoint").agg(F.max("failures").alias("longest"), F.count_if(F.col("failures") >= 3).alias("opened"))


@query("recent_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) c WHERE rn <= 6")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return base(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).filter("rn <= 6").select("conv_id", "turn", "role")


@query("bounded_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) c WHERE rn <= 20")
def bounded_history(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return base(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).filter("rn <= 20").select("conv_id", "turn", "role")


@query("score_trend", "SELECT day, n, n - lag(n) OVER (ORDER BY day) AS change FROM (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1) t")
def score_trend(spark: SparkSession, d: str) -> DataFrame:
    # One row for each day: the window over all days stays small.
    runs = base(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return runs.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("day")))
