"""Checks on reports and charts: where values come from, how sure they are, what a chart may show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.plans.registry import query
from factlode.sources.fixtures import fixture

# An annual row's values are read, taken from another metric, computed, or missing.
ORIGIN = ("CASE WHEN equity_attr_parent IS NOT NULL THEN 'sql' WHEN total_equity IS NOT NULL THEN 'fallback' "
          "WHEN total_assets IS NOT NULL AND total_liabilities IS NOT NULL THEN 'computed' ELSE 'other' END")  # fmt: skip


def origins(spark: SparkSession, d: str) -> DataFrame:
    """symbol, year and origin of the parent's equity."""
    return fixture(spark, d, "annual").select("symbol", "year", F.expr(ORIGIN).alias("origin"))


@query("traceability", f"SELECT symbol, COUNT(*) AS total, COUNT(*) FILTER (WHERE origin = 'sql') AS sql, COUNT(*) FILTER (WHERE origin = 'fallback') AS fallback, COUNT(*) FILTER (WHERE origin = 'computed') AS computed, COUNT(*) FILTER (WHERE origin <> 'other') * 1e0 / COUNT(*) AS traced FROM (SELECT symbol, {ORIGIN} AS origin FROM annual) o GROUP BY symbol")
def traceability(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.count_if(F.col("origin") == k).alias(k) for k in ("sql", "fallback", "computed")]
    return origins(spark, d).groupBy("symbol").agg(F.count("*").alias("total"), *counts, (F.count_if(F.col("origin") != "other") * F.lit(1.0) / F.count("*")).alias("traced"))


SURE = "CASE origin WHEN 'sql' THEN 95 WHEN 'fallback' THEN 85 WHEN 'computed' THEN 80 ELSE 0 END"


@query("reliability_label", f"SELECT symbol, CASE WHEN mean >= 90 THEN '高' WHEN mean >= 75 THEN '中' ELSE '低' END AS label, has_fallback, has_computed FROM (SELECT symbol, SUM({SURE}) * 1e0 / COUNT(*) AS mean, bool_or(origin = 'fallback') AS has_fallback, bool_or(origin = 'computed') AS has_computed FROM (SELECT symbol, {ORIGIN} AS origin FROM annual) o GROUP BY symbol) m")
def reliability_label(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of a company's values as a word, and what they rest on."""
    mean = F.sum(F.expr(SURE)) * F.lit(1.0) / F.count("*")
    rows = origins(spark, d).groupBy("symbol").agg(mean.alias("mean"), F.bool_or(F.col("origin") == "fallback").alias("has_fallback"), F.bool_or(F.col("origin") == "computed").alias("has_computed"))
    label = F.when(F.col("mean") >= 90, "高").when(F.col("mean") >= 75, "中").otherwise("低")
    return rows.select("symbol", label.alias("label"), "has_fallback", "has_computed")


@query("score_group_stats", "SELECT endpoint, score, floor(AVG(value) * 100 + 0.5) / 100 AS mean, COUNT(*) AS n, MIN(value) AS lowest, MAX(value) AS highest FROM (SELECT endpoint, 'latency_ms' AS score, CAST(latency_ms AS DOUBLE) AS value FROM requests UNION ALL SELECT endpoint, 'success', CASE WHEN success THEN 1e0 ELSE 0e0 END FROM requests) u GROUP BY 1, 2")
def score_group_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, count, least and greatest of each score by group."""
    wide = fixture(spark, d, "requests").select("endpoint", F.col("latency_ms").cast("double").alias("latency_ms"), F.col("success").cast("double").alias("success"))
    long = wide.unpivot(["endpoint"], ["latency_ms", "success"], "score", "value").filter("value IS NOT NULL OR score = 'success'")
    value = F.when(F.col("score") == "success", F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    return long.withColumn("value", value).groupBy("endpoint", "score").agg((F.floor(F.avg("value") * 100 + 0.5) / 100).alias("mean"), F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("indicator_base_name", "SELECT key, regexp_replace(key, '_([0-9]{4}|[0-9]{6})$', '') AS base FROM (SELECT DISTINCT concat(metric_key, '_', CASE WHEN year % 2 = 0 THEN CAST(year AS VARCHAR) ELSE symbol END) AS key FROM facts) k")
def indicator_base_name(spark: SparkSession, d: str) -> DataFrame:
    """A key without one trailing year or company."""
    tail = F.when(F.col("year") % 2 == 0, F.col("year").cast("string")).otherwise(F.col("symbol"))
    keys = fixture(spark, d, "facts").select(F.concat_ws("_", "metric_key", tail).alias("key")).distinct()
    return keys.select("key", F.regexp_replace("key", "_([0-9]{4}|[0-9]{6})$", "").alias("base"))


@query("chart_dedupe", "SELECT chart, label, value FROM (SELECT *, row_number() OVER (PARTITION BY chart, value ORDER BY label) AS rn FROM (SELECT symbol AS chart, year AS label, floor(current_assets / total_assets * 10 + floor(total_liabilities / total_assets * 10)) AS value FROM annual WHERE total_assets <> 0) c) q WHERE rn = 1")
def chart_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of a chart's points with one value, the first label stays."""
    share = lambda c: F.col(c) / F.col("total_assets") * 10
    points = fixture(spark, d, "annual").filter("total_assets <> 0").select(F.col("symbol").alias("chart"), F.col("year").alias("label"), F.floor(share("current_assets") + F.floor(share("total_liabilities"))).cast("double").alias("value"))
    w = Window.partitionBy("chart", "value").orderBy("label")
    return points.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


@query("chart_none_filter", "SELECT symbol AS chart, COUNT(net_profit_attr_parent) AS n_points, string_agg(CASE WHEN net_profit_attr_parent IS NOT NULL THEN CAST(year AS VARCHAR) END, ',' ORDER BY year) AS labels, COUNT(net_profit_attr_parent) = 0 AS skip FROM annual GROUP BY symbol")
def chart_none_filter(spark: SparkSession, d: str) -> DataFrame:
    """A chart's labels with a value; a chart without any is to be skipped."""
    there = F.col("net_profit_attr_parent").isNotNull()
    labels = F.array_join(F.sort_array(F.collect_list(F.when(there, F.col("year")))).cast("array<string>"), ",")
    rows = fixture(spark, d, "annual").groupBy(F.col("symbol").alias("chart")).agg(F.count_if(there).alias("n_points"), labels.alias("labels"))
    return rows.withColumn("labels", F.when(F.col("n_points") > 0, F.col("labels"))).withColumn("skip", F.col("n_points") == 0)


@query("rows_to_markdown", "SELECT symbol, concat('| year | revenue | net_profit |', chr(10), '| --- | --- | --- |', chr(10), string_agg(concat('| ', CAST(year AS VARCHAR), ' | ', CAST(CAST(floor(revenue) AS BIGINT) AS VARCHAR), ' | ', CAST(CAST(floor(net_profit) AS BIGINT) AS VARCHAR), ' |'), chr(10) ORDER BY year)) AS markdown FROM annual GROUP BY symbol")
def rows_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Each company's years as one markdown table."""
    cell = lambda c: F.floor(c).cast("long").cast("string")
    line = F.concat(F.lit("| "), F.col("year").cast("string"), F.lit(" | "), cell("revenue"), F.lit(" | "), cell("net_profit"), F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("year", line.alias("line")))), lambda x: x["line"])
    head = "| year | revenue | net_profit |\n| --- | --- | --- |\n"
    return fixture(spark, d, "annual").groupBy("symbol").agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("markdown"))
