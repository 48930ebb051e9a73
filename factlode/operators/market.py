"""Prices: as-of joins, changes, rolling ranges, quotes and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.functions import r2, r2_sql, ratio, ratio_sql
from factlode.plans.registry import query
from factlode.sources.fixtures import base, fixture



def by_day():
    return Window.partitionBy("symbol").orderBy("day")


TARGET = "1996-06-15"
CHANGE_SQL = f"SELECT symbol, day, close, close - prev AS change, {r2_sql('((close - prev) / prev * 100e0)')} AS change_pct FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prev FROM prices) p"


def changes(prices: DataFrame) -> DataFrame:
    p = prices.withColumn("prev", F.lag("close").over(by_day()))
    diff = F.col("close") - F.col("prev")
    return p.select("symbol", "day", "close", "volume", diff.alias("change"), r2(diff / F.col("prev") * 100.0).alias("change_pct"))


@query("price_change", CHANGE_SQL)
def price_change(spark: SparkSession, d: str) -> DataFrame:
    return changes(fixture(spark, d, "prices")).drop("volume")


@query("price_asof", f"SELECT symbol, coalesce(MAX(CASE WHEN day <= DATE '{TARGET}' THEN day END), MIN(day)) AS day, coalesce(arg_max(close, day) FILTER (day <= DATE '{TARGET}'), arg_min(close, day)) AS close FROM prices GROUP BY symbol")
def price_asof(spark: SparkSession, d: str) -> DataFrame:
    before = F.when(F.col("day") <= F.lit(TARGET).cast("date"), F.col("day"))
    return fixture(spark, d, "prices").groupBy("symbol").agg(F.coalesce(F.max(before), F.min("day")).alias("day"), F.coalesce(F.max_by("close", before), F.min_by("close", "day")).alias("close"))


@query("valuation_join", f"SELECT a.symbol, a.year, {ratio_sql('p.close', 'a.eps', 1.0, None)} AS pe FROM annual a JOIN (SELECT symbol, CAST(year(day) AS INT) + 23 AS year, arg_max(close, day) AS close FROM prices GROUP BY 1, 2) p ON a.symbol = p.symbol AND a.year = p.year")
def valuation_join(spark: SparkSession, d: str) -> DataFrame:
    last = fixture(spark, d, "prices").groupBy("symbol", (F.year("day") + 23).alias("year")).agg(F.max_by("close", "day").alias("close"))
    return fixture(spark, d, "annual").join(last, ["symbol", "year"]).select("symbol", "year", ratio(F.col("close"), F.col("eps"), 1.0, None).alias("pe"))


@query("range_52w", "SELECT symbol, day, MAX(high) OVER w AS high_52w, MIN(low) OVER w AS low_52w FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)")
def range_52w(spark: SparkSession, d: str) -> DataFrame:
    w = by_day().rowsBetween(-249, 0)
    return fixture(spark, d, "prices").select("symbol", "day", F.max("high").over(w).alias("high_52w"), F.min("low").over(w).alias("low_52w"))


@query("price_history_tail", "SELECT symbol, day, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM prices) p WHERE rn <= 30")
def price_history_tail(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("day"))
    return fixture(spark, d, "prices").withColumn("rn", F.row_number().over(w)).filter("rn <= 30").select("symbol", "day", "close")


QUOTE_SQL = f"SELECT symbol, day, close, change, change_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM ({CHANGE_SQL}) c) q WHERE rn = 1"


def quotes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("day"))
    return changes(fixture(spark, d, "prices")).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("symbol", "day", "close", "change", "change_pct")


@query("stock_quote", f"SELECT q.*, w.high_52w, w.low_52w FROM ({QUOTE_SQL}) q JOIN (SELECT symbol, day, MAX(high) OVER w AS high_52w, MIN(low) OVER w AS low_52w FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)) w ON q.symbol = w.symbol AND q.day = w.day")
def stock_quote(spark: SparkSession, d: str) -> DataFrame:
    return quotes(spark, d).join(range_52w(spark, d), ["symbol", "day"])


@query("index_quote", f"SELECT c.name, q.* FROM ({QUOTE_SQL}) q JOIN companies c ON q.symbol = c.symbol WHERE c.market = 'EUROPE'")
def index_quote(spark: SparkSession, d: str) -> DataFrame:
    return quotes(spark, d).join(fixture(spark, d, "companies").filter("market = 'EUROPE'").select("symbol", "name"), "symbol")


CAL_SQL = "SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderpriority LIKE '1%' THEN 'dividend' ELSE 'earnings' END AS kind FROM orders"


@query("calendar_merge", f"SELECT symbol, day, kind FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day, kind) AS rn FROM (SELECT DISTINCT symbol, day, kind FROM ({CAL_SQL}) c WHERE kind <> 'dividend' UNION ALL SELECT o_custkey, CAST(MAX(o_orderdate) AS DATE), 'dividend' FROM orders GROUP BY 1) m WHERE day > DATE '1996-01-01') q WHERE rn <= 3")
def calendar_merge(spark: SparkSession, d: str) -> DataFrame:
    o = base(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderpriority").startswith("1"), "dividend").otherwise("earnings").alias("kind"))
    vendor = o.groupBy("symbol").agg(F.max("day").alias("day")).withColumn("kind", F.lit("dividend"))
    merged = o.filter("kind <> 'dividend'").distinct().unionByName(vendor).filter(F.col("day") > F.lit("1996-01-01").cast("date"))
    w = Window.partitionBy("symbol").orderBy("day", "kind")
    return merged.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("symbol", "day", "kind")


@query("default_calendar", "SELECT c_custkey AS symbol, k.kind FROM customer, (VALUES ('earnings'), ('meeting')) k(kind) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def default_calendar(spark: SparkSession, d: str) -> DataFrame:
    none = base(spark, d, "customer").join(base(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return none.select(F.col("c_custkey").alias("symbol"), F.explode(F.array(F.lit("earnings"), F.lit("meeting"))).alias("kind"))


@query("symbol_normalize", "SELECT symbol, concat(symbol, CASE WHEN substr(symbol, 6, 1) IN ('6', '7', '8', '9') THEN '.SH' ELSE '.SZ' END) AS full_symbol FROM companies")
def symbol_normalize(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.concat("symbol", F.lit(".HK")), r"\.(SH|SZ|HK)$", "")
    suffix = F.when(F.substring(bare, 6, 1).isin("6", "7", "8", "9"), ".SH").otherwise(".SZ")
    return fixture(spark, d, "companies").select(bare.alias("symbol"), F.concat(bare, suffix).alias("full_symbol"))


@query("company_list", "SELECT symbol, MIN(name) AS name FROM companies GROUP BY symbol ORDER BY symbol")
def company_list(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "companies").groupBy("symbol").agg(F.min("name").alias("name")).orderBy("symbol")
