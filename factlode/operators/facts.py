"""Facts: lookups, upserts, backfills, fallbacks and lineage over the long fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.functions import r2, r2_sql
from factlode.plans.registry import query
from factlode.sources.fixtures import METRICS, base, fixture

Q4_FIRST = "ORDER BY CASE WHEN quarter = 'Q4' THEN 0 ELSE 1 END, quarter DESC"
KEYS = ("revenue", "net_profit", "total_equity")
YEARS = (2019, 2020, 2021)


def latest_quarter(df: DataFrame, by: list[str]) -> DataFrame:
    """One row for each key: the fourth quarter where there is one, else the latest quarter."""
    w = Window.partitionBy(*by).orderBy(F.when(F.col("quarter") == "Q4", 0).otherwise(1), F.desc("quarter"))
    return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def batch_lookup(facts: DataFrame, years, keys, symbols: DataFrame | None = None) -> DataFrame:
    """One value for each (symbol, year, metric), for many symbols in one plan."""
    some = facts.filter(F.col("year").isin(*years) & F.col("metric_key").isin(*keys))
    some = some if symbols is None else some.join(symbols, "symbol", "left_semi")
    return latest_quarter(some, ["symbol", "year", "metric_key"]).select("symbol", "year", "metric_key", "metric_value")


IN_KEYS, IN_YEARS = str(KEYS), str(YEARS)


@query("scan_facts", "SELECT metric_key, COUNT(*) AS n, COUNT(DISTINCT symbol) AS symbols FROM facts GROUP BY metric_key")
def scan_facts(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "facts").groupBy("metric_key").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"))


@query("fact_batch_lookup", f"SELECT symbol, year, metric_key, metric_value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year, metric_key {Q4_FIRST}) AS rn FROM facts WHERE year IN {IN_YEARS} AND metric_key IN {IN_KEYS}) q WHERE rn = 1")
def fact_batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    return batch_lookup(fixture(spark, d, "facts"), YEARS, KEYS)


@query("fact_multi_lookup", f"SELECT symbol, year, MAX(CASE WHEN metric_key = 'revenue' THEN metric_value END) AS revenue, MAX(CASE WHEN metric_key = 'net_profit' THEN metric_value END) AS net_profit FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year, metric_key {Q4_FIRST}) AS rn FROM facts WHERE metric_key IN ('revenue', 'net_profit') AND symbol IN (SELECT symbol FROM companies WHERE market = 'ASIA')) q WHERE rn = 1 GROUP BY symbol, year")
def fact_multi_lookup(spark: SparkSession, d: str) -> DataFrame:
    asia = fixture(spark, d, "companies").filter("market = 'ASIA'")
    found = batch_lookup(fixture(spark, d, "facts"), range(2015, 2030), ("revenue", "net_profit"), asia)
    return found.groupBy("symbol", "year").pivot("metric_key", ["revenue", "net_profit"]).agg(F.first("metric_value"))


@query("q4_preferred", f"SELECT symbol, year, metric_key, quarter, metric_value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year, metric_key {Q4_FIRST}) AS rn FROM facts) q WHERE rn = 1")
def q4_preferred(spark: SparkSession, d: str) -> DataFrame:
    return latest_quarter(fixture(spark, d, "facts"), ["symbol", "year", "metric_key"]).select("symbol", "year", "metric_key", "quarter", "metric_value")


@query("parse_report_date", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CASE month(o_orderdate) WHEN 3 THEN 'Q1' WHEN 6 THEN 'Q2' WHEN 9 THEN 'Q3' WHEN 12 THEN 'Q4' ELSE 'annual' END AS quarter FROM orders")
def parse_report_date(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    digits = F.regexp_extract(text, r"^(\d{4})-?(\d{2})-?\d{2}$", 2)
    quarter = F.when(digits == "03", "Q1").when(digits == "06", "Q2").when(digits == "09", "Q3").when(digits == "12", "Q4").otherwise("annual")
    return base(spark, d, "orders").select("o_orderkey", F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int").alias("year"), quarter.alias("quarter"))


@query("unpivot_statements", "SELECT symbol, year, quarter, metric_key, metric_value FROM facts WHERE metric_key IN ('revenue', 'net_profit', 'total_assets') AND year >= 2020")
def unpivot_statements(spark: SparkSession, d: str) -> DataFrame:
    named = {"Of which: Revenue": "revenue", "Less: Net profit": "net_profit", "Total assets": "total_assets"}
    wide = fixture(spark, d, "facts_wide").select("symbol", "year", "quarter", *(F.col(v).cast("string").alias(k) for k, v in named.items()), F.lit("n/a").alias("Remark"))
    long = wide.unpivot(["symbol", "year", "quarter"], [F.col(f"`{k}`") for k in [*named, "Remark"]], "account", "text")
    clean = F.lower(F.regexp_replace("account", "^(Of which|Less|Add): ", ""))
    names = spark.createDataFrame([("revenue", "revenue"), ("net profit", "net_profit"), ("total assets", "total_assets")], "account_name string, metric_key string")
    found = long.filter("year >= 2020").withColumn("account_name", clean).join(F.broadcast(names), "account_name")
    return found.select("symbol", "year", "quarter", "metric_key", F.col("text").try_cast("double").alias("metric_value")).filter("metric_value IS NOT NULL")


@query("statement_sections", f"SELECT symbol, {r2_sql('revenue / 100000.0e0')} AS revenue, {r2_sql('total_assets / 100000.0e0')} AS total_assets, {r2_sql('operating_cf / 100000.0e0')} AS operating_cf FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN quarter = 'Q4' THEN 0 ELSE 1 END, year DESC, quarter DESC) AS rn FROM facts_wide) q WHERE rn = 1")
def statement_sections(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.when(F.col("quarter") == "Q4", 0).otherwise(1), F.desc("year"), F.desc("quarter"))
    latest = fixture(spark, d, "facts_wide").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return latest.select("symbol", *(r2(F.col(m) / 100000.0).alias(m) for m in ("revenue", "total_assets", "operating_cf")))


@query("normalize_accounts", "SELECT CASE metric_key WHEN 'total_equity' THEN 'equity' WHEN 'total_assets' THEN 'assets' ELSE metric_key END AS account, COUNT(*) AS n FROM facts WHERE metric_key NOT IN ('eps', 'receivables') GROUP BY 1")
def normalize_accounts(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("total_equity", "equity"), ("total_assets", "assets")], "metric_key string, mapped string")
    kept = fixture(spark, d, "facts").filter(~F.col("metric_key").isin("eps", "receivables")).join(F.broadcast(names), "metric_key", "left")
    return kept.groupBy(F.coalesce("mapped", "metric_key").alias("account")).agg(F.count("*").alias("n"))


def last_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the one last in ``order``, such as batch, then arrival in the batch."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of both by key, the highest ``order`` winning."""
    return last_of(old.unionByName(new), keys, *order)


UPSERT_SQL = """SELECT symbol, year, quarter, metric_key, metric_value, source FROM (
SELECT *, row_number() OVER (PARTITION BY symbol, year, quarter, metric_key ORDER BY seq DESC) AS rn FROM (
SELECT symbol, year, quarter, metric_key, metric_value, source, 0 AS seq FROM facts
UNION ALL SELECT symbol, year, quarter, metric_key, metric_value * 2, '{source}', 1 FROM facts WHERE metric_key = 'revenue' AND year >= 2021
UNION ALL SELECT symbol, year + 10, quarter, metric_key, metric_value, '{source}', 1 FROM facts WHERE metric_key = 'eps') u) q WHERE rn = 1"""


def _upserted(spark: SparkSession, d: str, source: str) -> DataFrame:
    facts = fixture(spark, d, "facts")
    new = facts.filter("metric_key = 'revenue' AND year >= 2021").withColumn("metric_value", F.col("metric_value") * 2)
    more = facts.filter("metric_key = 'eps'").withColumn("year", F.col("year") + 10)
    fresh = new.unionByName(more).withColumn("source", F.lit(source)).withColumn("seq", F.lit(1))
    return upsert(facts.withColumn("seq", F.lit(0)), fresh, ["symbol", "year", "quarter", "metric_key"], "seq").drop("seq")


@query("facts_upsert", UPSERT_SQL.format(source="batch"))
def facts_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d, "batch")


@query("facts_upsert_arrivals", """SELECT symbol, year, quarter, metric_key, metric_value, source FROM (
SELECT *, row_number() OVER (PARTITION BY symbol, year, quarter, metric_key ORDER BY seq DESC, arrival DESC) AS rn FROM (
SELECT symbol, year, quarter, metric_key, metric_value, source, 0 AS seq, 0 AS arrival FROM facts
UNION ALL SELECT symbol, year, quarter, metric_key, metric_value * 2, 'batch', 1, 1 FROM facts WHERE metric_key = 'revenue'
UNION ALL SELECT symbol, year, quarter, metric_key, metric_value * 3, 'batch', 1, 2 FROM facts WHERE metric_key = 'revenue' AND symbol % 2 = 0
UNION ALL SELECT symbol, year + 10, quarter, metric_key, metric_value, 'batch', 1, 3 FROM facts WHERE metric_key = 'eps') u) q WHERE rn = 1""".replace("symbol % 2", "CAST(symbol AS INT) % 2"))
def facts_upsert_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """A batch that names a key twice: its last arrival wins. Old and new rows come from one reading, met by one window."""
    revenue, even = F.col("metric_key") == "revenue", F.col("symbol").cast("int") % 2 == 0
    row = lambda seq, arrival, year, value, source: F.struct(F.lit(seq).alias("seq"), F.lit(arrival).alias("arrival"), year.alias("year"), value.alias("metric_value"), source.alias("source"))
    year, value, batch = F.col("year"), F.col("metric_value"), F.lit("batch")
    versions = F.array(
        row(0, 0, year, value, F.col("source")), F.when(revenue, row(1, 1, year, value * 2, batch)),
        F.when(revenue & even, row(1, 2, year, value * 3, batch)), F.when(F.col("metric_key") == "eps", row(1, 3, year + 10, value, batch)),
    )
    rows = fixture(spark, d, "facts").select("symbol", "quarter", "metric_key", F.explode(F.filter(versions, lambda v: v.isNotNull())).alias("v")).select("symbol", "quarter", "metric_key", "v.*")
    return last_of(rows, ["symbol", "year", "quarter", "metric_key"], "seq", "arrival").select("symbol", "year", "quarter", "metric_key", "metric_value", "source")


@query("table_facts_sink", UPSERT_SQL.format(source="rule_extraction"))
def table_facts_sink(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d, "rule_extraction")


FALLBACK = {"net_profit_attr_parent": "net_profit", "equity_attr_parent": "total_equity"}


def with_fallback(annual: DataFrame) -> DataFrame:
    """Missing metrics from a substitute, else from an expression, with the source of each."""
    out = annual
    for key, simple in FALLBACK.items():
        computed = F.col("total_assets") - F.col("total_liabilities") if simple == "total_equity" else F.lit(None).cast("double")
        out = out.withColumn(f"{key}_source", F.when(F.col(key).isNotNull(), "sql").when(F.col(simple).isNotNull(), f"sql:fallback:{simple}").when(computed.isNotNull(), "sql:computed:total_assets-total_liabilities"))
        out = out.withColumn(key, F.coalesce(key, simple, computed))
    return out


FALLBACK_SQL = """SELECT symbol, year, revenue, net_profit, total_assets, total_liabilities, total_equity,
coalesce(net_profit_attr_parent, net_profit) AS net_profit_attr_parent,
CASE WHEN net_profit_attr_parent IS NOT NULL THEN 'sql' WHEN net_profit IS NOT NULL THEN 'sql:fallback:net_profit' END AS net_profit_attr_parent_source,
coalesce(equity_attr_parent, total_equity, total_assets - total_liabilities) AS equity_attr_parent,
CASE WHEN equity_attr_parent IS NOT NULL THEN 'sql' WHEN total_equity IS NOT NULL THEN 'sql:fallback:total_equity' ELSE 'sql:computed:total_assets-total_liabilities' END AS equity_attr_parent_source FROM annual"""


@query("fallback_chain", FALLBACK_SQL)
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    got = with_fallback(fixture(spark, d, "annual"))
    return got.select("symbol", "year", "revenue", "net_profit", "total_assets", "total_liabilities", "total_equity", *(c for k in FALLBACK for c in (k, f"{k}_source")))


def _score(source: Column) -> Column:
    return F.when(source == "sql", 0.99).when(source.startswith("formula"), 0.9).when(source.startswith("sql:fallback"), 0.8).when(source.startswith("sql:computed"), 0.7).otherwise(0.85)


SCORE_SQL = "(CASE WHEN {0} = 'sql' THEN 99 WHEN {0} LIKE 'sql:fallback%' THEN 80 WHEN {0} LIKE 'sql:computed%' THEN 70 ELSE 85 END)"


@query("source_confidence", f"SELECT symbol, {r2_sql('(SUM(' + SCORE_SQL.format('net_profit_attr_parent_source') + ' + ' + SCORE_SQL.format('equity_attr_parent_source') + ') / (COUNT(*) * 200.0e0))')} AS confidence FROM ({FALLBACK_SQL}) f GROUP BY symbol")
def source_confidence(spark: SparkSession, d: str) -> DataFrame:
    got = with_fallback(fixture(spark, d, "annual"))
    points = F.sum(sum((F.round(_score(F.col(f"{k}_source")) * 100).cast("long") for k in FALLBACK), F.lit(0)))
    return got.groupBy("symbol").agg(r2(points / (F.count("*") * 200.0)).alias("confidence"))


@query("completeness_confidence", f"SELECT symbol, year, {r2_sql('(0.75e0 + 0.24e0 * COUNT(*) / 23e0)')} AS confidence FROM (SELECT DISTINCT symbol, year, metric_key FROM facts) f GROUP BY symbol, year")
def completeness_confidence(spark: SparkSession, d: str) -> DataFrame:
    found = fixture(spark, d, "facts").select("symbol", "year", "metric_key").distinct()
    return found.groupBy("symbol", "year").agg(r2(F.lit(0.75) + F.lit(0.24) * F.count("*") / float(len(METRICS))).alias("confidence"))


@query("backfill_net_profit", "SELECT symbol, year, quarter, 'net_profit_attr_parent' AS metric_key, metric_value, concat(source, ':backfill') AS source FROM facts WHERE metric_key = 'net_profit' AND symbol NOT IN (SELECT symbol FROM facts WHERE metric_key = 'net_profit_attr_parent')")
def backfill_net_profit(spark: SparkSession, d: str) -> DataFrame:
    return copied(fixture(spark, d, "facts"), "net_profit", "net_profit_attr_parent")


def copied(facts: DataFrame, source: str, target: str) -> DataFrame:
    """Rows of ``source`` as ``target`` for symbols that have the one and not the other."""
    have = facts.filter(F.col("metric_key") == target).select("symbol").distinct()
    rows = facts.filter(F.col("metric_key") == source).join(have, "symbol", "left_anti")
    return rows.select("symbol", "year", "quarter", F.lit(target).alias("metric_key"), "metric_value", F.concat("source", F.lit(":backfill")).alias("source"))


EQUITY_SQL = "SELECT symbol, year, quarter, 'total_equity' AS metric_key, total_assets - total_liabilities AS metric_value, 'computed:backfill' AS source FROM facts_wide WHERE total_assets IS NOT NULL AND total_liabilities IS NOT NULL AND symbol NOT IN (SELECT symbol FROM facts_wide WHERE total_equity IS NOT NULL OR equity_attr_parent IS NOT NULL)"


def computed_equity(facts: DataFrame) -> DataFrame:
    have = facts.filter(F.col("metric_key").isin("total_equity", "equity_attr_parent")).select("symbol").distinct()
    sides = facts.filter(F.col("metric_key").isin("total_assets", "total_liabilities")).join(have, "symbol", "left_anti")
    wide = sides.groupBy("symbol", "year", "quarter").pivot("metric_key", ["total_assets", "total_liabilities"]).agg(F.first("metric_value"))
    value = F.col("total_assets") - F.col("total_liabilities")
    return wide.filter(value.isNotNull()).select("symbol", "year", "quarter", F.lit("total_equity").alias("metric_key"), value.alias("metric_value"), F.lit("computed:backfill").alias("source"))


@query("backfill_equity", EQUITY_SQL)
def backfill_equity(spark: SparkSession, d: str) -> DataFrame:
    return computed_equity(fixture(spark, d, "facts"))


@query("backfill_equity_parent", f"SELECT symbol, year, quarter, 'equity_attr_parent' AS metric_key, metric_value, concat(source, ':backfill') AS source FROM (SELECT symbol, year, quarter, metric_key, metric_value, source FROM facts WHERE metric_key = 'total_equity' UNION ALL {EQUITY_SQL}) e WHERE symbol NOT IN (SELECT symbol FROM facts WHERE metric_key = 'equity_attr_parent')")
def backfill_equity_parent(spark: SparkSession, d: str) -> DataFrame:
    facts = fixture(spark, d, "facts")
    return copied(facts.unionByName(computed_equity(facts)), "total_equity", "equity_attr_parent")


@query("backfill_rollback", "SELECT metric_key, COUNT(*) AS n FROM facts GROUP BY metric_key")
def backfill_rollback(spark: SparkSession, d: str) -> DataFrame:
    facts = fixture(spark, d, "facts")
    filled = facts.unionByName(copied(facts, "net_profit", "net_profit_attr_parent"))
    return filled.filter(~F.col("source").like("%:backfill%")).groupBy("metric_key").agg(F.count("*").alias("n"))


@query("set_difference_keys", "SELECT DISTINCT symbol FROM facts WHERE metric_key = 'total_equity' AND symbol NOT IN (SELECT symbol FROM facts WHERE metric_key = 'equity_attr_parent')")
def set_difference_keys(spark: SparkSession, d: str) -> DataFrame:
    facts = fixture(spark, d, "facts")
    return facts.filter("metric_key = 'total_equity'").select("symbol").subtract(facts.filter("metric_key = 'equity_attr_parent'").select("symbol"))


@query("union_dedupe", "SELECT symbol, year, metric_key, metric_value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year, metric_key ORDER BY quarter) AS rn FROM facts) q WHERE rn = 1")
def union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol", "year", "metric_key").orderBy("quarter")
    return fixture(spark, d, "facts").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("symbol", "year", "metric_key", "metric_value")


@query("overview_pivot", "SELECT metric_key, " + ", ".join(f"SUM(CASE WHEN year = {y} THEN 1 ELSE 0 END) AS y{y}" for y in range(2018, 2025)) + " FROM facts GROUP BY metric_key")
def overview_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = fixture(spark, d, "facts").groupBy("metric_key").pivot("year", list(range(2018, 2025))).count()
    return wide.select("metric_key", *(F.coalesce(F.col(f"`{y}`"), F.lit(0)).alias(f"y{y}") for y in range(2018, 2025)))


@query("group_extremes", "SELECT symbol, COUNT(*) AS n, arg_max(metric_key, metric_value) AS best, arg_min(metric_key, metric_value) AS worst FROM facts WHERE year = 2020 AND quarter = 'Q1' AND metric_key IN ('revenue', 'cost_of_revenue', 'income_tax') GROUP BY symbol")
def group_extremes(spark: SparkSession, d: str) -> DataFrame:
    some = fixture(spark, d, "facts").filter("year = 2020 AND quarter = 'Q1'").filter(F.col("metric_key").isin("revenue", "cost_of_revenue", "income_tax"))
    return some.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("metric_key", "metric_value").alias("best"), F.min_by("metric_key", "metric_value").alias("worst"))


BEST, WORST = "metric_value DESC NULLS LAST, metric_key", "metric_value ASC NULLS LAST, metric_key"


@query("group_extremes_all", f"SELECT symbol, year, quarter, COUNT(*) AS n, MAX(CASE WHEN hi = 1 AND metric_value IS NOT NULL THEN metric_key END) AS best, MAX(CASE WHEN lo = 1 AND metric_value IS NOT NULL THEN metric_key END) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year, quarter ORDER BY {BEST}) AS hi, row_number() OVER (PARTITION BY symbol, year, quarter ORDER BY {WORST}) AS lo FROM facts) q GROUP BY symbol, year, quarter")
def group_extremes_all(spark: SparkSession, d: str) -> DataFrame:
    """Of all metrics in each quarter; of equal values, the first metric by name. Nulls only count."""
    v = F.col("metric_value")
    first = lambda by: F.min_by("metric_key", F.when(v.isNotNull(), F.struct(by, F.col("metric_key"))))
    return fixture(spark, d, "facts").groupBy("symbol", "year", "quarter").agg(F.count("*").alias("n"), first((-v).alias("v")).alias("best"), first(v.alias("v")).alias("worst"))


@query("conflict_detect", "SELECT symbol, year, metric_key, first_value, COUNT(*) AS n, SUM(CASE WHEN abs(metric_value - first_value) / greatest(abs(first_value), 0.01e0) > 0.05e0 THEN 1 ELSE 0 END) AS conflicts FROM (SELECT *, first_value(metric_value) OVER (PARTITION BY symbol, year, metric_key ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_value FROM facts WHERE metric_key IN ('revenue', 'eps')) q GROUP BY symbol, year, metric_key, first_value")
def conflict_detect(spark: SparkSession, d: str) -> DataFrame:
    return conflicts(fixture(spark, d, "facts").filter(F.col("metric_key").isin("revenue", "eps")))


def conflicts(facts: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "year", "metric_key").orderBy("quarter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = facts.withColumn("first_value", F.first("metric_value").over(w))
    off = F.abs(F.col("metric_value") - F.col("first_value")) / F.greatest(F.abs("first_value"), F.lit(0.01)) > 0.05
    return rows.groupBy("symbol", "year", "metric_key", "first_value").agg(F.count("*").alias("n"), F.count_if(off).alias("conflicts"))


@query("conflict_detect_all", "SELECT symbol, year, metric_key, first_value, COUNT(*) AS n, SUM(CASE WHEN abs(metric_value - first_value) / greatest(abs(first_value), 0.01e0) > 0.05e0 THEN 1 ELSE 0 END) AS conflicts FROM (SELECT *, first_value(metric_value) OVER (PARTITION BY symbol, year, metric_key ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_value FROM facts) q GROUP BY symbol, year, metric_key, first_value")
def conflict_detect_all(spark: SparkSession, d: str) -> DataFrame:
    return conflicts(fixture(spark, d, "facts"))
