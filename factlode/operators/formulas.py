"""Financial formulas: a registry of named column expressions, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.functions import r2, r2_sql, ratio, ratio_sql
from factlode.plans.registry import query, register
from factlode.sources.fixtures import fixture

# Every formula reads this frame: annual rows with averages, last year's values and a price.
INPUT_SQL = """SELECT a.symbol, a.year, revenue, cost_of_revenue, selling_expenses, admin_expenses, rd_expenses, finance_expenses,
operating_profit, net_profit, total_assets, total_liabilities, current_assets, current_liabilities, inventory, receivables, interest_expense,
operating_cf, investing_cf_out, eps, coalesce(total_equity, total_assets - total_liabilities) AS equity,
AVG(total_assets) OVER w AS avg_total_assets, AVG(coalesce(total_equity, total_assets - total_liabilities)) OVER w AS avg_equity,
AVG(inventory) OVER w AS avg_inventory, AVG(receivables) OVER w AS avg_receivables,
lag(revenue) OVER p AS prev_revenue, lag(net_profit) OVER p AS prev_net_profit, price,
coalesce(total_equity, total_assets - total_liabilities) / nullif(net_profit / nullif(eps, 0), 0) AS bvps, revenue / nullif(net_profit / nullif(eps, 0), 0) AS rps
FROM annual a LEFT JOIN (SELECT symbol, year, close AS price FROM (SELECT symbol, CAST(year(day) AS INT) + 23 AS year, close, row_number() OVER (PARTITION BY symbol, year(day) ORDER BY day DESC) AS pn FROM prices) z WHERE pn = 1) yp ON yp.symbol = a.symbol AND yp.year = a.year
WINDOW w AS (PARTITION BY a.symbol ORDER BY a.year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), p AS (PARTITION BY a.symbol ORDER BY a.year)"""


def formula_input(spark: SparkSession, d: str) -> DataFrame:
    a = fixture(spark, d, "annual")
    p = Window.partitionBy("symbol").orderBy("year")
    w = p.rowsBetween(-1, 0)
    a = a.withColumn("equity", F.coalesce("total_equity", F.col("total_assets") - F.col("total_liabilities")))
    averages = {f"avg_{c}": F.avg(c).over(w) for c in ("total_assets", "equity", "inventory", "receivables")}
    before = {f"prev_{c}": F.lag(c).over(p) for c in ("revenue", "net_profit")}
    # The year's last close; shares follow from the profit and what it is for each of them.
    last = Window.partitionBy("symbol", "year").orderBy(F.desc("day"))
    prices = fixture(spark, d, "prices").withColumn("year", F.year("day").cast("int") + 23).withColumn("pn", F.row_number().over(last))
    shares = F.nullif(F.col("net_profit") / F.nullif(F.col("eps"), F.lit(0.0)), F.lit(0.0))
    a = a.withColumns(averages | before | {"bvps": F.col("equity") / shares, "rps": F.col("revenue") / shares})
    return a.join(prices.filter("pn = 1").select("symbol", "year", F.col("close").alias("price")), ["symbol", "year"], "left")


#: numerator, denominator, factor, result for a zero denominator
RATIOS: dict[str, tuple[str, str, float, float | None]] = {
    "gross_profit_margin": ("revenue - cost_of_revenue", "revenue", 100, 0.0),
    "net_profit_margin": ("net_profit", "revenue", 100, 0.0),
    "roe": ("net_profit", "avg_equity", 100, 0.0),
    "roa": ("net_profit", "avg_total_assets", 100, 0.0),
    "ebitda_margin": ("operating_profit", "revenue", 100, 0.0),
    "debt_ratio": ("total_liabilities", "total_assets", 100, 0.0),
    "current_ratio": ("current_assets", "current_liabilities", 1, None),
    "quick_ratio": ("current_assets - inventory", "current_liabilities", 1, None),
    "interest_coverage": ("operating_profit", "interest_expense", 1, None),
    "inventory_turnover": ("cost_of_revenue", "avg_inventory", 1, 0.0),
    "receivable_turnover": ("revenue", "avg_receivables", 1, 0.0),
    "total_asset_turnover": ("revenue", "avg_total_assets", 1, 0.0),
    "revenue_growth": ("revenue - prev_revenue", "abs(prev_revenue)", 100, 0.0),
    "net_profit_growth": ("net_profit - prev_net_profit", "abs(prev_net_profit)", 100, 0.0),
    "pe_ratio": ("price", "eps", 1, None),
    "pb_ratio": ("price", "bvps", 1, None),
    "ps_ratio": ("price", "rps", 1, None),
    "sales_expense_ratio": ("selling_expenses", "revenue", 100, 0.0),
    "admin_expense_ratio": ("admin_expenses", "revenue", 100, 0.0),
    "rd_expense_ratio": ("rd_expenses", "revenue", 100, 0.0),
    "finance_expense_ratio": ("finance_expenses", "revenue", 100, 0.0),
    "cf_to_net_profit": ("operating_cf", "net_profit", 100, 0.0),
}
_FORMULAS: dict[str, Column] = {}


def register_formula(name: str, value: Column) -> None:
    """Add a formula of one's own: any column expression over the input frame."""
    _FORMULAS[name] = value


def formula(name: str) -> Column:
    if name in _FORMULAS:
        return _FORMULAS[name]
    if name == "free_cash_flow":
        return r2(F.col("operating_cf") - F.col("investing_cf_out"))
    num, den, k, zero = RATIOS[name]
    return ratio(F.expr(num), F.expr(den), float(k), zero)


def formula_sql(name: str) -> str:
    if name == "free_cash_flow":
        return r2_sql("(operating_cf - investing_cf_out)")
    num, den, k, zero = RATIOS[name]
    return ratio_sql(num, den, float(k), zero)


def values(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("symbol", "year", *(formula(n).alias(n) for n in names))


def values_sql(names: list[str]) -> str:
    return f"SELECT symbol, year, {', '.join(f'{formula_sql(n)} AS {n}' for n in names)} FROM ({INPUT_SQL}) i"


def long_form(df: DataFrame, names: list[str]) -> DataFrame:
    return values(df, names).unpivot(["symbol", "year"], names, "formula", "value")


def long_sql(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT symbol, year, '{n}' AS formula, {formula_sql(n)} AS value FROM ({INPUT_SQL}) i" for n in names)


NAMES = [*RATIOS, "free_cash_flow"]
for _n in NAMES:
    register(f"f_{_n}", lambda spark, d, n=_n: values(formula_input(spark, d), [n]).withColumnRenamed(n, "value"), values_sql([_n]).replace(f" AS {_n} FROM", " AS value FROM"))

DUPONT_SQL = f"SELECT symbol, year, npm, turnover, em, {r2_sql('(npm * turnover * em)')} AS roe, {r2_sql('(npm * turnover * em / 100e0)')} AS roe_ref FROM (SELECT symbol, year, {ratio_sql('net_profit', 'revenue', 100.0)} AS npm, {ratio_sql('revenue', 'avg_total_assets', 1.0)} AS turnover, {ratio_sql('avg_total_assets', 'avg_equity', 1.0)} AS em FROM ({INPUT_SQL}) i) x"


@query("f_dupont", DUPONT_SQL)
def f_dupont(spark: SparkSession, d: str) -> DataFrame:
    parts = formula_input(spark, d).select("symbol", "year", ratio(F.col("net_profit"), F.col("revenue"), 100.0).alias("npm"), ratio(F.col("revenue"), F.col("avg_total_assets")).alias("turnover"), ratio(F.col("avg_total_assets"), F.col("avg_equity")).alias("em"))
    whole = F.col("npm") * F.col("turnover") * F.col("em")
    return parts.select("*", r2(whole).alias("roe"), r2(whole / 100.0).alias("roe_ref"))


TEMPLATES: dict[str, list[str]] = {
    "profitability": ["gross_profit_margin", "net_profit_margin", "roe", "roa"],
    "dupont": ["net_profit_margin", "total_asset_turnover", "roe"],
    "growth": ["revenue_growth", "net_profit_growth"],
    "cash_flow": ["free_cash_flow", "cf_to_net_profit"],
    "risk_scan": ["debt_ratio", "current_ratio", "quick_ratio", "interest_coverage"],
    "cross_company_profit": ["net_profit_margin", "roe", "roa"],
    "multi_dimension": ["gross_profit_margin", "debt_ratio", "revenue_growth", "total_asset_turnover", "free_cash_flow"],
    "valuation": ["pe_ratio", "pb_ratio", "ps_ratio"],
    "operating": ["inventory_turnover", "receivable_turnover", "total_asset_turnover"],
    "cost_analysis": ["sales_expense_ratio", "admin_expense_ratio", "rd_expense_ratio", "finance_expense_ratio"],
    "industry_compare": ["roe", "gross_profit_margin", "debt_ratio"],
}
for _t, _names in TEMPLATES.items():
    register(f"tpl_{_t}", lambda spark, d, names=_names: long_form(formula_input(spark, d), names), long_sql(_names))


@query("formula_batch", f"SELECT symbol, year, COUNT(value) AS succeeded, COUNT(*) - COUNT(value) AS failed FROM ({long_sql(NAMES)}) l GROUP BY symbol, year")
def formula_batch(spark: SparkSession, d: str) -> DataFrame:
    return long_form(formula_input(spark, d), NAMES).groupBy("symbol", "year").agg(F.count("value").alias("succeeded"), (F.count("*") - F.count("value")).alias("failed"))


DERIVED = ["gross_profit_margin", "net_profit_margin", "roe", "roa", "debt_ratio", "free_cash_flow", "ebitda_margin"]


@query("derived_metrics", values_sql(DERIVED).replace(" FROM (", f", {ratio_sql('total_assets', 'equity', 1.0)} AS equity_multiplier, {r2_sql('(revenue - cost_of_revenue)')} AS gross_profit FROM (", 1))
def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    return formula_input(spark, d).select("symbol", "year", *(formula(n).alias(n) for n in DERIVED), ratio(F.col("total_assets"), F.col("equity")).alias("equity_multiplier"), r2(F.col("revenue") - F.col("cost_of_revenue")).alias("gross_profit"))


LIMITS = {"gross_profit_margin": (-100, 100), "net_profit_margin": (-200, 100), "debt_ratio": (0, 100), "roe": (-100, 100), "current_ratio": (0, 20)}


@query("sanity_check", f"SELECT l.symbol, l.year, l.formula, l.value, l.value BETWEEN t.lo AND t.hi AS plausible FROM ({long_sql(list(LIMITS))}) l JOIN (VALUES {', '.join(str((k, float(a), float(b))) for k, (a, b) in LIMITS.items())}) t(formula, lo, hi) ON l.formula = t.formula WHERE l.value IS NOT NULL")
def sanity_check(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in LIMITS.items()], "formula string, lo double, hi double")
    got = long_form(formula_input(spark, d), list(LIMITS)).filter("value IS NOT NULL").join(F.broadcast(limits), "formula")
    return got.select("symbol", "year", "formula", "value", F.col("value").between(F.col("lo"), F.col("hi")).alias("plausible"))


FILL_SQL = f"SELECT symbol, year, total_liabilities, CASE WHEN total_equity IS NULL THEN 'computed' ELSE 'given' END AS equity_fill, {ratio_sql('price', 'bvps', 1.0, None)} AS pb, CASE WHEN total_equity IS NULL THEN 0.8e0 ELSE 0.95e0 END AS confidence, CASE WHEN total_equity IS NULL THEN 'calc:auto_fill' ELSE 'calc' END AS source FROM (SELECT a.symbol, a.year, a.total_liabilities, a.total_equity, a.total_assets / 1000e0 AS price, coalesce(a.total_equity, a.total_assets - a.total_liabilities) / (a.net_profit / a.eps) AS bvps FROM annual a WHERE a.eps <> 0 AND a.net_profit <> 0) x"


def auto_filled(spark: SparkSession, d: str) -> DataFrame:
    a = fixture(spark, d, "annual").filter("eps <> 0 AND net_profit <> 0")
    equity = F.coalesce("total_equity", F.col("total_assets") - F.col("total_liabilities"))
    lacks = F.col("total_equity").isNull()
    bvps = equity / (F.col("net_profit") / F.col("eps"))
    return a.select("symbol", "year", "total_liabilities", F.when(lacks, "computed").otherwise("given").alias("equity_fill"), ratio(F.col("total_assets") / 1000.0, bvps, 1.0, None).alias("pb"), F.when(lacks, 0.8).otherwise(0.95).alias("confidence"), F.when(lacks, "calc:auto_fill").otherwise("calc").alias("source"))


@query("auto_fill", f"SELECT symbol, year, total_liabilities, equity_fill, pb FROM ({FILL_SQL}) f")
def auto_fill(spark: SparkSession, d: str) -> DataFrame:
    return auto_filled(spark, d).drop("confidence", "source")


@query("calc_confidence", f"SELECT symbol, year, confidence, source FROM ({FILL_SQL}) f")
def calc_confidence(spark: SparkSession, d: str) -> DataFrame:
    return auto_filled(spark, d).select("symbol", "year", "confidence", "source")


BANDS = {"roe": (15.0, 8.0), "current_ratio": (2.0, 1.0), "gross_profit_margin": (40.0, 20.0)}


@query("ratio_report", f"SELECT l.symbol, l.year, l.formula, l.value, CASE WHEN l.value IS NULL THEN 'unknown' WHEN l.value >= t.hi THEN 'high' WHEN l.value >= t.lo THEN 'medium' ELSE 'low' END AS band FROM ({long_sql(list(BANDS))}) l JOIN (VALUES {', '.join(str((k, *v)) for k, v in BANDS.items())}) t(formula, hi, lo) ON l.formula = t.formula")
def ratio_report(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([(k, *v) for k, v in BANDS.items()], "formula string, hi double, lo double")
    got = long_form(formula_input(spark, d), list(BANDS)).join(F.broadcast(bands), "formula")
    v = F.col("value")
    return got.select("symbol", "year", "formula", "value", F.when(v.isNull(), "unknown").when(v >= F.col("hi"), "high").when(v >= F.col("lo"), "medium").otherwise("low").alias("band"))


#: metric, is more worse, red and yellow limits
RISKS = [("debt_ratio", True, 70.0, 50.0), ("current_ratio", False, 1.0, 1.5), ("net_profit_margin", False, 0.0, 5.0)]
FLAGS_SQL = f"SELECT l.symbol, l.year, l.formula, l.value, CASE WHEN (t.more AND l.value >= t.red) OR (NOT t.more AND l.value < t.red) THEN 'red' WHEN (t.more AND l.value >= t.yellow) OR (NOT t.more AND l.value < t.yellow) THEN 'yellow' ELSE 'green' END AS flag FROM ({long_sql([r[0] for r in RISKS])}) l JOIN (VALUES {', '.join(str(r) for r in RISKS)}) t(formula, more, red, yellow) ON l.formula = t.formula WHERE l.value IS NOT NULL"


def flagged(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame(RISKS, "formula string, more boolean, red double, yellow double")
    got = long_form(formula_input(spark, d), [r[0] for r in RISKS]).filter("value IS NOT NULL").join(F.broadcast(limits), "formula")
    beyond = lambda c: F.when(F.col("more"), F.col("value") >= F.col(c)).otherwise(F.col("value") < F.col(c))
    return got.select("symbol", "year", "formula", "value", F.when(beyond("red"), "red").when(beyond("yellow"), "yellow").otherwise("green").alias("flag"))


@query("risk_flags", FLAGS_SQL)
def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d)


@query("risk_level", f"SELECT symbol, year, CAST(SUM(CASE WHEN flag = 'red' THEN 1 ELSE 0 END) AS BIGINT) AS reds, CASE WHEN SUM(CASE WHEN flag = 'red' THEN 1 ELSE 0 END) >= 2 THEN 'high' WHEN SUM(CASE WHEN flag = 'red' THEN 1 ELSE 0 END) = 1 THEN 'medium' ELSE 'low' END AS level FROM ({FLAGS_SQL}) f GROUP BY symbol, year")
def risk_level(spark: SparkSession, d: str) -> DataFrame:
    reds = flagged(spark, d).groupBy("symbol", "year").agg(F.count_if(F.col("flag") == "red").alias("reds"))
    return reds.select("symbol", "year", "reds", F.when(F.col("reds") >= 2, "high").when(F.col("reds") == 1, "medium").otherwise("low").alias("level"))


HEALTHY = [("roe", 15.0), ("gross_profit_margin", 30.0), ("debt_ratio", 50.0)]


@query("benchmark_gap", f"SELECT l.symbol, l.year, l.formula, l.value - t.healthy AS gap FROM ({long_sql([h[0] for h in HEALTHY])}) l JOIN (VALUES {', '.join(str(h) for h in HEALTHY)}) t(formula, healthy) ON l.formula = t.formula WHERE l.value IS NOT NULL")
def benchmark_gap(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame(HEALTHY, "formula string, healthy double")
    got = long_form(formula_input(spark, d), [h[0] for h in HEALTHY]).filter("value IS NOT NULL").join(F.broadcast(limits), "formula")
    return got.select("symbol", "year", "formula", (F.col("value") - F.col("healthy")).alias("gap"))


@query("yoy_growth", f"SELECT symbol, year, {ratio_sql('revenue - prev_revenue', 'abs(prev_revenue)', 100.0)} AS growth FROM ({INPUT_SQL}) i WHERE prev_revenue IS NOT NULL")
def yoy_growth(spark: SparkSession, d: str) -> DataFrame:
    return formula_input(spark, d).filter("prev_revenue IS NOT NULL").select("symbol", "year", formula("revenue_growth").alias("growth"))


@query("avg_balance", f"SELECT symbol, year, avg_total_assets, avg_equity, avg_inventory, avg_receivables FROM ({INPUT_SQL}) i")
def avg_balance(spark: SparkSession, d: str) -> DataFrame:
    return formula_input(spark, d).select("symbol", "year", "avg_total_assets", "avg_equity", "avg_inventory", "avg_receivables")


@query("direction_facts", f"SELECT symbol, year, pct, CASE WHEN pct > 1 THEN 'up' WHEN pct < -1 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT symbol, year, {formula_sql('revenue_growth')} AS pct, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS rn FROM ({INPUT_SQL}) i) q WHERE rn = 1 AND pct IS NOT NULL")
def direction_facts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("year"))
    last = formula_input(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("symbol", "year", formula("revenue_growth").alias("pct")).filter("pct IS NOT NULL")
    return last.withColumn("direction", F.when(F.col("pct") > 1, "up").when(F.col("pct") < -1, "down").otherwise("flat"))


@query("cross_company_compare", f"SELECT a.year, a.symbol AS left_symbol, b.symbol AS right_symbol, {r2_sql('(a.net_profit / a.revenue * 100e0)')} AS left_margin, {r2_sql('(b.net_profit / b.revenue * 100e0)')} AS right_margin FROM annual a JOIN annual b ON a.year = b.year AND a.symbol = '000001' AND b.symbol = '000002'")
def cross_company_compare(spark: SparkSession, d: str) -> DataFrame:
    a = fixture(spark, d, "annual").select("symbol", "year", r2(F.col("net_profit") / F.col("revenue") * 100.0).alias("margin"))
    left = a.filter("symbol = '000001'").select("year", F.col("symbol").alias("left_symbol"), F.col("margin").alias("left_margin"))
    return left.join(a.filter("symbol = '000002'").select("year", F.col("symbol").alias("right_symbol"), F.col("margin").alias("right_margin")), "year")


@query("cross_company_compare_all", f"SELECT m.year, m.symbol AS left_symbol, l.symbol AS right_symbol, {r2_sql('(m.net_profit / m.revenue * 100e0)')} AS left_margin, {r2_sql('(l.net_profit / l.revenue * 100e0)')} AS right_margin FROM (SELECT a.*, c.sector FROM annual a JOIN companies c ON a.symbol = c.symbol) m JOIN (SELECT a.*, c.sector, row_number() OVER (PARTITION BY c.sector, a.year ORDER BY a.revenue DESC NULLS LAST, a.symbol) AS place FROM annual a JOIN companies c ON a.symbol = c.symbol) l ON m.sector = l.sector AND m.year = l.year AND l.place = 1")
def cross_company_compare_all(spark: SparkSession, d: str) -> DataFrame:
    """Each company and year beside the company of the highest revenue in its sector, itself if it leads."""
    sectors = fixture(spark, d, "companies").select("symbol", "sector")
    a = fixture(spark, d, "annual").join(sectors, "symbol").select("symbol", "sector", "year", "revenue", r2(F.col("net_profit") / F.col("revenue") * 100.0).alias("margin"))
    leaders = a.groupBy("sector", "year").agg(F.min_by(F.struct("symbol", "margin"), F.struct(F.col("revenue").isNull(), -F.col("revenue"), "symbol")).alias("top"))
    right = leaders.select("sector", "year", F.col("top.symbol").alias("right_symbol"), F.col("top.margin").alias("right_margin"))
    return a.join(right, ["sector", "year"]).select("year", F.col("symbol").alias("left_symbol"), "right_symbol", F.col("margin").alias("left_margin"), "right_margin")


@query("industry_peers", f"SELECT c.sector, i.symbol, i.year, {formula_sql('roe')} AS roe, COUNT(*) OVER (PARTITION BY c.sector, i.year) AS peers FROM ({INPUT_SQL}) i JOIN companies c ON i.symbol = c.symbol")
def industry_peers(spark: SparkSession, d: str) -> DataFrame:
    joined = formula_input(spark, d).join(fixture(spark, d, "companies").select("symbol", "sector"), "symbol")
    return joined.select("sector", "symbol", "year", formula("roe").alias("roe"), F.count("*").over(Window.partitionBy("sector", "year")).alias("peers"))
