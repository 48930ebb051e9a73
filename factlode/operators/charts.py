"""Charts: which kind suits a chart's points, and labels fit to be shown.

A chart is its rows of (chart, pos, label, value). Its shape is counted by one grouping; the kind is then
an ordered choice over the counts. A row without a label is no point, so a chart may have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.plans.registry import query
from factlode.sources.fixtures import fixture

# Words of amounts and of ratios in labels, names of labels, and abbreviations before a bracket.
AMOUNTS = ("营收", "收入", "成本", "净利", "利润", "现金流", "资产", "负债", "权益", "资本", "投入", "费用", "支出", "毛利", "存货", "应收", "应付", "借款", "投资", "筹资")
RATIOS = ("率", "增速", "占比", "倍数", "周转", "ROE", "ROA")
LABELS = {
    "revenue": "营业收入", "cost": "营业成本", "net_profit": "净利润", "total_assets": "总资产", "equity": "净资产",
    "total_liabilities": "总负债", "current_assets": "流动资产", "current_liabilities": "流动负债", "gross_profit_margin": "毛利率",
    "net_profit_margin": "净利率", "roe": "净资产收益率", "roa": "总资产收益率", "debt_ratio": "资产负债率", "current_ratio": "流动比率",
    "quick_ratio": "速动比率", "total_asset_turnover": "总资产周转率", "inventory_turnover": "存货周转率", "revenue_growth": "营收增长率",
    "net_profit_growth": "净利润增长率", "operating_cf": "经营现金流", "free_cash_flow": "自由现金流", "pe_ratio": "市盈率", "pb_ratio": "市净率",
    "cf_to_net_profit": "经营现金流/净利润比率", "asset_turnover": "资产周转率", "equity_multiplier": "权益乘数", "ps_ratio": "市销率",
    "ebitda_margin": "EBITDA率", "ebitda": "EBITDA", "interest_coverage": "利息保障倍数", "sales_expense_ratio": "销售费用率",
    "admin_expense_ratio": "管理费用率", "rd_expense_ratio": "研发费用率", "finance_expense_ratio": "财务费用率", "sales_expense": "销售费用",
    "admin_expense": "管理费用", "rd_expense": "研发费用", "finance_expense": "财务费用", "investing_cf": "投资现金流", "financing_cf": "筹资现金流",
    "capital_expenditure": "资本支出", "interest_expense": "利息费用", "inventory": "存货", "receivables": "应收账款", "eps": "每股收益",
    "bvps": "每股净资产", "stock_price": "股价", "revenue_per_share": "每股营收", "total_shares": "总股本",
}
SHORT = ("ROE", "ROA", "PE", "PB", "PS", "FCF", "EBITDA", "EPS")

#: Kind and confidence by the first rule that a chart's counts meet; both engines read the same rules.
RULES = (
    ("n = 0", "bar", 0.3),
    ("n_pos > 0 AND n_neg > 0 AND n_years < 2", "bar", 0.85),
    ("n_amount >= greatest(1, n * 0.6) AND n_years < 2", "bar", 0.9),
    ("n_values >= 3 AND top > 10 * greatest(least_abs, 0.01) AND n_percent < n_values * 0.5", "radar", 0.85),
    ("n_values BETWEEN 1 AND 6 AND n_pos = n_values AND n_years < 2 AND total > 80 AND total < 120", "pie", 0.85),
    ("n_years >= 2 AND dims = 1", "line", 0.95),
    ("n_years >= 2", "dual_axis", 0.85),
    ("dims BETWEEN 3 AND 6", "radar", 0.9),
    ("dims > 6", "bar", 0.85),
    ("dims >= 2", "bar", 0.8),
)
_YEAR, _TASK = "_[0-9]{4}$", "^(task[0-9]+)_"


def shapes(points: DataFrame) -> DataFrame:
    """What the rules ask of each chart: n, n_years, dims, n_values, n_pos, n_neg, n_amount, n_percent, top, least_abs, total.

    The total is summed as a decimal, so it does not hang on the order of rows; values of 10^20 and more make it null,
    and no pie then."""
    label, value = F.col("label"), F.col("value")
    there, size = label.isNotNull(), F.abs(F.col("value"))
    value = F.when(there, value)
    one = lambda c: F.count_if(there & c)
    amount = label.rlike("|".join(AMOUNTS)) & ~label.rlike("|".join(RATIOS))
    return points.groupBy("chart").agg(
        F.count("label").alias("n"), one(label.rlike(_YEAR)).alias("n_years"), F.countDistinct(F.regexp_replace(label, _YEAR, "")).alias("dims"),
        F.count(value).alias("n_values"), one(value > 0).alias("n_pos"), one(value < 0).alias("n_neg"), one(amount).alias("n_amount"),
        one((size > 0) & (size <= 100)).alias("n_percent"), F.max(F.when(there & (size > 0), size)).alias("top"),
        F.min(F.when(there & (size > 0), size)).alias("least_abs"), F.sum(F.expr("CASE WHEN label IS NOT NULL THEN try_cast(value AS DECIMAL(24,4)) END")).alias("total"),
    )


def _case(pick: int, other: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {quote(r[pick])}" for r in RULES) + f" ELSE {other} END"


def recommend(points: DataFrame) -> DataFrame:
    """chart, chart_type, confidence."""
    return shapes(points).select("chart", F.expr(_case(1, "'bar'")).alias("chart_type"), F.expr(_case(2, "CAST(0.4 AS DOUBLE)")).alias("confidence"))


@query("chart_recommend", f"""SELECT chart, {_case(1, "'bar'")} AS chart_type, {_case(2, "CAST(0.4 AS DOUBLE)")} AS confidence FROM (SELECT chart, COUNT(label) AS n,
COUNT(*) FILTER (regexp_matches(label, '{_YEAR}')) AS n_years, COUNT(DISTINCT regexp_replace(label, '{_YEAR}', '')) AS dims, COUNT(value) FILTER (label IS NOT NULL) AS n_values,
COUNT(*) FILTER (label IS NOT NULL AND value > 0) AS n_pos, COUNT(*) FILTER (label IS NOT NULL AND value < 0) AS n_neg,
COUNT(*) FILTER (regexp_matches(label, '{"|".join(AMOUNTS)}') AND NOT regexp_matches(label, '{"|".join(RATIOS)}')) AS n_amount,
COUNT(*) FILTER (label IS NOT NULL AND value <> 0 AND abs(value) <= 100) AS n_percent, MAX(abs(value)) FILTER (label IS NOT NULL AND value <> 0) AS top,
MIN(abs(value)) FILTER (label IS NOT NULL AND value <> 0) AS least_abs, SUM(try_cast(value AS DECIMAL(24,4))) FILTER (label IS NOT NULL) AS total FROM chart_points GROUP BY chart) s""")
def chart_recommend(spark: SparkSession, d: str) -> DataFrame:
    return recommend(fixture(spark, d, "chart_points"))


def shown_label(label: Column) -> Column:
    """A label without year, by its usual name, without an abbreviation before a bracket and without brackets at its ends."""
    bare = F.regexp_replace(label, _YEAR, "")
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    named = F.coalesce(F.try_element_at(names, bare), bare)
    return F.regexp_replace(F.regexp_replace(named, f"^({'|'.join(SHORT)})（", ""), "^[（(]+|[）)]+$", "")


def series(points: DataFrame) -> DataFrame:
    """chart, pos, label and value of the points that a chart shows.

    A label 'task7_...' names a company of its chart, A to Z and then 27, 28, ... in the order in which they first
    come. Of points with one label the first stays; of those with one position, the least label as given."""
    task = F.nullif(F.regexp_extract("label", _TASK, 1), F.lit(""))
    rows = points.filter("label IS NOT NULL").withColumn("task", task).withColumn("plain", shown_label(F.regexp_replace("label", _TASK, "")))
    order = ["pos", "label"]
    firsts = rows.withColumn("first", F.min(F.struct(*order)).over(Window.partitionBy("chart", "task")))
    letter = F.dense_rank().over(Window.partitionBy("chart").orderBy(F.asc_nulls_last(F.when(F.col("task").isNotNull(), F.col("first")))))
    company = F.when(F.col("letter") <= 26, F.char(F.col("letter") + 64)).otherwise(F.col("letter").cast("string"))
    text = F.when(F.col("task").isNotNull(), F.concat("plain", F.lit("(公司"), company, F.lit(")"))).otherwise(F.col("plain"))
    named = firsts.withColumn("letter", letter).withColumn("shown", text)
    w = Window.partitionBy("chart", "shown").orderBy(*order)
    return named.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("chart", "pos", F.col("shown").alias("label"), "value")


_NAMES_SQL = "CASE bare " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE bare END"


@query("chart_series", f"""WITH b AS (SELECT chart, pos, label, value, regexp_extract(label, '{_TASK}', 1) AS task, regexp_replace(regexp_replace(label, '{_TASK}', ''), '{_YEAR}', '') AS bare FROM chart_points WHERE label IS NOT NULL),
p AS (SELECT *, regexp_replace(regexp_replace({_NAMES_SQL}, '^({'|'.join(SHORT)})（', ''), '^[（(]+|[）)]+$', '', 'g') AS plain FROM b),
t AS (SELECT chart, task, row_number() OVER (PARTITION BY chart ORDER BY MIN(pos)) AS letter FROM b WHERE task <> '' GROUP BY 1, 2),
s AS (SELECT p.chart, pos, p.label AS raw, value, CASE WHEN letter IS NULL THEN plain ELSE concat(plain, '(公司', CASE WHEN letter <= 26 THEN chr(CAST(letter AS INT) + 64) ELSE CAST(letter AS VARCHAR) END, ')') END AS label FROM p LEFT JOIN t ON p.chart = t.chart AND p.task = t.task)
SELECT chart, pos, label, value FROM (SELECT *, row_number() OVER (PARTITION BY chart, label ORDER BY pos, raw) AS rn FROM s) r WHERE rn = 1""")
def chart_series(spark: SparkSession, d: str) -> DataFrame:
    return series(fixture(spark, d, "chart_points"))
