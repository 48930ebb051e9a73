"""Parameters of formulas filled in, checks of results, risks by industry, and distances from healthy values.

Parameters come in long form, one row for each name a case gives (``revenue``, or ``revenue_2023`` for a
year); a case is one row only once its names are aggregated, so every rule is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.functions import r2, r2_sql
from factlode.operators.files import INDUSTRIES, industry_of
from factlode.operators.formulas import INPUT_SQL, formula, formula_input, formula_sql, long_form, long_sql
from factlode.plans.registry import query
from factlode.sources.fixtures import fixture

#: Formulas and the parameters they take.
TAKES = {
    "gross_profit_margin": ("revenue", "cost_of_revenue"), "net_profit_margin": ("net_profit", "revenue"), "roe": ("net_profit", "avg_equity"),
    "roa": ("net_profit", "avg_total_assets"), "ebitda_margin": ("ebitda", "revenue"), "debt_ratio": ("total_liabilities", "total_assets"),
    "current_ratio": ("current_assets", "current_liabilities"), "inventory_turnover": ("cost_of_revenue", "avg_inventory"),
    "receivable_turnover": ("revenue", "avg_receivables"), "total_asset_turnover": ("revenue", "avg_total_assets"),
    "revenue_growth": ("current_revenue", "previous_revenue"), "net_profit_growth": ("current_profit", "previous_profit"),
    "pb_ratio": ("price", "bvps"), "ps_ratio": ("price", "revenue_per_share"), "free_cash_flow": ("operating_cf", "capital_expenditure"),
}
AVERAGES = ("equity", "total_assets", "inventory", "receivables")
GROWTH = {"revenue_growth": ("revenue", "revenue"), "net_profit_growth": ("profit", "net_profit")}
NAMES = sorted({p for ps in TAKES.values() for p in ps} | {*AVERAGES, "equity_attr_parent", "net_profit_attr_parent", "eps", "operating_profit", "total_shares", "investing_cf_out"})
DATED = r"^(.+?)_([0-9]{4})$"


def by_case(params: DataFrame) -> DataFrame:
    """One row for each case: of every name the value given as such (``n_0``), and those of the last two years (``n_1``, ``n_2``).

    A name that a case gives twice counts with its greatest value; a null value is not given."""
    dated = F.col("name").rlike(DATED)
    named = params.filter("value IS NOT NULL").select("case_id", F.when(dated, F.regexp_extract("name", DATED, 1)).otherwise(F.col("name")).alias("base"), F.when(dated, F.regexp_extract("name", DATED, 2).cast("int")).alias("year"), "value")
    once = named.filter(F.col("base").isin(NAMES)).groupBy("case_id", "base", "year").agg(F.max("value").alias("value"))
    back = F.row_number().over(Window.partitionBy("case_id", "base", F.col("year").isNull()).orderBy(F.desc("year")))
    placed = once.withColumn("place", F.when(F.col("year").isNull(), 0).otherwise(back))
    return placed.groupBy("case_id").agg(*(F.max(F.when((F.col("base") == n) & (F.col("place") == k), F.col("value"))).alias(f"{n}_{k}") for n in NAMES for k in (0, 1, 2)))


def _have(name: str) -> Column:
    return F.coalesce(f"{name}_0", f"{name}_1")


def _nonzero(*names: str) -> Column:
    """The first of these parameters that is there and not 0."""
    return F.coalesce(*(F.nullif(_have(n), F.lit(0.0)) for n in names))


def _guess(name: str, parameter: str) -> tuple[Column, str] | None:
    """What stands in for a parameter that is not given under its name, and where that comes from."""
    shares = _nonzero("net_profit", "net_profit_attr_parent") / _nonzero("eps")
    if parameter.startswith("avg_"):
        return _have(parameter[4:]), f"avg_fallback:{parameter[4:]}"
    if name in GROWTH:
        of = GROWTH[name][1]
        return F.when(F.col(f"{of}_2").isNotNull(), F.col(f"{of}_{1 if parameter.startswith('current') else 2}")), "growth_yearly"
    return {
        "total_liabilities": (r2(_have("total_assets") - _have("equity")), "debt_computed"),
        "bvps": (r2(_nonzero("equity", "equity_attr_parent") / shares), "bvps_computed"),
        "ebitda": (_nonzero("operating_profit"), "ebitda_approx"),
        "revenue_per_share": (r2(_nonzero("revenue") / F.coalesce(_nonzero("total_shares"), shares)), "revenue_div_shares"),
        "capital_expenditure": (_have("investing_cf_out"), "capex_approx_investing_cf_out"),
    }.get(parameter)


def filled(params: DataFrame) -> DataFrame:
    """case_id, formula, parameter, value and fill of every parameter of every formula.

    ``fill``: given, ``auto_fill:`` and the rule that filled it, or null (with a null value) where none did."""

    def one(name: str, parameter: str) -> Column:
        guess = _guess(name, parameter)
        value, how = guess if guess else (F.lit(None).cast("double"), "")
        kind = F.when(F.col(f"{parameter}_0").isNotNull(), "given").when(F.col(f"{parameter}_1").isNotNull(), "auto_fill:year_suffix").when(value.isNotNull(), f"auto_fill:{how}")
        return F.struct(F.lit(name).alias("formula"), F.lit(parameter).alias("parameter"), F.coalesce(_have(parameter), value).alias("value"), kind.alias("fill"))

    return by_case(params).select("case_id", F.inline(F.array(*(one(f, p) for f, ps in TAKES.items() for p in ps))))


def confidences(rows: DataFrame) -> DataFrame:
    """Of ``filled`` rows: is a formula's every parameter there, and how far a result can be trusted.

    Values of the last year and stand-ins for averages are usual; any other fill lowers the confidence."""
    unusual = F.col("fill").startswith("auto_fill") & ~F.col("fill").startswith("auto_fill:year_suffix") & ~F.col("fill").startswith("auto_fill:avg_fallback")
    got = rows.groupBy("case_id", "formula").agg(F.every(F.col("value").isNotNull()).alias("complete"), F.coalesce(F.some(unusual), F.lit(False)).alias("guessed"))
    return got.select("case_id", "formula", "complete", F.when(F.col("guessed"), 0.8).otherwise(0.95).alias("confidence"), F.when(F.col("guessed"), "calc:auto_fill").otherwise("calc").alias("source"))


# The same in SQL.
_SPLIT = "SELECT case_id, CASE WHEN regexp_matches(name, '_[0-9]{4}$') THEN substr(name, 1, length(name) - 5) ELSE name END AS base, CASE WHEN regexp_matches(name, '_[0-9]{4}$') THEN CAST(right(name, 4) AS INT) END AS year, MAX(value) AS value FROM given_params WHERE value IS NOT NULL GROUP BY ALL"
_WIDE = "SELECT case_id, " + ", ".join(f"MAX(value) FILTER (WHERE base = '{n}' AND year IS NULL) AS {n}_0, arg_max(value, year) FILTER (WHERE base = '{n}' AND year IS NOT NULL) AS {n}_1, list(value ORDER BY year DESC) FILTER (WHERE base = '{n}' AND year IS NOT NULL)[2] AS {n}_2" for n in NAMES) + f" FROM ({_SPLIT}) s WHERE base IN ({', '.join(repr(n) for n in NAMES)}) GROUP BY case_id"
_H = "coalesce({0}_0, {0}_1)".format
_NZ = "nullif(coalesce({0}_0, {0}_1), 0)".format
_SHARES = f"(coalesce({_NZ('net_profit')}, {_NZ('net_profit_attr_parent')}) / {_NZ('eps')})"
_OTHER = {p: (_H(p[4:]), f"avg_fallback:{p[4:]}") for p in NAMES if p.startswith("avg_")} | {
    "total_liabilities": (r2_sql(f"({_H('total_assets')} - {_H('equity')})"), "debt_computed"), "ebitda": (_NZ("operating_profit"), "ebitda_approx"),
    "bvps": (r2_sql(f"(coalesce({_NZ('equity')}, {_NZ('equity_attr_parent')}) / {_SHARES})"), "bvps_computed"),
    "revenue_per_share": (r2_sql(f"({_NZ('revenue')} / coalesce({_NZ('total_shares')}, {_SHARES}))"), "revenue_div_shares"), "capital_expenditure": (_H("investing_cf_out"), "capex_approx_investing_cf_out"),
    "current_revenue": ("CASE WHEN revenue_2 IS NOT NULL THEN revenue_1 END", "growth_yearly"), "previous_revenue": ("revenue_2", "growth_yearly"),
    "current_profit": ("CASE WHEN net_profit_2 IS NOT NULL THEN net_profit_1 END", "growth_yearly"), "previous_profit": ("net_profit_2", "growth_yearly"),
}
_PARTS = [(f, p, *_OTHER.get(p, ("CAST(NULL AS DOUBLE)", ""))) for f, ps in TAKES.items() for p in ps]
FILLED_SQL = f"WITH wide AS ({_WIDE}) " + " UNION ALL ".join(f"SELECT case_id, '{f}' AS formula, '{p}' AS parameter, coalesce({_H(p)}, {v}) AS value, CASE WHEN {p}_0 IS NOT NULL THEN 'given' WHEN {p}_1 IS NOT NULL THEN 'auto_fill:year_suffix' WHEN {v} IS NOT NULL THEN 'auto_fill:{how}' END AS fill FROM wide" for f, p, v, how in _PARTS)
_GUESSED = "coalesce(bool_or(fill LIKE 'auto_fill:%' AND fill NOT LIKE 'auto_fill:year_suffix%' AND fill NOT LIKE 'auto_fill:avg_fallback%'), false)"


@query("auto_fill_all", FILLED_SQL)
def auto_fill_all(spark: SparkSession, d: str) -> DataFrame:
    return filled(fixture(spark, d, "given_params"))


@query("calc_confidence_all", FILLED_SQL.replace(") SELECT", "), filled AS (SELECT", 1) + f") SELECT case_id, formula, bool_and(value IS NOT NULL) AS complete, CASE WHEN {_GUESSED} THEN 0.8e0 ELSE 0.95e0 END AS confidence, CASE WHEN {_GUESSED} THEN 'calc:auto_fill' ELSE 'calc' END AS source FROM filled GROUP BY case_id, formula")
def calc_confidence_all(spark: SparkSession, d: str) -> DataFrame:
    return confidences(auto_fill_all(spark, d))


# What a formula's result may be.
RANGES = {
    "roe": (0, 200), "roa": (0, 100), "gross_profit_margin": (0, 100), "net_profit_margin": (0, 100), "debt_ratio": (0, 100),
    "revenue_growth": (-500, 500), "net_profit_growth": (-500, 500), "current_ratio": (0, 100), "quick_ratio": (0, 100),
    "interest_coverage": (-100, 100), "pe_ratio": (0, 500), "pb_ratio": (0, 100), "ps_ratio": (0, 100),
}


def checked(df: DataFrame) -> DataFrame:
    """symbol, year, formula, value and problem (range, capex, no_capex, or none) of every result over ``formula_input``.

    Of free cash flow: an outlay over ten times the operating cash flow, else a result within 1 % of that."""
    lo = F.create_map(*(F.lit(x) for k, v in RANGES.items() for x in (k, float(v[0]))))
    hi = F.create_map(*(F.lit(x) for k, v in RANGES.items() for x in (k, float(v[1]))))
    ranged = long_form(df, list(RANGES)).filter("value IS NOT NULL").withColumn("problem", F.when(~F.col("value").between(lo[F.col("formula")], hi[F.col("formula")]), "range"))
    cf, out = F.coalesce("operating_cf", F.lit(0.0)), F.coalesce("investing_cf_out", F.lit(0.0))
    value = formula("free_cash_flow")
    flow = F.when((cf != 0) & (F.abs(out) > 10 * F.abs(cf)), "capex").when(F.abs(value - cf) < F.abs(cf) * 0.01, "no_capex")
    return ranged.unionByName(df.select("symbol", "year", F.lit("free_cash_flow").alias("formula"), value.alias("value"), flow.alias("problem")).filter("value IS NOT NULL"))


_RANGED = " ".join(f"WHEN '{k}' THEN value NOT BETWEEN {a} AND {b}" for k, (a, b) in RANGES.items())
_CF, _OUT, _FCF = "coalesce(operating_cf, 0)", "coalesce(investing_cf_out, 0)", formula_sql("free_cash_flow")


@query("sanity_check_all", f"SELECT symbol, year, formula, value, CASE WHEN CASE formula {_RANGED} END THEN 'range' END AS problem FROM ({long_sql(list(RANGES))}) l WHERE value IS NOT NULL UNION ALL SELECT symbol, year, 'free_cash_flow', {_FCF}, CASE WHEN {_CF} <> 0 AND abs({_OUT}) > 10 * abs({_CF}) THEN 'capex' WHEN abs({_FCF} - {_CF}) < abs({_CF}) * 0.01e0 THEN 'no_capex' END FROM ({INPUT_SQL}) i WHERE {_FCF} IS NOT NULL")
def sanity_check_all(spark: SparkSession, d: str) -> DataFrame:
    return checked(formula_input(spark, d))


# Limits of debt ratio (red above, yellow above) and current ratio (red below, yellow below) by industry; the last for all others.
LIMITS = {
    "银行": (93, 90, 0.5, 0.8), "保险": (90, 85, 0.5, 0.8), "证券": (85, 75, 1.0, 1.5), "白酒": (50, 35, 1.5, 2.5), "新能源": (75, 60, 0.8, 1.2),
    "家电": (70, 55, 1.0, 1.5), "医药": (55, 40, 1.2, 2.0), "电力": (75, 60, 0.5, 0.8), "半导体": (55, 40, 1.5, 2.5), "消费": (60, 45, 1.0, 1.5),
    "": (70, 60, 1.0, 2.0),
}
#: Limits that no industry changes: red below, yellow below, and whether what is above them is worth a row.
QUICK, PROFIT_CASH = (0.5, 1.0), (50.0, 100.0)
RISKY = ["debt_ratio", "current_ratio", "quick_ratio", "cf_to_net_profit"]


def risks(results: DataFrame) -> DataFrame:
    """``results`` (industry, formula, value and more) with ``flag``: red, yellow or green by the limits of the industry.

    An industry without limits of its own gets the general ones. A quick ratio that is high enough says nothing, and gives no row."""
    limit = [F.create_map(*(F.lit(x) for name, v in LIMITS.items() for x in (name, float(v[k])))) for k in range(4)]
    own = F.when(F.col("industry").isin(list(LIMITS)), F.col("industry")).otherwise("")
    v, f = F.col("value"), F.col("formula")
    band = lambda red, yellow: F.when(red, "red").when(yellow, "yellow")
    flag = (
        F.when(f == "debt_ratio", band(v > limit[0][own], v > limit[1][own]).otherwise("green"))
        .when(f == "current_ratio", band(v < limit[2][own], v < limit[3][own]).otherwise("green"))
        .when(f == "quick_ratio", band(v < QUICK[0], v < QUICK[1]))
        .when(f == "cf_to_net_profit", band(v < PROFIT_CASH[0], v < PROFIT_CASH[1]).otherwise("green"))
    )
    return results.filter(v.isNotNull()).withColumn("flag", flag).filter("flag IS NOT NULL")


def levels(flags: DataFrame) -> DataFrame:
    """symbol, year, reds and level: two red flags or more are high, one is medium."""
    reds = flags.groupBy("symbol", "year").agg(F.count_if(F.col("flag") == "red").alias("reds"))
    return reds.withColumn("level", F.when(F.col("reds") >= 2, "high").when(F.col("reds") == 1, "medium").otherwise("low"))


_LIMIT_ROWS = ", ".join(f"('{k}', {', '.join(str(float(x)) for x in v)})" for k, v in LIMITS.items())
_INDUSTRY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(about, {w!r})' for w in ws)} THEN '{k}'" for k, ws in INDUSTRIES.items()) + " ELSE '' END"
_PLACED = f"SELECT l.symbol, l.year, l.formula, l.value, c.industry, t.a, t.b, t.c AS cl, t.d FROM ({long_sql(RISKY)}) l JOIN (SELECT symbol, {_INDUSTRY} AS industry FROM company_profiles) c ON l.symbol = c.symbol JOIN (VALUES {_LIMIT_ROWS}) t(name, a, b, c, d) ON t.name = c.industry"
RISKS_SQL = f"SELECT symbol, year, formula, value, industry, flag FROM (SELECT *, CASE formula WHEN 'debt_ratio' THEN CASE WHEN value > a THEN 'red' WHEN value > b THEN 'yellow' ELSE 'green' END WHEN 'current_ratio' THEN CASE WHEN value < cl THEN 'red' WHEN value < d THEN 'yellow' ELSE 'green' END WHEN 'quick_ratio' THEN CASE WHEN value < 0.5 THEN 'red' WHEN value < 1 THEN 'yellow' END ELSE CASE WHEN value < 50 THEN 'red' WHEN value < 100 THEN 'yellow' ELSE 'green' END END AS flag FROM ({_PLACED}) p WHERE value IS NOT NULL) q WHERE flag IS NOT NULL"


@query("risk_flags_by_industry", RISKS_SQL)
def risk_flags_by_industry(spark: SparkSession, d: str) -> DataFrame:
    industries = fixture(spark, d, "company_profiles").select("symbol", industry_of(F.col("about")).alias("industry"))
    return risks(long_form(formula_input(spark, d), RISKY).join(industries, "symbol")).select("symbol", "year", "formula", "value", "industry", "flag")


@query("risk_level_by_industry", f"SELECT symbol, year, COUNT(*) FILTER (WHERE flag = 'red') AS reds, CASE WHEN COUNT(*) FILTER (WHERE flag = 'red') >= 2 THEN 'high' WHEN COUNT(*) FILTER (WHERE flag = 'red') = 1 THEN 'medium' ELSE 'low' END AS level FROM ({RISKS_SQL}) r GROUP BY symbol, year")
def risk_level_by_industry(spark: SparkSession, d: str) -> DataFrame:
    return levels(risk_flags_by_industry(spark, d))


# Healthy values by the name of a metric.
HEALTHY = {
    "毛利率": 30, "净利率": 10, "净资产收益率": 15, "总资产收益率": 8, "资产负债率": 50, "流动比率": 2.0, "速动比率": 1.0, "营收增长率": 15,
    "净利润增长率": 15, "总资产周转率": 0.8, "存货周转率": 5, "经营现金流/净利润比率": 100, "自由现金流": 50, "市盈率": 20, "市净率": 3,
}


def healthy_value(name: Column) -> Column:
    """The healthy value of a metric: by its name, else of the first one that holds it or that it holds; else null."""
    exact = F.create_map(*(F.lit(x) for k, v in HEALTHY.items() for x in (k, float(v))))[name]
    near = [F.when((F.contains(name, F.lit(k)) | F.contains(F.lit(k), name)), float(v)) for k, v in HEALTHY.items()]
    return F.coalesce(exact, *near)


_EXACT = "CASE name " + " ".join(f"WHEN '{k}' THEN {float(v)}e0" for k, v in HEALTHY.items()) + " END"
_NEAR = "CASE " + " ".join(f"WHEN contains(name, '{k}') OR contains('{k}', name) THEN {float(v)}e0" for k, v in HEALTHY.items()) + " END"


@query("benchmark_gap_all", f"SELECT chart, pos, name, value, healthy, value - healthy AS gap FROM (SELECT chart, pos, name, value, coalesce({_EXACT}, {_NEAR}) AS healthy FROM metric_points) m")
def benchmark_gap_all(spark: SparkSession, d: str) -> DataFrame:
    """Every point of every chart beside its healthy value."""
    points = fixture(spark, d, "metric_points").withColumn("healthy", healthy_value(F.col("name")))
    return points.select("chart", "pos", "name", "value", "healthy", (F.col("value") - F.col("healthy")).alias("gap"))
