"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run.

Money is summed as DECIMAL and then cast, so totals do not depend on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
METRICS = (
    "revenue", "cost_of_revenue", "selling_expenses", "income_tax", "admin_expenses", "rd_expenses", "finance_expenses",
    "operating_profit", "net_profit", "net_profit_attr_parent", "total_assets", "total_liabilities", "total_equity",
    "equity_attr_parent", "current_assets", "current_liabilities", "inventory", "receivables", "interest_expense",
    "operating_cf", "investing_cf_out", "financing_cf", "eps",
)

FIXTURES: dict[str, str] = {
    "facts_wide": """
SELECT lpad(CAST(suppkey AS STRING), 6, '0') AS symbol, year, quarter,
       rev AS revenue, cogs AS cost_of_revenue, dsc AS selling_expenses, tx AS income_tax,
       tx * 0.5 AS admin_expenses, dsc * 0.5 AS rd_expenses, ret * 0.125 - dsc AS finance_expenses,
       rev - cogs - dsc AS operating_profit, rev - cogs - dsc - tx AS net_profit,
       CASE WHEN suppkey % 5 <> 0 THEN (rev - cogs - dsc - tx) * 0.75 END AS net_profit_attr_parent,
       rev * 4 AS total_assets, opn + ret AS total_liabilities,
       CASE WHEN suppkey % 7 <> 0 THEN rev * 4 - opn - ret END AS total_equity,
       CASE WHEN suppkey % 3 <> 0 THEN (rev * 4 - opn - ret) * 0.5 END AS equity_attr_parent,
       rev * 2 AS current_assets, CASE WHEN suppkey % 13 <> 0 THEN opn ELSE 0 END AS current_liabilities,
       cogs * 0.5 AS inventory, ret AS receivables,
       CASE WHEN suppkey % 11 <> 0 THEN dsc * 0.25 ELSE 0 END AS interest_expense,
       rev - cogs AS operating_cf, dsc * 2 AS investing_cf_out, 0 - ret AS financing_cf,
       (rev - cogs - dsc - tx) / units AS eps
FROM (
  SELECT suppkey, year, quarter, CAST(SUM(ext) AS DOUBLE) AS rev, CAST(SUM(qty * price) AS DOUBLE) AS cogs,
         CAST(SUM(CASE WHEN rf = 'R' THEN ext ELSE 0 END) AS DOUBLE) AS ret,
         CAST(SUM(CASE WHEN ls = 'O' THEN ext ELSE 0 END) AS DOUBLE) AS opn,
         CAST(SUM(ext * disc) AS DOUBLE) AS dsc, CAST(SUM(ext * tax) AS DOUBLE) AS tx, CAST(SUM(qty) AS DOUBLE) AS units
  FROM (
    SELECT CAST(l.l_suppkey AS BIGINT) AS suppkey, CAST(year(l.l_shipdate) AS INT) + 23 AS year,
           concat('Q', CAST(quarter(l.l_shipdate) AS STRING)) AS quarter,
           CAST(l.l_extendedprice AS DECIMAL(12,2)) AS ext, CAST(l.l_discount AS DECIMAL(4,2)) AS disc,
           CAST(l.l_tax AS DECIMAL(4,2)) AS tax, CAST(l.l_quantity AS DECIMAL(6,0)) AS qty,
           CAST(p.p_retailprice AS DECIMAL(8,2)) AS price, l.l_returnflag AS rf, l.l_linestatus AS ls
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  ) li GROUP BY suppkey, year, quarter
) d WHERE NOT (quarter = 'Q4' AND (suppkey + year) % 4 = 0)""",
    "companies": """
SELECT lpad(CAST(s.s_suppkey AS STRING), 6, '0') AS symbol, s.s_name AS name, n.n_name AS sector, r.r_name AS market
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "prices": """
SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS day,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(6,0))) AS DOUBLE) AS close,
       MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low,
       CAST(SUM(CAST(l_quantity AS DECIMAL(6,0))) AS BIGINT) AS volume
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "requests": """
SELECT event_id, ts, CAST(user_id AS STRING) AS client, concat('ep', CAST(event_id % 7 AS STRING)) AS endpoint,
       value * 100 AS latency_ms, event_type <> 'error' AS success FROM events""",
    "usage": """
SELECT event_id, ts, CAST(user_id AS STRING) AS session_id,
       CASE WHEN event_type = 'purchase' THEN 'pro' WHEN event_type = 'signup' THEN 'other' ELSE 'flash' END AS model,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 10 AS prompt_tokens,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 3 AS completion_tokens FROM events""",
    "corpus": """
SELECT doc_id, concat(source, '_', lang, '_', CAST(2018 + doc_id % 7 AS STRING), '.txt') AS source,
       concat('NATION_', CAST(doc_id % 25 AS STRING)) AS entity, lang, text FROM documents""",
    "questions": """
SELECT c.s_suppkey AS qid,
       concat(n.n_name, ' ', CAST(2018 + c.s_suppkey % 7 AS STRING), CASE WHEN c.s_suppkey % 3 = 0 THEN ' to ' ELSE ' and ' END,
              CAST(2019 + c.s_suppkey % 6 AS STRING), ' ',
              CASE c.s_suppkey % 5 WHEN 0 THEN 'gross margin' WHEN 1 THEN 'net margin and revenue' WHEN 2 THEN 'ROE'
                   WHEN 3 THEN 'profitability' ELSE 'debt ratio' END, ' ', c.s_name) AS query
FROM supplier c JOIN nation n ON c.s_nationkey = n.n_nationkey""",
    "manifest_old": "SELECT concat('doc', CAST(doc_id AS STRING)) AS name, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 0",
    "manifest_new": "SELECT concat('doc', CAST(doc_id AS STRING)) AS name, CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, 'x')) ELSE md5(text) END AS hash FROM documents WHERE doc_id % 11 <> 0",
}
FIXTURES["facts"] = "SELECT symbol, year, quarter, metric_key, metric_value, 'statement' AS source FROM (\n" + "\nUNION ALL ".join(
    f"SELECT symbol, year, quarter, '{m}' AS metric_key, {m} AS metric_value FROM facts_wide" for m in METRICS
) + "\n) u WHERE metric_value IS NOT NULL"
# One row for each symbol, year: the fourth quarter, else the latest.
FIXTURES["annual"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY CASE WHEN quarter = 'Q4' THEN 0 ELSE 1 END, quarter DESC) AS rn FROM facts_wide) q WHERE rn = 1"

_INT = "CAST(CAST(floor({0}) AS BIGINT) AS STRING)"
_COMMAS = "concat(CAST(CAST(floor({0} / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor({0}) AS BIGINT) % 1000 AS STRING), 3, '0'))"
_ROW = "chr(10), '| {0} | ', {1}, ' | ', {2}, ' |'"
#: A page of a report: text, a table whose header mostly has the year, one that has none, and one too short to count.
FIXTURES["statement_pages"] = f"""
SELECT concat(symbol, '-', CAST(year AS STRING)) AS doc_id, symbol, year,
       concat('合并财务报表', chr(10), '单位：元 | 币种：人民币', chr(10),
              '| 项目 | ', CASE WHEN CAST(symbol AS INT) % 5 = 0 THEN '本期' ELSE concat(CAST(year AS STRING), '年') END, ' | 上期 |', chr(10), '| --- | --- | --- |',
              {_ROW.format("一、营业收入", _COMMAS.format("revenue"), "'1'")}, {_ROW.format("减：营业成本", _INT.format("cost_of_revenue"), "'-'")},
              {_ROW.format("销售费用", "'不适用'", _INT.format("selling_expenses"))}, {_ROW.format("净利润", "'--'", _INT.format("net_profit"))},
              {_ROW.format("其他", "'5'", "'6'")}, {_ROW.format("", "'7'", "'8'")}, {_ROW.format("商誉", "'0'", "'9000000000000000'")},
              chr(10), '附注：金额按四舍五入列示。', chr(10), '| 单独一行 |', chr(10), '说明', chr(10),
              '| 项目 | 期末余额 | 期初余额 |', chr(10), '|---|---|---|',
              {_ROW.format("资产总计", _COMMAS.format("total_assets"), "'2'")}, {_ROW.format("非流动负债合计", _INT.format("total_liabilities / 4"), "'3'")},
              {_ROW.format("流动负债合计", _INT.format("current_liabilities"), "'4'")}, {_ROW.format("负债合计", _INT.format("total_liabilities"), "'0'")},
              {_ROW.format("营业收入合计", _INT.format("revenue"), "'0'")},
              CASE WHEN CAST(symbol AS INT) % 4 = 0 THEN concat(chr(10), '续表', chr(10), '| 项目 | ', CAST(year - 1 AS STRING), ' 年末 |', chr(10), '|---|---|', chr(10), '| 存货 | ', {_INT.format("inventory")}, ' |') ELSE '' END) AS text
FROM annual"""
#: What a report may say, and a report that says it, now and then wrongly.
FIXTURES["report_values"] = """
SELECT report_id, name, value FROM (
  SELECT concat(symbol, '-', CAST(year AS STRING)) AS report_id, '营业收入' AS name, floor(revenue) AS value FROM annual
  UNION ALL SELECT concat(symbol, '-', CAST(year AS STRING)), '营业成本', floor(cost_of_revenue) FROM annual
  UNION ALL SELECT concat(symbol, '-', CAST(year AS STRING)), '净利润', floor(net_profit) FROM annual
  UNION ALL SELECT concat(symbol, '-', CAST(year AS STRING)), '毛利率', floor((revenue - cost_of_revenue) / revenue * 10000) / 100 FROM annual WHERE revenue <> 0) v"""
FIXTURES["reports"] = f"""
SELECT concat(symbol, '-', CAST(year AS STRING)) AS report_id, symbol, year,
       concat('# 报告', chr(10), '营业收入为', {_INT.format("revenue")}, '元，营业成本', {_INT.format("cost_of_revenue * (CASE WHEN year % 3 = 0 THEN 1.5 ELSE 1 END)")}, '元。', chr(10),
              '|---|:--:|', chr(10), '[置信度: 95%] ', CAST(year AS STRING), '年基数100，共12项。毛利为', {_INT.format("revenue - cost_of_revenue")}, '元。',
              repeat('以上为正文说明。', CAST(CAST(symbol AS INT) % 90 AS INT)), '净利润', CASE WHEN CAST(symbol AS INT) % 7 = 0 THEN '未披露' ELSE '为' END,
              repeat('，', CAST(CAST(symbol AS INT) % 11 * 60 AS INT)), {_INT.format("abs(net_profit)")}, '元，折合', CAST(CAST(floor(abs(net_profit) / 100 + 0.5) AS BIGINT) / 100 AS STRING), '万元。') AS text
FROM annual WHERE revenue IS NOT NULL AND cost_of_revenue IS NOT NULL AND net_profit IS NOT NULL"""

#: Points of charts of every shape: amounts, flows of both signs, one and two ratios over years, shares, tasks of two companies, none.
FIXTURES["chart_points"] = """
SELECT chart, pos, label, value FROM (
  SELECT concat('amounts-', symbol, '-', CAST(year AS STRING)) AS chart, 1 AS pos, 'revenue' AS label, revenue AS value FROM annual
  UNION ALL SELECT concat('amounts-', symbol, '-', CAST(year AS STRING)), 2, '（营业成本）', cost_of_revenue FROM annual
  UNION ALL SELECT concat('amounts-', symbol, '-', CAST(year AS STRING)), 3, concat('存货_', CAST(year AS STRING)), inventory FROM annual
  UNION ALL SELECT concat('flows-', symbol), year * 2, concat('净流_', CAST(year AS STRING)), operating_cf FROM annual WHERE year % 2 = 0
  UNION ALL SELECT concat('flows-', symbol), year * 2 + 1, 'financing', financing_cf FROM annual
  UNION ALL SELECT concat('trend-', symbol), year, concat('net_profit_margin_', CAST(year AS STRING)), CASE WHEN revenue <> 0 THEN floor(net_profit / revenue * 100) END FROM annual
  UNION ALL SELECT concat('double-', symbol), year, concat('roa_', CAST(year AS STRING)), CASE WHEN total_assets <> 0 THEN floor(net_profit / total_assets * 100) END FROM annual
  UNION ALL SELECT concat('double-', symbol), year + 100, concat('ROE（净资产收益率）_', CAST(year AS STRING)), CASE WHEN total_equity <> 0 THEN floor(net_profit / total_equity * 100) END FROM annual
  UNION ALL SELECT concat('shares-', symbol, '-', CAST(year AS STRING)), 1, 'A股', floor(cost_of_revenue / revenue * 100) + 1 FROM annual WHERE revenue <> 0
  UNION ALL SELECT concat('shares-', symbol, '-', CAST(year AS STRING)), 2, 'B股', 100 - floor(cost_of_revenue / revenue * 100) FROM annual WHERE revenue <> 0
  UNION ALL SELECT concat('scores-', symbol, '-', CAST(year AS STRING)), 1, 'current_ratio', floor(current_assets / total_assets * 30) + 1 FROM annual WHERE total_assets <> 0
  UNION ALL SELECT concat('scores-', symbol, '-', CAST(year AS STRING)), 2, 'quick_ratio', floor(total_liabilities / total_assets * 30) + 1 FROM annual WHERE total_assets <> 0
  UNION ALL SELECT concat('scores-', symbol, '-', CAST(year AS STRING)), 3, 'equity_multiplier', floor(receivables / total_assets * 3000) + 1 FROM annual WHERE total_assets <> 0
  UNION ALL SELECT concat('tasks-', symbol), year * 3, concat('task', CAST(year % 3 AS STRING), '_gross_profit_margin_', CAST(year AS STRING)), floor(revenue / 1000) FROM annual
  UNION ALL SELECT concat('tasks-', symbol), year * 3 + 1, '毛利率', 1 FROM annual
  UNION ALL SELECT concat('none-', symbol), 1, CAST(NULL AS STRING), revenue FROM annual) c"""
#: What companies' metrics were over the years, a sector's usual values, and comments that say how they moved.
FIXTURES["comment_values"] = """
SELECT symbol AS report_id, indicator, year, value FROM (
  SELECT symbol, '营收' AS indicator, year, revenue AS value FROM annual
  UNION ALL SELECT symbol, '净利润', year, net_profit FROM annual
  UNION ALL SELECT symbol, '成本', year, cost_of_revenue FROM annual
  UNION ALL SELECT symbol, '负债率', year, 50 FROM annual) v WHERE value IS NOT NULL"""
FIXTURES["sector_benchmarks"] = """
SELECT c.sector, 'gross' AS metric, CAST(floor(SUM(CAST(floor(a.revenue) AS DECIMAL(20,0))) / COUNT(*)) AS BIGINT) AS value
FROM annual a JOIN companies c ON a.symbol = c.symbol WHERE a.revenue IS NOT NULL AND c.sector < 'R' GROUP BY c.sector"""
FIXTURES["comments"] = f"""
SELECT a.symbol AS report_id, c.sector,
       concat(CAST(a.year AS STRING), '年营业收入为', {_INT.format("revenue")}, '元，营收同比', CASE WHEN CAST(a.symbol AS INT) % 2 = 0 THEN '增长' ELSE '下滑' END, '；净利润', {_INT.format("abs(net_profit)")}, ' 万元，',
              CASE WHEN CAST(a.symbol AS INT) % 3 = 0 THEN '减少了净利润，' ELSE '净利润明显提升，' END, '成本费用', CASE WHEN CAST(a.symbol AS INT) % 5 = 0 THEN '缩水' ELSE '上涨' END, chr(10),
              CASE WHEN CAST(a.symbol AS INT) % 4 = 0 THEN concat(CAST(a.year - 1 AS STRING), '年负债率下降至 50.5%，', CAST(a.year - 1 AS STRING), '年毛利率约40.25%，营收同比增长') ELSE '营收持平' END, chr(10),
              CASE WHEN CAST(a.symbol AS INT) % 6 = 0 THEN '高于行业平均水平。' ELSE concat('参考值', substr(CAST(CAST(floor(a.revenue) AS BIGINT) AS STRING), 1, 3)) END, '经营活动产生的现金流净额', {_INT.format("abs(operating_cf)")}, '元') AS text
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS last FROM annual) a JOIN companies c ON a.symbol = c.symbol WHERE a.last = 1 AND a.revenue IS NOT NULL AND a.net_profit IS NOT NULL AND a.operating_cf IS NOT NULL"""

#: What the caller of a formula gives: most names with a year, some without, some not at all.
FIXTURES["given_params"] = "SELECT case_id, name, value FROM (\n" + "\nUNION ALL ".join(
    f"SELECT symbol AS case_id, concat('{m}_', CAST(year AS STRING)) AS name, {c} AS value FROM annual WHERE CAST(symbol AS INT) % {k} <> 0"
    for m, c, k in (("revenue", "revenue", 17), ("cost_of_revenue", "cost_of_revenue", 13), ("net_profit", "net_profit", 11), ("total_assets", "total_assets", 19), ("equity", "total_equity", 6), ("equity_attr_parent", "equity_attr_parent", 5),
                    ("inventory", "inventory", 7), ("receivables", "receivables", 9), ("operating_profit", "operating_profit", 8), ("operating_cf", "operating_cf", 10), ("investing_cf_out", "investing_cf_out", 4), ("eps", "eps", 12), ("current_assets", "current_assets", 3))
) + """
UNION ALL SELECT symbol, 'avg_equity', total_assets FROM annual WHERE CAST(symbol AS INT) % 3 = 0 AND year % 2 = 0
UNION ALL SELECT symbol, 'total_liabilities', total_liabilities FROM annual WHERE CAST(symbol AS INT) % 2 = 0
UNION ALL SELECT symbol, 'total_shares', CAST(0 AS DOUBLE) FROM companies
UNION ALL SELECT symbol, 'price', CAST(12 AS DOUBLE) FROM companies) g"""
#: What is said of a company, with words of an industry or none.
FIXTURES["company_profiles"] = """
SELECT symbol, concat(name, CASE CAST(symbol AS INT) % 12 WHEN 0 THEN '银行' WHEN 1 THEN '从事保险' WHEN 2 THEN '证券公司' WHEN 3 THEN '白酒' WHEN 4 THEN '新能源电池'
       WHEN 5 THEN '家电' WHEN 6 THEN '医药' WHEN 7 THEN '电力' WHEN 8 THEN '芯片' WHEN 9 THEN '食品' WHEN 10 THEN '保险与银行' ELSE '' END) AS about FROM companies"""
#: Points of charts whose names are those of metrics, parts of them, longer ones, or others.
FIXTURES["metric_points"] = """
SELECT symbol AS chart, year AS pos, CASE year % 5 WHEN 0 THEN '毛利率' WHEN 1 THEN concat('净资产收益率_', CAST(year AS STRING)) WHEN 2 THEN '周转率' WHEN 3 THEN '营业外支出' ELSE '净利润增长率' END AS name,
       CASE WHEN revenue <> 0 THEN floor(net_profit / revenue * 10000) / 100 END AS value FROM annual"""

#: What a report was given to write about, cash flows of both signs among it.
FIXTURES["data_values"] = """
SELECT report_id, name, value FROM report_values
UNION ALL SELECT concat(symbol, '-', CAST(year AS STRING)) AS report_id, 'Operating_CF' AS name, operating_cf AS value FROM annual
UNION ALL SELECT concat(symbol, '-', CAST(year AS STRING)) AS report_id, '亏损' AS name, 0 - net_profit AS value FROM annual"""


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame; ``facts`` is an unpivot of ``facts_wide``."""
    if name == "facts":
        from pyspark.sql import functions as F

        wide = fixture(spark, sf_dir, "facts_wide")
        long = wide.unpivot(["symbol", "year", "quarter"], [wide[m] for m in METRICS], "metric_key", "metric_value")
        return long.filter("metric_value IS NOT NULL").withColumn("source", F.lit("statement"))
    if name == "annual":
        from factlode.operators.facts import latest_quarter

        return latest_quarter(fixture(spark, sf_dir, "facts_wide"), ["symbol", "year"])
    sql = FIXTURES[name]
    frames = {t: base(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    frames |= {f: fixture(spark, sf_dir, f) for f in FIXTURES if re.search(rf"\b(FROM|JOIN) {f}\b", sql)}
    if len(re.findall(r"\b(?:FROM|JOIN) annual\b", sql)) > 1:
        from factlode.llm.common import save

        # Each branch of a union would scan and sum all of lineitem anew.
        frames["annual"] = save(frames["annual"], "annual")
    for t in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames) if frames else spark.sql(sql)


def with_fixtures(sql: str) -> str:
    """A DuckDB query with the fixtures it names put in front as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(FIXTURES[name])
                if name not in need:
                    need.append(name)

    add(sql)
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in need)
    return sql if not need else f"WITH {ctes} {sql}" if not sql.lstrip().upper().startswith("WITH") else f"WITH {ctes}, {sql.lstrip()[5:]}"
