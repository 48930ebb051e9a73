"""Facts out of the markdown tables of whole texts: rows, labels, years, values.

A text's tables are found by one pass of a pattern over it and read as nested arrays, so no text is
exchanged; only labelled rows, a few words each, are put in order for the year that one table
takes over from the table before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.functions import contains
from factlode.plans.registry import query
from factlode.sources.fixtures import fixture

# Words of row labels in statements, and the metrics they stand for.
LABELS = {
    "营业收入": "revenue", "营业总收入": "revenue", "营业成本": "cost_of_revenue", "销售费用": "selling_expenses", "管理费用": "admin_expenses",
    "研发费用": "rd_expenses", "财务费用": "finance_expenses", "投资收益": "investment_income", "营业利润": "operating_profit", "利润总额": "total_profit",
    "所得税": "income_tax", "净利润": "net_profit_attr_parent", "归属于母公司": "net_profit_attr_parent", "归属于上市公司股东": "net_profit_attr_parent",
    "基本每股收益": "eps", "稀释每股收益": "diluted_eps", "综合收益": "total_comprehensive_income",
    "资产总计": "total_assets", "总资产": "total_assets", "流动资产合计": "current_assets", "货币资金": "cash_and_equivalents",
    "交易性金融资产": "trading_financial_assets", "应收票据": "receivables", "应收账款": "receivables", "存货": "inventory", "非流动资产合计": "non_current_assets",
    "固定资产": "fixed_assets", "在建工程": "construction_in_progress", "无形资产": "intangible_assets", "商誉": "goodwill", "长期股权投资": "long_term_investments",
    "负债合计": "total_liabilities", "总负债": "total_liabilities", "流动负债合计": "current_liabilities", "短期借款": "short_term_borrowings",
    "应付票据": "payables", "应付账款": "payables", "合同负债": "contract_liabilities", "非流动负债合计": "non_current_liabilities",
    "长期借款": "long_term_borrowings", "应付债券": "bonds_payable", "所有者权益": "total_equity", "归属于母公司所有者权益": "equity_attr_parent",
    "归属于上市公司股东所有者权益": "equity_attr_parent", "归属于母公司股东权益": "equity_attr_parent", "实收资本": "share_capital", "股本": "share_capital",
    "资本公积": "capital_reserve", "盈余公积": "surplus_reserve", "未分配利润": "retained_earnings",
    "经营活动产生的现金流量净额": "operating_cf", "经营活动现金流量净额": "operating_cf", "投资活动产生的现金流量净额": "investing_cf",
    "投资活动现金流量净额": "investing_cf", "筹资活动产生的现金流量净额": "financing_cf", "筹资活动现金流量净额": "financing_cf",
    "现金及现金等价物净增加额": "net_change_in_cash", "期初现金及现金等价物": "cash_beginning", "期末现金及现金等价物": "cash_ending",
}
#: Longest first, so that a label is read by the longest words it holds; of equally long ones the earlier.
_LONGEST = sorted(LABELS, key=len, reverse=True)
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
YEAR = "(20[0-9]{2})"
MOST = 1e15


def tables_in(text: Column) -> Column:
    """The tables of a text: each a run of lines that begin with a bar."""
    gap = "\x01"
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), gap, " "), r"(?md)^(?!\|)[^\n]*(?:\n|\z)", gap)
    return F.filter(F.split(marked, f"{gap}+"), lambda t: t != "")


def lines_of(table: Column) -> Column:
    return F.split(F.regexp_replace(table, r"\n\z", ""), "\n")


def cells_of(line: Column) -> Column:
    """What stands between the bars, without the blanks round it."""
    parts = F.split(line, r"\|", -1)
    return F.transform(F.slice(parts, 2, F.size(parts) - 2), lambda c: F.regexp_replace(c, r"^[ \t\r]+|[ \t\r]+$", ""))


def rows_of(lines: Column) -> Column:
    """(row_no, cells) of a table's rows that have a label and a cell; the header is row 0."""
    rows = F.transform(F.slice(lines, 2, F.size(lines)), lambda line, i: F.struct((i + 1).alias("row_no"), cells_of(line).alias("cells")))
    return F.filter(rows, lambda r: (F.size(r["cells"]) >= 2) & (r["cells"][0] != ""))


def metric_of(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for words in reversed(_LONGEST):
        out = F.when(contains(label, F.lit(words)), LABELS[words]).otherwise(out)
    return out


def value_of(cells: Column) -> Column:
    """The first cell behind the label that is a number other than 0 and not beyond ``MOST``."""
    plain = F.transform(F.slice(cells, 2, F.size(cells)), lambda c: F.translate(c, ", ", ""))
    numbers = F.transform(plain, lambda c: F.when(c.rlike(NUMBER), c.try_cast("double")))
    return F.get(F.filter(numbers, lambda v: v.isNotNull() & (v != 0) & (F.abs(v) <= MOST)), F.lit(0))


def year_of(header: Column) -> Column:
    return F.regexp_extract(header, YEAR, 1).try_cast("int")


def read_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_no (from 1), header_year and rows of every table of three lines or more. A null text has none."""
    found = docs.select("doc_id", F.posexplode(tables_in(F.col("text"))).alias("at", "table"))
    lines = found.select("doc_id", (F.col("at") + 1).alias("table_no"), lines_of(F.col("table")).alias("lines")).filter(F.size("lines") >= 3)
    return lines.select("doc_id", "table_no", year_of(F.col("lines")[0]).alias("header_year"), rows_of(F.col("lines")).alias("rows"))


def labelled(tables: DataFrame) -> DataFrame:
    """``tables`` with only the rows that give a fact, as (row_no, label, metric_key, metric_value)."""
    read = F.transform("rows", lambda r: F.struct(r["row_no"].alias("row_no"), r["cells"][0].alias("label"), metric_of(r["cells"][0]).alias("metric_key"), value_of(r["cells"]).alias("metric_value")))
    return tables.withColumn("rows", F.filter(read, lambda r: r["metric_key"].isNotNull() & r["metric_value"].isNotNull()))


def with_year(tables: DataFrame, default_year: int | None = None) -> DataFrame:
    """``year``: that of a table's header, else of the last table before it that has one, else the default."""
    w = Window.partitionBy("doc_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, 0)
    return tables.withColumn("year", F.coalesce(F.last("header_year", ignorenulls=True).over(w), F.lit(default_year).cast("int")))


def table_facts(docs: DataFrame, default_year: int | None = None) -> DataFrame:
    """doc_id, year, quarter, metric_key, metric_value and row_label: the facts of every table of every text.

    A table without a year gives none; of several rows for one metric and year the first counts."""
    rows = with_year(labelled(read_tables(docs)), default_year).filter("year IS NOT NULL").select("doc_id", "table_no", "year", F.inline("rows"))
    first = F.min_by(F.struct("metric_value", "label"), F.struct("table_no", "row_no"))
    return rows.groupBy("doc_id", "year", "metric_key").agg(first.alias("f")).select("doc_id", "year", F.lit("Q4").alias("quarter"), "metric_key", "f.metric_value", F.col("f.label").alias("row_label"))


# The same in SQL: lines in order, islands of lines with a bar.
LINES_SQL = "SELECT doc_id, line, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM statement_pages) l WHERE starts_with(line, '|')"
TABLE_SQL = f"SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS table_no, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) - 1 AS row_no, COUNT(*) OVER (PARTITION BY doc_id, island) AS n, line FROM ({LINES_SQL}) i"
ROWS_SQL = f"SELECT doc_id, table_no, row_no, cells FROM (SELECT doc_id, table_no, row_no, list_transform(string_split(line, '|')[2:-2], lambda c: trim(c, ' ' || chr(9))) AS cells FROM ({TABLE_SQL}) t WHERE n >= 3 AND row_no > 0) c WHERE len(cells) >= 2 AND cells[1] <> ''"
YEARS_SQL = f"SELECT doc_id, table_no, TRY_CAST(nullif(regexp_extract(line, '{YEAR}', 1), '') AS INT) AS header_year FROM ({TABLE_SQL}) t WHERE n >= 3 AND row_no = 0"
CARRIED_SQL = f"SELECT doc_id, table_no, last_value(header_year IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY table_no ROWS UNBOUNDED PRECEDING) AS year FROM ({YEARS_SQL}) y"
_CASES = " ".join(f"WHEN contains(cells[1], '{w}') THEN '{LABELS[w]}'" for w in _LONGEST)
_VALUE = f"list_filter(list_transform(cells[2:], lambda c: CASE WHEN regexp_matches(replace(replace(c, ',', ''), ' ', ''), '{NUMBER}') THEN TRY_CAST(replace(replace(c, ',', ''), ' ', '') AS DOUBLE) END), lambda v: v IS NOT NULL AND v <> 0 AND abs(v) <= 1e15)[1]"
FACTS_SQL = f"SELECT * FROM (SELECT doc_id, table_no, row_no, cells[1] AS label, CASE {_CASES} END AS metric_key, {_VALUE} AS metric_value FROM ({ROWS_SQL}) r) f WHERE metric_key IS NOT NULL AND metric_value IS NOT NULL"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "statement_pages")


@query("parse_markdown_tables", f"SELECT doc_id, table_no, row_no, array_to_string(cells, '|') AS cells FROM ({ROWS_SQL}) r")
def parse_markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    return read_tables(pages(spark, d)).select("doc_id", "table_no", F.inline("rows")).withColumn("cells", F.array_join("cells", "|"))


@query("table_year", YEARS_SQL)
def table_year(spark: SparkSession, d: str) -> DataFrame:
    return read_tables(pages(spark, d)).select("doc_id", "table_no", "header_year")


@query("carry_table_year", CARRIED_SQL)
def carry_table_year(spark: SparkSession, d: str) -> DataFrame:
    return with_year(table_year(spark, d)).select("doc_id", "table_no", "year")


@query("label_metrics", FACTS_SQL)
def label_metrics(spark: SparkSession, d: str) -> DataFrame:
    return labelled(read_tables(pages(spark, d))).select("doc_id", "table_no", F.inline("rows"))


@query("extract_table_facts", f"SELECT doc_id, year, 'Q4' AS quarter, metric_key, metric_value, label AS row_label FROM (SELECT f.*, c.year, row_number() OVER (PARTITION BY f.doc_id, c.year, metric_key ORDER BY f.table_no, row_no) AS rn FROM ({FACTS_SQL}) f JOIN ({CARRIED_SQL}) c ON f.doc_id = c.doc_id AND f.table_no = c.table_no WHERE c.year IS NOT NULL) q WHERE rn = 1")
def extract_table_facts(spark: SparkSession, d: str) -> DataFrame:
    return table_facts(pages(spark, d))


#: A table of so many rows (the rule under the header is none), columns and characters is a chunk of its own.
ROWS, COLUMNS, CHARACTERS = 4, 3, 50
RULE = r"^\|[ \t:|-]*-[ \t:|-]*$"


def big_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_no (as in ``read_tables``), rows, cols and content of the tables that are chunks of their own.

    The text's first line that is not blank stands in front, unless the table itself begins there. A null text has none."""
    found = docs.select("doc_id", F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*([^\n]*)", 1).alias("head"), F.posexplode(tables_in(F.col("text"))).alias("at", "table"))
    lines = lines_of(F.col("table"))
    body = F.array_join(lines, "\n")
    read = found.select("doc_id", (F.col("at") + 1).alias("table_no"), F.size(F.filter(lines, lambda x: ~x.rlike(RULE))).alias("rows"), F.size(cells_of(lines[0])).alias("cols"), F.rtrim("head").alias("head"), body.alias("body"))
    fit = (F.col("rows") >= ROWS) & (F.col("cols") >= COLUMNS) & (F.length("body") >= CHARACTERS)
    return read.filter(fit).select("doc_id", "table_no", "rows", "cols", F.when((F.col("head") == "") | F.startswith("head", F.lit("|")), F.col("body")).otherwise(F.concat("head", F.lit("\n\n"), "body")).alias("content"))


_BIG = f"SELECT t.doc_id, table_no, COUNT(*) FILTER (WHERE NOT regexp_matches(line, '^[|][ :|-]*-[ :|-]*$')) AS rows, MAX(CASE WHEN row_no = 0 THEN len(string_split(line, '|')) - 2 END) AS cols, string_agg(line, chr(10) ORDER BY row_no) AS body FROM ({TABLE_SQL}) t GROUP BY ALL"


@query("table_chunks", f"SELECT b.doc_id, b.table_no, b.rows, b.cols, concat(string_split(p.text, chr(10))[1], chr(10), chr(10), body) AS content FROM ({_BIG}) b JOIN statement_pages p ON b.doc_id = p.doc_id WHERE b.rows >= 4 AND b.cols >= 3 AND length(body) >= 50")
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return big_tables(pages(spark, d))
