"""Fills, checks, risks, healthy values and table chunks on rows made by hand."""

from pyspark.sql import functions as F


def fills(spark, rows):
    from factlode.operators.assessments import confidences, filled

    params = spark.createDataFrame(rows, "case_id string, name string, value double")
    got = filled(params).cache()
    values = {(r.case_id, r.formula, r.parameter): (r.value, r.fill) for r in got.collect()}
    return values, {(r.case_id, r.formula): (r.complete, r.confidence, r.source) for r in confidences(got).collect()}


def test_every_fill(spark):
    rows = [
        ("a", "revenue_2022", 100.0), ("a", "revenue_2023", 120.0), ("a", "revenue_2023", 110.0), ("a", "revenue", 7.0), ("a", "net_profit_2023", 10.0), ("a", "total_assets", 300.0), ("a", "equity", 200.0),
        ("a", "equity", None), ("a", "avg_equity", 190.0), ("a", "eps", 2.0), ("a", "operating_profit", 0.0), ("a", "investing_cf_out_2023", 4.0), ("a", "total_shares", 0.0), ("a", "odd", 1.0),
        ("b", "operating_profit", 9.0), ("b", "revenue", None), ("b", "total_liabilities", 5.0), ("b", "inventory_2020", 3.0), ("b", "eps", 0.0), ("b", "net_profit", 1.0), ("b", "equity", 4.0),
    ]
    got, sure = fills(spark, rows)
    assert got["a", "net_profit_margin", "revenue"] == (7.0, "given")
    assert got["a", "roe", "net_profit"] == (10.0, "auto_fill:year_suffix")
    assert got["a", "roe", "avg_equity"] == (190.0, "given")
    assert got["a", "roa", "avg_total_assets"] == (300.0, "auto_fill:avg_fallback:total_assets")
    assert got["a", "debt_ratio", "total_liabilities"] == (100.0, "auto_fill:debt_computed")
    assert got["a", "revenue_growth", "current_revenue"] == (120.0, "auto_fill:growth_yearly")
    assert got["a", "revenue_growth", "previous_revenue"] == (100.0, "auto_fill:growth_yearly")
    assert got["a", "net_profit_growth", "current_profit"] == (None, None)
    assert got["a", "pb_ratio", "bvps"] == (40.0, "auto_fill:bvps_computed")
    assert got["a", "ps_ratio", "revenue_per_share"] == (1.4, "auto_fill:revenue_div_shares")
    assert got["a", "ebitda_margin", "ebitda"] == (None, None)
    assert got["a", "free_cash_flow", "capital_expenditure"] == (4.0, "auto_fill:capex_approx_investing_cf_out")
    assert got["b", "ebitda_margin", "ebitda"] == (9.0, "auto_fill:ebitda_approx")
    assert got["b", "debt_ratio", "total_liabilities"] == (5.0, "given")
    assert got["b", "inventory_turnover", "avg_inventory"] == (3.0, "auto_fill:avg_fallback:inventory")
    assert got["b", "pb_ratio", "bvps"] == (None, None)
    assert sure["a", "roe"] == (True, 0.95, "calc") and sure["a", "debt_ratio"] == (True, 0.8, "calc:auto_fill")
    assert sure["b", "net_profit_margin"] == (False, 0.95, "calc") and sure["b", "ebitda_margin"] == (False, 0.8, "calc:auto_fill")


def test_no_parameters(spark):
    assert fills(spark, []) == ({}, {})


def test_risks_by_industry(spark):
    from factlode.operators.assessments import levels, risks

    rows = [
        ("a", "debt_ratio", "银行", 91.0, "yellow"), ("b", "debt_ratio", "", 91.0, "red"), ("b", "debt_ratio", "", 70.0, "yellow"), ("b", "debt_ratio", None, 60.0, "green"), ("c", "debt_ratio", "渔业", 71.0, "red"),
        ("a", "current_ratio", "电力", 0.5, "yellow"), ("b", "current_ratio", "白酒", 1.4, "red"), ("c", "current_ratio", "", 2.0, "green"),
        ("a", "quick_ratio", "电力", 0.4, "red"), ("b", "quick_ratio", "", 0.5, "yellow"), ("c", "quick_ratio", "", 1.0, None), ("c", "quick_ratio", "", None, None),
        ("a", "cf_to_net_profit", "", 49.0, "red"), ("b", "cf_to_net_profit", "", 99.0, "yellow"), ("c", "cf_to_net_profit", "", 100.0, "green"), ("c", "roe", "", 1.0, None),
    ]
    given = spark.createDataFrame([(s, 2020, f, i, v, e) for s, f, i, v, e in rows], "symbol string, year int, formula string, industry string, value double, expected string")
    got = risks(given)
    assert got.filter("NOT flag <=> expected").count() == 0
    assert got.count() == sum(r[4] is not None for r in rows)
    assert {r.symbol: (r.reds, r.level) for r in levels(got).collect()} == {"a": (2, "high"), "b": (2, "high"), "c": (1, "medium")}


def test_healthy_values(spark):
    from factlode.operators.assessments import healthy_value

    names = {"毛利率": 30.0, "净资产收益率（加权）": 15.0, "比率": 2.0, "率": 30.0, "其他": None, "经营现金流/净利润比率": 100.0, None: None}
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", healthy_value(F.col("name")).alias("v"))
    assert {r.name: r.v for r in got.collect()} == names


def test_sanity(spark):
    from factlode.operators.assessments import checked
    from factlode.operators.formulas import RATIOS

    columns = "revenue cost_of_revenue selling_expenses admin_expenses rd_expenses finance_expenses operating_profit net_profit total_assets total_liabilities current_assets current_liabilities inventory receivables interest_expense operating_cf investing_cf_out eps price bvps rps avg_equity avg_total_assets avg_inventory avg_receivables prev_revenue prev_net_profit"
    rows = [("x", 1, 100.0, 0.0), ("x", 2, 100.0, 1001.0), ("x", 3, 100.0, 50.0), ("x", 4, 0.0, 5.0), ("x", 5, 100.0, 1.0), ("x", 6, 100.0, 0.5), ("x", 7, None, 5.0)]
    frame = spark.createDataFrame(rows, "symbol string, year int, operating_cf double, investing_cf_out double")
    frame = frame.withColumns({c: F.lit(10.0) for c in columns.split() if c not in ("operating_cf", "investing_cf_out", "net_profit")} | {"net_profit": F.lit(-1.0)})
    got = {(r.formula, r.year): r.problem for r in checked(frame).collect()}
    assert {y: got["free_cash_flow", y] for y in range(1, 7)} == {1: "no_capex", 2: "capex", 3: None, 4: None, 5: None, 6: "no_capex"}
    assert ("free_cash_flow", 7) not in got
    assert got["roe", 1] == "range" and got["debt_ratio", 1] is None and got["net_profit_growth", 1] is None
    assert set(RATIOS) >= {f for f, _ in got if f != "free_cash_flow"}


def test_table_chunks(spark):
    from factlode.operators.tables import big_tables

    wide = "| 项目 | 2023年 | 2022年 |\n|---|:--:|---|\n" + "\n".join(f"| 第{k}项的全名 | 12345678 | 87654321 |" for k in range(3))
    texts = [
        ("a", f"\n  \n合并利润表 \n说明\n{wide}\n尾\n| x | y |\n|---|---|\n| 1 | 2 |"),
        ("b", wide),
        ("c", wide.rsplit("\n", 1)[0]),
        ("d", "|a|b|c|\n|---|---|---|\n|1|2|3|\n|1|2|3|\n|1|2|3|"),
        ("e", None), ("f", ""), ("g", "无表格"),
    ]
    got = {r.doc_id: (r.table_no, r.rows, r.cols, r.content) for r in big_tables(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert got == {"a": (1, 4, 3, f"合并利润表\n\n{wide}"), "b": (1, 4, 3, wide)}


def test_numbers_in_units(spark):
    from factlode.operators.measures import accuracy_in_units, indicators_named

    reports = [("a", "收入12.35亿元，流出710.7亿，共615亿，0"), ("b", "亏损-50 元，2%"), ("c", None), ("d", "")]
    values = [("a", "收入", 1.2345e9), ("a", "投资现金流", -7.1068e10), ("a", "ROE", 9.0), ("a", "Free_Cash_flow", 6.1549e10), ("a", "小额", 10.0), ("a", "负债", 8e9), ("b", "利润", -51.1), ("b", "亏损", -50.9), ("c", "收入", 20.0), ("d", "率", None)]
    reports = spark.createDataFrame(reports, "report_id string, text string")
    values = spark.createDataFrame(values, "report_id string, name string, value double")
    got = {r.report_id: (r.total, r.matched, r.accuracy) for r in accuracy_in_units(reports, values).collect()}
    # 10 in 万 and 亿 is 0, which stands in the text; -51.1 is over 2 % from -50.
    assert got == {"a": (5, 4, 0.8), "b": (2, 1, 0.5), "c": (1, 0, 0.0), "d": (0, 0, 1.0)}
    got = {r.report_id: (r.total, r.found, r.coverage) for r in indicators_named(reports, values).collect()}
    assert got == {"a": (6, 1, 0.1667), "b": (2, 1, 0.5), "c": (1, 0, 0.0), "d": (1, 0, 0.0)}
    assert accuracy_in_units(reports.limit(0), values).count() == 0
