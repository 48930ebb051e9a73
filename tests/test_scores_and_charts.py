"""Kinds of charts, labels of series, claims, scores and metrics in words, each on small cases."""

import pytest

POINTS = "chart string, pos int, label string, value double"


@pytest.mark.parametrize(
    ("points", "want"),
    [
        ([(None, 1.0)], ("bar", 0.3)),
        ([("净流", 1.0), ("增速", -1.0)], ("bar", 0.85)),
        ([("营业收入", 5.0), ("营业成本", 3.0)], ("bar", 0.9)),
        ([("净利率", 500.0), ("毛利率", 20000.0), ("周转", 300.0)], ("radar", 0.85)),
        ([("A股", 60.0), ("B股", 39.5)], ("pie", 0.85)),
        ([("ROE_2020", 40.0), ("ROE_2021", 50.0)], ("line", 0.95)),
        ([("ROE_2020", 4.0), ("ROA_2021", 5.0)], ("dual_axis", 0.85)),
        ([("a", 1.0), ("b", 2.0), ("c", 3.0)], ("radar", 0.9)),
        ([(f"d{i}", 1.0 + i) for i in range(7)], ("bar", 0.85)),
        ([("a", 1.0), ("b", 2.0)], ("bar", 0.8)),
        ([("a", 1.0)], ("bar", 0.4)),
        ([("a", None)], ("bar", 0.4)),
    ],
)
def test_each_rule_of_charts(spark, points, want):
    from factlode.operators.charts import recommend

    rows = [("x", i, label, value) for i, (label, value) in enumerate(points)]
    assert tuple(recommend(spark.createDataFrame(rows, POINTS)).first())[1:] == want


def test_series_of_two_companies_and_repeated_labels(spark):
    from factlode.operators.charts import series

    rows = [("x", 1, "task9_roe_2021", 1.0), ("x", 2, "task3_ROE（净资产收益率）", 2.0), ("x", 3, "task9_净资产收益率", 3.0), ("x", 4, "eps", None), ("x", 5, "每股收益_2020", 4.0), ("x", 6, None, 5.0), ("y", 1, "task1_a", 1.0)]
    got = series(spark.createDataFrame(rows, POINTS)).orderBy("chart", "pos").collect()
    assert [tuple(r) for r in got] == [("x", 1, "净资产收益率(公司A)", 1.0), ("x", 2, "净资产收益率(公司B)", 2.0), ("x", 4, "每股收益", None), ("y", 1, "a(公司A)", 1.0)]
    assert series(spark.createDataFrame([], POINTS)).count() == 0


def test_claims_against_directions(spark):
    from factlode.operators.measures import judged_claims

    reports = spark.createDataFrame([("a", "毛利率下降，净利润\n增长。营收增长"), ("b", "一切照旧"), ("c", None)], "report_id string, text string")
    rows = [("a", "毛利率", 2020, 10.0), ("a", "毛利率", 2021, 9.0), ("a", "净利润", 2020, 1.0), ("a", "净利润", 2021, 2.0), ("a", "营收", 2019, 9.0), ("a", "营收", 2020, 0.0), ("a", "营收", 2021, 2.0)]
    got = judged_claims(reports, spark.createDataFrame(rows, "report_id string, indicator string, year int, value double"))
    # "毛利率下降" is right; "下降，净利润" says that profit fell, which rose; no claim reaches over a line; revenue has no direction after a zero.
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1, 0.5), ("b", 0, 0, 1.0), ("c", 0, 0, 1.0)}


def test_wrong_claim_is_counted_once_for_one_wording(spark):
    from factlode.operators.measures import judged_claims

    reports = spark.createDataFrame([("a", "毛利率上升。\n毛利率上升。")], "report_id string, text string")
    values = spark.createDataFrame([("a", "毛利率", 2020, 10.0), ("a", "毛利率", 2021, 9.0)], "report_id string, indicator string, year int, value double")
    assert tuple(judged_claims(reports, values).first()) == ("a", 1, 1, 0.0)


def test_accuracy_keeps_reports_without_numbers_and_tolerances(spark):
    from factlode.operators.measures import accuracy

    reports = spark.createDataFrame([("a", "营收为103元"), ("b", None), ("c", "毛利率106")], "report_id string, text string")
    wanted = spark.createDataFrame([("a", "营收", 100.0, None, True), ("a", "成本", 1.0, None, False), ("c", "毛利率", 100.0, 0.07, True)], "report_id string, name string, expected double, tolerance double, verified boolean")
    got = {r["report_id"]: (r["total"], r["matched"], r["accuracy"], r["anchors"], r["anchor_accuracy"]) for r in accuracy(reports, wanted).collect()}
    assert got == {"a": (2, 0, 0.0, 1, 0.0), "b": (0, 0, 1.0, 0, 1.0), "c": (1, 1, 1.0, 1, 1.0)}


def test_overall_weighs_what_is_there_and_counts_missing_tasks(spark):
    from factlode.operators.measures import against_targets, overall

    tasks = spark.createDataFrame([("a", "template", 1, 2), ("b", "freeform", 5, 2), ("c", "template", 0, 0)], "report_id string, kind string, n_tasks int, min_tasks int")
    scores = spark.createDataFrame([("a", "anchor_accuracy", 1.0), ("a", "number_accuracy", 0.5), ("a", "unknown", 9.0), ("b", "number_accuracy", None), ("b", "anchor_accuracy", 0.4)], "report_id string, measure string, score double")
    assert {r[0]: r[1] for r in overall(scores, tasks).collect()} == {"a": 0.4, "b": 0.4, "c": 0.0}
    rows = {r["measure"]: r for r in against_targets(scores).collect()}
    assert set(rows) == {"anchor_accuracy", "number_accuracy"} and rows["anchor_accuracy"]["gap"] == 0.25 and not rows["anchor_accuracy"]["pass"]


def test_metrics_in_words_take_the_first_and_the_main_year(spark):
    from factlode.operators.measures import metrics_by_pattern

    text = "2020年1家。2021年营业收入约1709.90 亿元，2021年毛利率为 91.5%，营收 3 元。ROE在很久很久以前是 3%"
    got = metrics_by_pattern(spark.createDataFrame([(1, text), (2, None), (3, "总资产 5 万元")], "doc_id int, text string")).collect()
    assert {(r["doc_id"], r["key"], r["value"]) for r in got} == {(1, "营业收入_2021", 1709.9), (1, "毛利率_2021", 91.5), (3, "总资产", 5.0)}


def test_parts_are_met_by_words_and_other_words(spark):
    from factlode.operators.measures import coverage

    reports = spark.createDataFrame([("a", "本文含杜邦分析与roe"), ("b", None), ("c", "x")], "report_id string, text string")
    dims = spark.createDataFrame([("a", "杜邦分解"), ("a", "ROE_2024"), ("a", "打分"), ("b", "打分"), ("b", "__"), ("b", None)], "report_id string, dim string")
    assert {tuple(r) for r in coverage(reports, dims).collect()} == {("a", 3, 2, 0.6667), ("b", 2, 0, 0.0), ("c", 0, 0, 1.0)}


def test_drawn_charts_count_where_expected(spark):
    from factlode.operators.measures import render_rate

    points = spark.createDataFrame([("a", "x", 1.0), ("a", "x", None), ("a", "y", None), ("b", "z", None)], "report_id string, chart string, value double")
    reports = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", False)], "report_id string, expected boolean")
    assert {tuple(r) for r in render_rate(points, reports).collect()} == {("a", 2, 1, 0.5), ("b", 1, 0, 1.0), ("c", 0, 0, 0.0), ("d", 0, 0, 1.0)}
