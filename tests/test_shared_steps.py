"""Steps that several queries share: what they read, and how much they hold."""

from factlode.sources.fixtures import fixture


def test_unions_over_annual_scan_lineitem_once(spark, sf):
    for name in ("given_params", "chart_points", "report_values", "comment_values", "data_values"):
        plan = fixture(spark, sf, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_suppkey" not in plan and "l_shipdate" not in plan, name


def test_pages_come_in_small_batches(spark):
    from factlode.llm.common import BATCH_BYTES, BATCH_KEY
    from factlode.operators import semantic

    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.unset(BATCH_KEY)
    pages = spark.createDataFrame([(k, 1, f"第{k}句。") for k in range(3 * semantic.PAGES + 1)], "doc_id long, page int, text string")
    assert sorted(r.doc_id for r in semantic.semantic(pages).collect()) == list(range(3 * semantic.PAGES + 1))
    assert int(spark.conf.get(BATCH_KEY, "0").rstrip("bB")) <= BATCH_BYTES or before is not None
