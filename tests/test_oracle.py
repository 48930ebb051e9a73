"""Each query against its SQL in DuckDB, over the smallest tables."""

import glob
import math

import duckdb
import pytest

from factlode.plans import registry

NAMES = sorted(registry.oracle_sql())
SEARCH = ("match_companies", "match_metrics", "extract_years", "metric_query", "bm25_index", "bm25_search", "mrr", "recall_at_k", "ndcg_at_k")
LANGUAGE = ("split_sentences", "parse_value_unit", "sanitize_text", "document_filter", "key_map_exact", "key_map_fuzzy", "resolve_anaphora")
TABLES = ("parse_markdown_tables", "table_year", "carry_table_year", "label_metrics", "extract_table_facts", "semantic_boundaries")
SEARCH = (*SEARCH, "boosts", "rank_results", "topk_per_query", "evaluate_retrieval", "batch_evaluate", "quality_suggestion")
FILES = ("scan_text_pages", "write_chunks", "clean_json_text", "udtf_chunks", "detect_industry")
CHECKS = ("number_verification", "number_grounding", "indicator_association", "symbol_resolve", "entity_from_filename", "stream_request_stats", "usage_stream")
SCORES = ("structural_coverage", "chart_render_rate", "bm25_search_han", "facts_upsert_arrivals", "chart_recommend", "chart_series", "number_accuracy", "anchor_accuracy", "direction_claims", "benchmark_citation", "overall_score", "targets_gap", "regex_extract_metrics")
ASSESSED = ("auto_fill_all", "calc_confidence_all", "sanity_check_all", "risk_flags_by_industry", "risk_level_by_industry", "benchmark_gap_all", "table_chunks", "backfill_equity", "number_accuracy_units", "indicator_coverage")
FUSION = ("semantic_search", "overlap_search", "rrf_fuse", "precision_at_k")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "quantize"):
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted({*NAMES[::4], *SEARCH, *LANGUAGE, *FUSION, *TABLES, *CHECKS, *FILES, *SCORES, *ASSESSED}))
def test_matches_duckdb(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    assert rows == sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)


@pytest.mark.parametrize("name", ["conflict_detect_all", "group_extremes_all", "cross_company_compare_all"])
def test_whole_tables_match_duckdb(spark, sf, duck, name):
    test_matches_duckdb(spark, sf, duck, name)


def test_whole_tables_are_covered(spark, sf):
    from factlode.sources.fixtures import fixture

    facts, annual = fixture(spark, sf, "facts"), fixture(spark, sf, "annual")
    keys = lambda df, *c: {tuple(r) for r in df.select(*c).distinct().collect()}
    run = lambda name: registry.queries()[name](spark, sf)
    assert keys(run("conflict_detect_all"), "symbol", "year", "metric_key") == keys(facts, "symbol", "year", "metric_key")
    assert keys(run("group_extremes_all"), "symbol", "year", "quarter") == keys(facts, "symbol", "year", "quarter")
    assert keys(run("cross_company_compare_all"), "left_symbol", "year") == keys(annual, "symbol", "year")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_ratio_at_zero(spark):
    from pyspark.sql import functions as F

    from factlode.functions import ratio

    df = spark.createDataFrame([(1.0, 0.0), (1.0, 3.0), (-1.005, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()][:2] == [0.0, 0.33]
    assert df.select(ratio(F.col("a"), F.col("b"), 1.0, None)).first()[0] is None


def test_upsert_is_idempotent(spark):
    from factlode.operators.facts import upsert

    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, seq int")
    new = spark.createDataFrame([("a", 5, 1)], "k string, v int, seq int")
    once = upsert(old, new, ["k"], "seq")
    assert sorted(map(tuple, upsert(once, new, ["k"], "seq").select("k", "v").collect())) == [("a", 5), ("b", 2)]


def test_last_arrival_of_a_batch_wins(spark):
    from factlode.operators.facts import upsert

    kinds = "k string, v int, seq int, arrival int"
    old = spark.createDataFrame([("a", 1, 0, 9)], kinds)
    new = spark.createDataFrame([("a", 5, 1, 1), ("a", 6, 1, 2), ("b", 7, 1, 3)], kinds)
    assert sorted(map(tuple, upsert(old, new, ["k"], "seq", "arrival").select("k", "v").collect())) == [("a", 6), ("b", 7)]


def test_han_words_meet_inside_a_run(spark):
    from factlode.operators.retrieval import tokens
    from factlode.operators.search import bm25

    docs = spark.createDataFrame([(1, "公司营业收入增长"), (2, "天气晴朗"), (3, None), (4, "other words")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "营业收入")], "item_id int, text string")
    assert bm25(docs, asked).count() == 0
    assert [r["doc_id"] for r in bm25(docs, asked, words=tokens).collect()] == [1]
