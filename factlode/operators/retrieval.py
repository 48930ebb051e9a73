"""What is built on ranked results: tokens, boosts, filters, the composed search, contexts and measures.

Each search runs all questions in one job; only postings of asked words are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.llm.common import save
from factlode.operators.fusion import RRF_SQL, fuse, overlaps, rrf_fuse
from factlode.operators.matching import BETWEEN, best
from factlode.operators.search import FOUND_SQL, NDCG_SQL, PRECISION_SQL, RECALL_SQL, RR_SQL, SCORES_SQL, SEARCH_SQL, TOP, WORDS_SQL, bm25, hits, millionths, ndcg, precision, recall, reciprocal_rank, weighted
from factlode.plans.registry import query
from factlode.sources.fixtures import base, fixture

HAN = r"[\x{4e00}-\x{9fff}]"
PIECES = rf"{HAN}+|[^\s\p{{Z}}\p{{C}}\p{{P}}\p{{S}}\x{{4e00}}-\x{{9fff}}]+"


def tokens(text: Column) -> Column:
    """Words of any script, lower-cased; runs of Han characters as pairs of neighbours."""
    pairs = lambda m: F.transform(F.sequence(F.lit(1), F.length(m) - 1), lambda k: F.substr(m, k, F.lit(2)))
    split = lambda m: F.when(m.rlike(HAN) & (F.length(m) > 1), pairs(m)).otherwise(F.array(m))
    return F.flatten(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PIECES), F.lit(0)), split))


TOKENS_SQL = f"flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '{PIECES}'), lambda m: CASE WHEN regexp_matches(m, '{HAN}') AND length(m) > 1 THEN list_transform(range(1, length(m)), lambda k: substr(m, k, 2)) ELSE [m] END))"


@query("tokenize", f"SELECT doc_id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


# Each sector asks, in Han script, how its companies' sales moved.
_ASKED_HAN = "SELECT DISTINCT sector AS item_id, concat('营收同比', CASE WHEN length(sector) % 2 = 0 THEN '增长' ELSE '下滑' END, ' 行业平均 2021年') AS text FROM companies"
_HAN_SQL = SEARCH_SQL.replace(WORDS_SQL.format("text"), TOKENS_SQL).replace("FROM documents", "FROM (SELECT report_id AS doc_id, text FROM comments) pages").replace("FROM benchmark", f"FROM ({_ASKED_HAN}) asked")


@query("bm25_search_han", _HAN_SQL)
def bm25_search_han(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over tokens: pairs of neighbouring Han characters meet where whole runs would not."""
    sales = F.concat(F.lit("营收同比"), F.when(F.length("sector") % 2 == 0, "增长").otherwise("下滑"), F.lit(" 行业平均 2021年"))
    asked = fixture(spark, d, "companies").select(F.col("sector").alias("item_id"), sales.alias("text")).distinct()
    return bm25(fixture(spark, d, "comments").select(F.col("report_id").alias("doc_id"), "text"), asked, words=tokens)


# Questions name a nation, whose documents weigh more, and years, which count where a file name has one.
ASKED_SQL = SCORES_SQL.replace("FROM benchmark", "FROM (SELECT qid AS item_id, query AS text FROM questions) asked")
BOOST_SQL = f"""SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT s.item_id, s.doc_id, score * (CASE WHEN c.entity = concat('NATION_', CAST(n.n_nationkey AS VARCHAR)) THEN 1.5e0 ELSE 1e0 END)
 * (CASE WHEN regexp_matches(c.source, '_[0-9]{{4}}[.]') AND contains(q.query, regexp_extract(c.source, '_([0-9]{{4}})[.]', 1)) THEN 1.2e0 ELSE 1e0 END) AS score
FROM ({ASKED_SQL}) s JOIN corpus c ON s.doc_id = c.doc_id JOIN questions q ON q.qid = s.item_id LEFT JOIN nation n ON n.n_name = regexp_extract(q.query, '^(.*?) 20[0-9]{{2}}', 1)) x) y WHERE rank <= {TOP}"""
RANKED_SQL = f"SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ({BOOST_SQL}) b"


def boosted(docs: DataFrame, corpus: DataFrame, asked: DataFrame, nations: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, doc_id, score of the ``top`` documents of each question (qid, query): every score is multiplied by 1.5 for a
    document of the question's nation and by 1.2 for one whose file name has a year that it names; the best are kept after that."""
    # Questions whose known words are the same have the same scores: one of them, the least, asks for all.
    known = weighted(docs.select("doc_id", "text"), asked.select(F.col("qid").alias("item_id"), F.col("query").alias("text")))
    bags = known.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("bag"))
    asks = save(bags.withColumn("ask", F.min("item_id").over(Window.partitionBy("bag"))).select(F.col("item_id").alias("qid"), "ask"), "asks")
    known = known.join(asks.select(F.col("ask").alias("item_id")).distinct(), "item_id", "left_semi")
    # What multiplies a score is the same for all documents of an entity and a year, so the best of each such kind hold the best of all.
    placed = corpus.select("doc_id", F.coalesce("entity", F.lit("")).alias("entity"), F.coalesce(F.regexp_extract("source", "_([0-9]{4})[.]", 1), F.lit("")).alias("year"), *(["text"] if docs is corpus else []))
    kinds = placed if docs is corpus else docs.select("doc_id", "text").join(placed, "doc_id")
    found = best(kinds, known, asks.select("ask").distinct().count(), BETWEEN, millionths, top, ["entity", "year"])
    at = Window.partitionBy("item_id", "entity", "year").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= top).select(F.col("item_id").alias("ask"), "doc_id", "entity", "year", (F.col("score") / 1000000).alias("score"))
    # A question's answer hangs on its words, its nation and those years that file names have.
    wanted = nations.select("n_name", F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("wanted"))
    years = placed.filter("year <> ''").agg(F.collect_set("year").alias("years"))
    named = asked.withColumn("n_name", F.regexp_extract("query", "^(.*?) 20[0-9]{2}", 1)).join(wanted, "n_name", "left").join(asks, "qid").crossJoin(F.broadcast(years))
    named = named.select("qid", "ask", F.coalesce("wanted", F.lit("")).alias("wanted"), F.array_sort(F.filter("years", lambda y: F.contains(F.col("query"), y))).alias("years"))
    entity = F.when((F.col("entity") == F.col("wanted")) & (F.col("wanted") != ""), 1.5).otherwise(1.0)
    score = F.col("score") * entity * F.when(F.array_contains("years", F.col("year")), 1.2).otherwise(1.0)
    w = Window.partitionBy("ask", "wanted", "years").orderBy(F.desc("score"), "doc_id")
    rows = named.select("ask", "wanted", "years").distinct().join(found, "ask").select("ask", "wanted", "years", "doc_id", score.alias("score"))
    kept = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("rank")
    return named.join(kept, ["ask", "wanted", "years"]).select(F.col("qid").alias("item_id"), "doc_id", "score")


@query("boosts", BOOST_SQL)
def boosts(spark: SparkSession, d: str) -> DataFrame:
    corpus = fixture(spark, d, "corpus")
    return boosted(corpus, corpus, fixture(spark, d, "questions"), base(spark, d, "nation"))


@query("rank_results", RANKED_SQL)
def rank_results(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return boosts(spark, d).withColumn("rank", F.row_number().over(w))


@query("topk_per_query", f"SELECT * FROM ({RANKED_SQL}) r WHERE rank <= 5")
def topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    return rank_results(spark, d).filter("rank <= 5")


# The sources that a search is restricted to are a table of their own.
SOURCES_SQL = "FROM (SELECT * FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING COUNT(*) % 2 = 0)) documents"


def listed(spark: SparkSession, d: str) -> DataFrame:
    """Documents of listed sources; the names go to the texts, so that texts are not dealt by a few sources."""
    docs = base(spark, d, "documents")
    return docs.join(F.broadcast(docs.groupBy("source").agg(F.count("*").alias("n")).filter("n % 2 = 0").select("source")), "source", "left_semi")


@query("filtered_search", SEARCH_SQL.replace("FROM documents", SOURCES_SQL))
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the documents of listed sources alone; the restriction comes before any scoring."""
    return bm25(listed(spark, d), base(spark, d, "benchmark"))


@query("hybrid_search", f"SELECT * FROM ({RRF_SQL.replace('FROM documents', SOURCES_SQL)}) h WHERE rank <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Restriction, two searches, rank fusion and the best five, for all questions in one job."""
    docs, asked = listed(spark, d), base(spark, d, "benchmark")
    return fuse(bm25(docs, asked), overlaps(docs, asked), top=5)


@query("context_blocks", f"SELECT item_id, string_agg(concat('[', CAST(rank AS VARCHAR), '] ', substr(coalesce(text, ''), 1, 200)), chr(10) ORDER BY rank) AS context FROM ({RRF_SQL}) r JOIN documents t ON r.doc_id = t.doc_id GROUP BY item_id")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A question's best passages, numbered, as one text."""
    docs = base(spark, d, "documents").select("doc_id", F.coalesce(F.substring("text", 1, 200), F.lit("")).alias("passage"))
    rows = rrf_fuse(spark, d).join(docs, "doc_id").withColumn("line", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "passage"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "line")))
    return rows.groupBy("item_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


@query("quotations", f"SELECT item_id, rank, r.doc_id, substr(text, 1, 500) AS quotation, CASE WHEN score >= 0.03 THEN 0.85e0 WHEN score > 0 THEN 0.5e0 ELSE 0e0 END AS confidence FROM ({RRF_SQL}) r JOIN documents t ON r.doc_id = t.doc_id WHERE rank <= 3")
def quotations(spark: SparkSession, d: str) -> DataFrame:
    docs = base(spark, d, "documents").select("doc_id", F.substring("text", 1, 500).alias("quotation"))
    sure = F.when(F.col("score") >= 0.03, 0.85).when(F.col("score") > 0, 0.5).otherwise(0.0)
    return rrf_fuse(spark, d).filter("rank <= 3").join(docs, "doc_id").select("item_id", "rank", "doc_id", "quotation", sure.alias("confidence"))


MEASURES_SQL = f"SELECT item_id, {RR_SQL} AS rr, {NDCG_SQL} AS ndcg_5, {', '.join(f'{RECALL_SQL.format(k)} AS recall_{k}, {PRECISION_SQL.format(k)} AS precision_{k}' for k in (1, 3, 5))} FROM ({FOUND_SQL}) h GROUP BY item_id"
NAMES = ("rr", "ndcg_5", "recall_1", "recall_3", "recall_5", "precision_5")


@query("evaluate_retrieval", MEASURES_SQL)
def evaluate_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """All measures of each question in one pass over its ranked results."""
    parts = [x for k in (1, 3, 5) for x in (recall(k).alias(f"recall_{k}"), precision(k).alias(f"precision_{k}"))]
    return hits(spark, d).groupBy("item_id").agg(reciprocal_rank().alias("rr"), ndcg().alias("ndcg_5"), *parts)


MEAN = "floor(avg({0}) * 1000000 + 0.5) / 1000000 AS {0}"
# Long questions are harder to answer in the first documents.
LEVEL_SQL = "CASE WHEN length(text) < 120 THEN 'easy' WHEN length(text) < 240 THEN 'medium' ELSE 'hard' END"


@query("batch_evaluate", f"SELECT coalesce(difficulty, 'all') AS difficulty, COUNT(*) AS n, {', '.join(MEAN.format(c) for c in NAMES)} FROM (SELECT m.*, {LEVEL_SQL} AS difficulty FROM ({MEASURES_SQL}) m JOIN benchmark b ON m.item_id = b.item_id) g GROUP BY GROUPING SETS ((difficulty), ())")
def batch_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Mean measures overall and by difficulty."""
    levels = base(spark, d, "benchmark").select("item_id", F.expr(LEVEL_SQL).alias("difficulty"))
    means = [(F.floor(F.avg(c) * 1000000 + 0.5) / 1000000).alias(c) for c in NAMES]
    rows = evaluate_retrieval(spark, d).join(levels, "item_id").rollup("difficulty").agg(F.count("*").alias("n"), *means)
    return rows.withColumn("difficulty", F.coalesce("difficulty", F.lit("all")))


@query("quality_suggestion", f"SELECT item_id, CASE WHEN recall_5 < 0.7 THEN 'widen the search' WHEN precision_5 < 0.2 THEN 'tighten the filter' ELSE 'good' END AS suggestion FROM ({MEASURES_SQL}) m")
def quality_suggestion(spark: SparkSession, d: str) -> DataFrame:
    advice = F.when(F.col("recall_5") < 0.7, "widen the search").when(F.col("precision_5") < 0.2, "tighten the filter").otherwise("good")
    return evaluate_retrieval(spark, d).select("item_id", advice.alias("suggestion"))
