"""Vector search, rank fusion and their scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.operators.matching import BETWEEN, best, terms_of
from factlode.operators.search import FOUND_SQL, PRECISION_SQL, SEARCH_SQL, WORDS_SQL, bm25_search, hits, precision
from factlode.plans.registry import query
from factlode.sources.fixtures import base

TOP, BLOCK, ASKED, RRF = 10, 20_000, 50, 60
NEAR = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, asked: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` vectors by cosine for each asked one: query_id, vec_id, rank, score.

    Both sides are dealt in blocks of at most about ``BLOCK`` rows; a task holds one block of
    each and keeps its best ``top``, so memory is bounded and the exact best come out of a
    window over few rows a query. Null vectors are nobody's neighbour."""
    vectors, asked = vectors.filter("embedding IS NOT NULL"), asked.filter("embedding IS NOT NULL")
    rows, queries = (max(1, math.ceil(x.count() / BLOCK)) for x in (vectors, asked))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = asked.select("vec_id", "embedding", deal(queries).alias("q")).withColumn("r", every(rows))
    right = vectors.select("vec_id", "embedding", deal(rows).alias("r")).withColumn("q", every(queries))

    def unit(t: pa.Table) -> np.ndarray:
        m = np.stack([np.asarray(x, np.float64) for x in t["embedding"].to_pylist()])
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, out = b["vec_id"].to_numpy(), []
        if a.num_rows and b.num_rows:
            x, y = unit(a), unit(b)
            for k, row in enumerate(a["vec_id"].to_pylist()):
                score = np.floor(y @ x[k] * 1e6 + 0.5) / 1e6
                at = np.lexsort((ids, -score))[:top]
                out += [(row, int(ids[i]), float(score[i])) for i in at]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    part = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(best, NEAR)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "vec_id", "rank", "score")


COSINE_SQL = "floor(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * 1000000 + 0.5) / 1000000"
NEAR_SQL = f"SELECT query_id, vec_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {COSINE_SQL} AS score FROM embeddings q, embeddings v WHERE q.vec_id % {ASKED} = 0) a) b WHERE rank <= {TOP}"


@query("semantic_search", NEAR_SQL)
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    v = base(spark, d, "embeddings")
    return nearest(v, v.filter(F.col("vec_id") % ASKED == 0))


@query("semantic_recall_at_k", f"SELECT query_id, SUM(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) / 10e0 AS recall FROM ({NEAR_SQL}) n GROUP BY query_id")
def semantic_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return semantic_search(spark, d).groupBy("query_id").agg((F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)) / float(TOP)).alias("recall"))


def overlaps(docs: DataFrame, asked: DataFrame, top: int = TOP) -> DataFrame:
    known = terms_of(asked, BETWEEN).select("item_id", "term", F.lit(1).cast("long").alias("times"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("mean"))
    found = best(docs.select("doc_id", "text"), known, asked.count(), BETWEEN, lambda weight, *_: weight, top)
    shared = found.select("item_id", "doc_id", F.col("score").cast("long").alias("shared"))
    w = Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id")
    return shared.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("item_id", "doc_id", "rank", "shared")


OVERLAP_SQL = f"SELECT item_id, doc_id, rank, shared FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, COUNT(*) AS shared FROM (SELECT DISTINCT item_id, unnest({WORDS_SQL.format('text')}) AS term FROM benchmark) q JOIN (SELECT DISTINCT doc_id, unnest({WORDS_SQL.format('text')}) AS term FROM documents) p ON q.term = p.term GROUP BY 1, 2) a) b WHERE rank <= {TOP}"


@query("overlap_search", OVERLAP_SQL)
def overlap_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the number of different words they share with an item."""
    return overlaps(base(spark, d, "documents"), base(spark, d, "benchmark"))


# Millionths, so that the order of addition changes no rank.
RRF_SQL = f"SELECT item_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, CAST(SUM(CAST(floor(1000000e0 / ({RRF} + rank) + 0.5) AS BIGINT)) AS DOUBLE) / 1000000 AS score FROM (SELECT item_id, doc_id, rank FROM ({SEARCH_SQL}) s UNION ALL SELECT item_id, doc_id, rank FROM ({OVERLAP_SQL}) o) u GROUP BY 1, 2) a) b WHERE rank <= {TOP}"


def fuse(*ranked: DataFrame, top: int = TOP) -> DataFrame:
    """Reciprocal rank fusion of frames with item_id, doc_id and rank."""
    rows = ranked[0].select("item_id", "doc_id", "rank")
    for other in ranked[1:]:
        rows = rows.unionByName(other.select("item_id", "doc_id", "rank"))
    part = F.floor(F.lit(1000000.0) / (F.lit(RRF) + F.col("rank")) + 0.5).cast("long")
    scored = rows.groupBy("item_id", "doc_id").agg((F.sum(part).cast("double") / 1000000).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("item_id", "doc_id", "rank", "score")


@query("rrf_fuse", RRF_SQL)
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fuse(bm25_search(spark, d), overlap_search(spark, d))


@query("snippets", f"SELECT item_id, rank, r.doc_id, substr(text, 1, 200) AS snippet, score FROM ({RRF_SQL}) r JOIN documents t ON r.doc_id = t.doc_id")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = base(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("snippet"))
    return rrf_fuse(spark, d).join(docs, "doc_id").select("item_id", "rank", "doc_id", "snippet", "score")


@query("precision_at_k", f"SELECT item_id, {', '.join(f'{PRECISION_SQL.format(k)} AS at_{k}' for k in (1, 3, 5))} FROM ({FOUND_SQL}) h GROUP BY item_id")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).groupBy("item_id").agg(*(precision(k).alias(f"at_{k}") for k in (1, 3, 5)))
