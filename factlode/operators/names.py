"""Names found in other names, both ways, by pieces of the lengths that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlode.plans.registry import query
from factlode.sources.fixtures import fixture


def pieces(text: Column, sizes: Column) -> Column:
    """The different pieces of a text that have one of these lengths."""
    fit = F.filter(sizes, lambda n: n <= F.length(text))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substr(text, k, n))
    return F.array_distinct(F.flatten(F.transform(fit, cut)))


def held(short: DataFrame, long: DataFrame) -> DataFrame:
    """(long_id, piece): what of ``long`` (id, text) can be a text of ``short``: its pieces of their lengths.

    A piece is met by equality, so no pair is made only to be refused. Empty and null texts are nowhere."""
    sizes = short.filter(F.length("text") > 0).agg(F.collect_set(F.length("text")).alias("sizes"))
    return long.filter(F.length("text") > 0).crossJoin(F.broadcast(sizes)).select(F.col("id").alias("long_id"), F.explode(pieces(F.col("text"), F.col("sizes"))).alias("piece"))


def inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short_id, long_id) of the texts of ``short`` (id, text) that stand in texts of ``long`` (id, text)."""
    return short.select(F.col("id").alias("short_id"), F.col("text").alias("piece")).join(held(short, long), "piece").select("short_id", "long_id").distinct()


def least_holder(short: DataFrame, long: DataFrame) -> DataFrame:
    """(id, found): of every text of ``short`` that stands in texts of ``long`` the least id of those; no pairs are made."""
    first = held(short, long).groupBy("piece").agg(F.min("long_id").alias("found"))
    return short.select("id", F.col("text").alias("piece")).join(first, "piece").select("id", "found")


def least_held(short: DataFrame, long: DataFrame) -> DataFrame:
    """(id, found): of every text of ``long`` in which texts of ``short`` stand the least id of those; one row a different text is joined."""
    first = short.filter(F.length("text") > 0).groupBy(F.col("text").alias("piece")).agg(F.min("id").alias("found"))
    return held(short, long).join(first, "piece").groupBy(F.col("long_id").alias("id")).agg(F.min("found").alias("found"))


def resolve(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """mention_id, symbol and how of every mention: by code ('1'), whole name ('2') or a part of one in the other ('3'), the
    least symbol of each way; null where none is found. ``mentions``: mention_id, mention; ``companies``: symbol, name."""
    code = F.regexp_replace("mention", r"[.](SH|SZ|HK)", "")
    by_code = mentions.select("mention_id", code.alias("symbol")).join(companies.select("symbol").distinct(), "symbol").select("mention_id", "symbol", F.lit(1).alias("how"))
    first = companies.groupBy(F.col("name").alias("mention")).agg(F.min("symbol").alias("symbol"))
    by_name = mentions.join(first, "mention").select("mention_id", "symbol", F.lit(2).alias("how"))
    said, known = mentions.select(F.col("mention_id").alias("id"), F.col("mention").alias("text")), companies.select(F.col("symbol").alias("id"), F.col("name").alias("text"))
    parts = least_holder(said, known).unionByName(least_held(known, said)).select(F.col("id").alias("mention_id"), F.col("found").alias("symbol"))
    found = by_code.unionByName(by_name).unionByName(parts.withColumn("how", F.lit(3)))
    best = found.groupBy("mention_id").agg(F.min(F.struct("how", "symbol")).alias("b"))
    return mentions.join(best, "mention_id", "left").select("mention_id", "b.symbol", "b.how")


MENTIONS_SQL = "SELECT o_orderkey AS mention_id, CASE o_orderkey % 5 WHEN 0 THEN concat(lpad(CAST(o_custkey AS STRING), 6, '0'), '.SZ') WHEN 1 THEN concat('Supplier#', lpad(CAST(o_custkey AS STRING), 9, '0')) WHEN 2 THEN lpad(CAST(o_custkey AS STRING), 7, '0') WHEN 3 THEN concat('关于Supplier#', lpad(CAST(o_custkey AS STRING), 9, '0'), '的年报') ELSE concat('r#', CAST(o_custkey AS STRING)) END AS mention FROM {0}"
PARTS_SQL = "CASE WHEN regexp_replace(mention, '[.](SH|SZ|HK)', '') = symbol THEN 1 WHEN mention = name THEN 2 WHEN mention <> '' AND name <> '' AND (contains(name, mention) OR contains(mention, name)) THEN 3 END"


@query("symbol_resolve", f"SELECT m.mention_id, b.symbol, b.how FROM ({MENTIONS_SQL.format('orders')}) m LEFT JOIN (SELECT mention_id, symbol, how, row_number() OVER (PARTITION BY mention_id ORDER BY how, symbol) AS rn FROM (SELECT mention_id, symbol, {PARTS_SQL} AS how FROM ({MENTIONS_SQL.format('orders')}) m, companies) c WHERE how IS NOT NULL) b ON b.mention_id = m.mention_id AND rn = 1")
def symbol_resolve(spark: SparkSession, d: str) -> DataFrame:
    mentions = spark.sql(MENTIONS_SQL.format("{orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    return resolve(mentions, fixture(spark, d, "companies").select("symbol", "name"))


FILES_SQL = "SELECT concat('file', CAST(doc_id AS STRING)) AS file, CASE doc_id % 3 WHEN 0 THEN concat('Supplier#', lpad(CAST(doc_id % 97 AS STRING), 9, '0'), CAST(2018 + doc_id % 7 AS STRING), '年报.pdf') WHEN 1 THEN lpad(CAST(doc_id % 97 AS STRING), 9, '0') ELSE concat(source, '.pdf') END AS filename FROM {0}"


@query("entity_from_filename", f"SELECT f.file, MIN(c.name) AS entity FROM ({FILES_SQL.format('documents')}) f LEFT JOIN companies c ON f.filename <> '' AND (contains(f.filename, c.name) OR contains(c.name, f.filename)) GROUP BY f.file")
def entity_from_filename(spark: SparkSession, d: str) -> DataFrame:
    """The least company name that stands in a file's name, or in which it stands."""
    files = spark.sql(FILES_SQL.format("{documents}"), documents=spark.read.parquet(f"{d}/documents.parquet"))
    named, known = files.select(F.col("file").alias("id"), F.col("filename").alias("text")), fixture(spark, d, "companies").select(F.col("name").alias("id"), F.col("name").alias("text"))
    both = least_held(known, named).unionByName(least_holder(named, known)).select(F.col("id").alias("file"), "found")
    return files.select("file").join(both.groupBy("file").agg(F.min("found").alias("entity")), "file", "left")
