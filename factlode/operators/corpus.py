"""Documents: manifests, pages, chunks, tables and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlode.functions import r2, r2_sql
from factlode.plans.registry import query
from factlode.sources.fixtures import base, fixture

CHANGES_SQL = "SELECT coalesce(n.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS status FROM manifest_new n FULL OUTER JOIN manifest_old o ON n.name = o.name"


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = old.select("name", F.col("hash").alias("old")), new.select("name", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return n.join(o, "name", "full_outer").select("name", status.alias("status"))


@query("corpus_changes", CHANGES_SQL)
def corpus_changes(spark: SparkSession, d: str) -> DataFrame:
    return manifest_changes(fixture(spark, d, "manifest_old"), fixture(spark, d, "manifest_new"))


@query("incremental_corpus", f"SELECT status, COUNT(*) AS n FROM ({CHANGES_SQL}) c WHERE status <> 'unchanged' GROUP BY status")
def incremental_corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus_changes(spark, d).filter("status <> 'unchanged'").groupBy("status").agg(F.count("*").alias("n"))


@query("snapshot_compare", "SELECT 'added' AS side, name FROM (SELECT name FROM manifest_new EXCEPT SELECT name FROM manifest_old) a UNION ALL SELECT 'removed', name FROM (SELECT name FROM manifest_old EXCEPT SELECT name FROM manifest_new) r")
def snapshot_compare(spark: SparkSession, d: str) -> DataFrame:
    old, new = fixture(spark, d, "manifest_old").select("name"), fixture(spark, d, "manifest_new").select("name")
    added, removed = new.exceptAll(old).withColumn("side", F.lit("added")), old.exceptAll(new).withColumn("side", F.lit("removed"))
    return added.unionByName(removed)


@query("snapshot_list", "SELECT source AS snapshot, COUNT(*) AS n FROM documents GROUP BY source ORDER BY source DESC")
def snapshot_list(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d, "documents").groupBy(F.col("source").alias("snapshot")).agg(F.count("*").alias("n")).orderBy(F.desc("snapshot"))


@query("route_by_extension", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'exe' WHEN doc_id % 5 = 1 THEN 'md' ELSE 'txt' END AS ext, CASE WHEN doc_id % 5 = 0 THEN 'unsupported type' WHEN n_chars > 20000 THEN 'too large' END AS reason FROM documents")
def route_by_extension(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("doc."), F.when(F.col("doc_id") % 5 == 0, "exe").when(F.col("doc_id") % 5 == 1, "md").otherwise("txt"))
    ext = F.regexp_extract(name, r"\.([a-z]+)$", 1)
    reason = F.when(~ext.isin("pdf", "docx", "doc", "md", "txt"), "unsupported type").when(F.col("n_chars") > 20000, "too large")
    return base(spark, d, "documents").select("doc_id", ext.alias("ext"), reason.alias("reason"))


@query("logical_pages", "SELECT doc_id, CAST((rn - 1) // 3 + 1 AS BIGINT) AS page, COUNT(*) AS paragraphs FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) l WHERE trim(line) <> '') p GROUP BY 1, 2")
def logical_pages(spark: SparkSession, d: str) -> DataFrame:
    lines = base(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n"))).filter(F.trim("col") != "")
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.select("doc_id", (F.floor((rn - 1) / 3) + 1).alias("page")).groupBy("doc_id", "page").agg(F.count("*").alias("paragraphs"))


CHUNK = 500
CHUNKS_SQL = f"SELECT doc_id, source, k AS pos, trim(substr(text, CAST(k * 400 + 1 AS BIGINT), {CHUNK})) AS content FROM (SELECT doc_id, source, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 400.0) AS BIGINT)))) AS k FROM corpus) c"


def fixed_chunks(corpus: DataFrame) -> DataFrame:
    """Windows of 500 characters, each 400 after the one before."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 400.0).cast("int"))
    cut = corpus.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return cut.select("doc_id", "source", F.col("pos").cast("long").alias("pos"), F.trim(F.substr("text", F.col("pos") * 400 + 1, F.lit(CHUNK))).alias("content"))


@query("fixed_chunks", CHUNKS_SQL)
def fixed(spark: SparkSession, d: str) -> DataFrame:
    return fixed_chunks(fixture(spark, d, "corpus"))


@query("document_stats", f"SELECT source, COUNT(*) AS chunks, COUNT(DISTINCT doc_id) AS pages FROM ({CHUNKS_SQL}) c GROUP BY source")
def document_stats(spark: SparkSession, d: str) -> DataFrame:
    return fixed(spark, d).groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("pages"))


@query("delete_by_source", f"SELECT source, COUNT(*) AS chunks FROM ({CHUNKS_SQL}) c WHERE source NOT LIKE 'src1_%' GROUP BY source")
def delete_by_source(spark: SparkSession, d: str) -> DataFrame:
    gone = fixture(spark, d, "corpus").filter(F.col("source").rlike("^src1.")).select("source").distinct()
    return fixed(spark, d).join(gone, "source", "left_anti").groupBy("source").agg(F.count("*").alias("chunks"))


@query("corpus_stats", f"SELECT lang, COUNT(*) AS files, {r2_sql('(SUM(n_chars) / 1048576e0)')} AS mb FROM documents GROUP BY lang")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), r2(F.sum("n_chars") / 1048576.0).alias("mb"))


@query("validate_documents", "SELECT doc_id, 'too small' AS issue FROM documents WHERE n_chars < 100 UNION ALL SELECT doc_id, 'large' FROM documents WHERE n_chars > 20000")
def validate_documents(spark: SparkSession, d: str) -> DataFrame:
    issues = F.array(F.when(F.col("n_chars") < 100, "too small"), F.when(F.col("n_chars") > 20000, "large"))
    return base(spark, d, "documents").select("doc_id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


@query("active_documents", f"SELECT c.doc_id, c.source, k.n AS chunk_count FROM corpus c LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM ({CHUNKS_SQL}) c GROUP BY doc_id) k ON c.doc_id = k.doc_id WHERE c.lang = 'en'")
def active_documents(spark: SparkSession, d: str) -> DataFrame:
    counts = fixed(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return fixture(spark, d, "corpus").filter("lang = 'en'").join(counts, "doc_id", "left").select("doc_id", "source", F.col("n").alias("chunk_count"))


@query("tag_entities", f"SELECT c.doc_id, c.pos, e.entity FROM ({CHUNKS_SQL}) c JOIN corpus e ON c.doc_id = e.doc_id")
def tag_entities(spark: SparkSession, d: str) -> DataFrame:
    return fixed(spark, d).select("doc_id", "pos").join(fixture(spark, d, "corpus").select("doc_id", "entity"), "doc_id")


@query("merge_paragraphs", "SELECT doc_id, island, COUNT(*) AS blocks FROM (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = 1 THEN 0 ELSE 1 END AS new FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) l WHERE length(line) >= 40) a) b GROUP BY doc_id, island")
def merge_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    lines = base(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n"))).filter(F.length("col") >= 40)
    w = Window.partitionBy("doc_id").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) == 1, 0).otherwise(1)
    islands = lines.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.count("*").alias("blocks"))


@query("drop_page_noise", "SELECT doc_id, COUNT(*) AS kept FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) l WHERE ((pos - 1) * 20) % 800 BETWEEN 64 AND 736 AND NOT regexp_full_match(line, '[0-9]{1,3}') GROUP BY doc_id")
def drop_page_noise(spark: SparkSession, d: str) -> DataFrame:
    lines = base(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")))
    y = (F.col("pos") * 20) % 800
    return lines.filter(y.between(64, 736) & ~F.col("col").rlike("^[0-9]{1,3}$")).groupBy("doc_id").agg(F.count("*").alias("kept"))


SENTENCE, SHORT = r"[^。！？；\n.!?]*[。！？；\n.!?]+|[^。！？；\n.!?]+", 20


@query("split_sentences", f"SELECT doc_id, CAST(k AS BIGINT) AS pos, string_agg(piece, '' ORDER BY i) AS sentence FROM (SELECT doc_id, i, piece, SUM(CASE WHEN length(piece) >= {SHORT} OR i = lowest THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, MIN(i) OVER (PARTITION BY doc_id) AS lowest FROM (SELECT doc_id, trim(unnest(p), ' ' || chr(10)) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}') AS p FROM documents) a) b WHERE piece <> '') c) d GROUP BY doc_id, k")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of whole texts; a piece under ``SHORT`` characters goes to the one before it.

    The window is bounded by one document's pieces. Null and blank texts have none."""
    pieces = base(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("at", "piece"))
    pieces = pieces.withColumn("piece", F.trim("piece", F.lit(" \n"))).filter("piece <> ''")
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.length("piece") >= SHORT) | (F.min("at").over(w) == F.col("at"))
    k = pieces.withColumn("starts", starts.cast("long")).withColumn("pos", F.sum("starts").over(w))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    return k.groupBy("doc_id", "pos").agg(F.array_join(joined, "").alias("sentence"))
