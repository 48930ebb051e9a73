"""Texts in and out: whole files as pages, chunks as a partitioned table, JSON and terms in free text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType

from factlode.functions import contains
from factlode.operators.corpus import CHUNK, CHUNKS_SQL, fixed
from factlode.plans.registry import query
from factlode.sources.fixtures import base, fixture
from factlode.streaming import stream_folder

BLANK = " \t\r\n"


def _gbk(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    try:
        return raw.decode("gbk")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def from_gbk(content: pd.Series) -> pd.Series:
    """Bytes as GBK; those that are not, as UTF-8 with a mark for each bad byte."""
    return content.map(_gbk)


def pages_of(files: DataFrame) -> DataFrame:
    """source, page and text of files (path, content): page 1 is the whole text without blanks round it.

    Bytes that are UTF-8 stay in the JVM; only others go through Python. Files without text, empty ones
    and null contents give no page."""
    plain = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(from_gbk("content"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(name.alias("source"), F.lit(1).alias("page"), F.trim(text, F.lit(BLANK)).alias("text")).filter("text <> ''")


def scan_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """Pages of the text and markdown files under a folder, at any depth."""
    return pages_of(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content"))


@query("scan_text_pages", f"SELECT * FROM (SELECT concat('file', CAST(doc_id AS VARCHAR), '.txt') AS source, 1 AS page, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 5 = 0 THEN '你好世界' ELSE trim(text, ' ' || chr(9) || chr(13) || chr(10)) END AS text FROM documents) f WHERE text <> ''")
def scan_text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the bytes of files: most in UTF-8, some in GBK, some blank."""
    k = F.col("doc_id")
    content = F.when(k % 7 == 0, F.encode(F.lit(" \r\n"), "UTF-8")).when(k % 5 == 0, F.unhex(F.lit("C4E3BAC3CAC0BDE7"))).otherwise(F.encode("text", "UTF-8"))
    return pages_of(base(spark, d, "documents").select(F.concat(F.lit("a/file"), k.cast("string"), F.lit(".txt")).alias("path"), content.alias("content")))


def put_chunks(chunks: DataFrame, path: str, spread: int = 16) -> None:
    """Writes chunks (source, id, ...) under their sources: a source that comes again replaces its own chunks and no others.

    A large source's chunks are written by up to ``spread`` tasks."""
    dealt = chunks.repartition("source", F.pmod(F.xxhash64("id"), F.lit(spread)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def with_ids(chunks: DataFrame) -> DataFrame:
    """An id that depends on the chunk's place alone: source, page (here the document) and position."""
    return chunks.withColumn("id", F.concat("source", F.lit("_p"), F.col("doc_id").cast("string"), F.lit("_"), F.col("pos").cast("string")))


@query("write_chunks", f"SELECT source, concat(source, '_p', CAST(doc_id AS VARCHAR), '_', CAST(pos AS VARCHAR)) AS id, content FROM ({CHUNKS_SQL}) c")
def write_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks as they are read back after they were written."""
    path = stream_folder(spark, "chunks")
    put_chunks(with_ids(fixed(spark, d)), path)
    return spark.read.option("basePath", path).parquet(path).select(F.col("source").cast("string").alias("source"), "id", "content")


_PARTS = re.compile(r'"(?:[^"\\]|\\.)*"?|,(?=\s*[}\]])|[{}]', re.S)


def first_object(text: str | None) -> str | None:
    """The first whole JSON object of a text, without the fence round it and without commas before a closing bracket.

    Braces and commas in strings do not count. A text without a whole object is returned from its fence on."""
    if text is None:
        return None
    text = text.strip()
    if text.startswith("```"):
        lines = text.split("\n")
        text = "\n".join(lines[1 : -1 if len(lines) > 1 and lines[-1].strip() == "```" else None]).strip()
    out, at, depth = [], 0, 0
    for m in _PARTS.finditer(text):
        part = m.group()
        out.append(text[at : m.start()])
        at = m.end()
        if part != ",":
            out.append(part)
        if part == "{":
            depth += 1
        elif part == "}" and depth:
            depth -= 1
            if not depth:
                return "".join(out)
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def clean_json(text: pd.Series) -> pd.Series:
    return text.map(first_object)


NOISY = "concat('```json', chr(10), '{\"role\": \"', role, '\", \"note\": \"a } and \\\\\" { ,] here\", \"turns\": [', CAST(turn AS STRING), ', ], }', '以上 {\"x\": 1}', chr(10), '```')"
CLEAN = "concat('{\"role\": \"', role, '\", \"note\": \"a } and \\\\\" { ,] here\", \"turns\": [', CAST(turn AS STRING), ' ] }')"


@query("clean_json_text", f"SELECT conv_id, turn, {CLEAN} AS clean FROM conversations".replace("\\\\", "\\"))
def clean_json_text(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d, "conversations").select("conv_id", "turn", clean_json(F.expr(NOISY)).alias("clean"))


@udtf(returnType=StructType().add("pos", LongType()).add("content", StringType()))
class Chunks:
    """A table function: the chunks of one text, as ``fixed_chunks`` cuts them."""

    def eval(self, text: str):
        text = text or ""
        for k in range(max(1, -(-len(text) // 400))):
            yield k, text[400 * k : 400 * k + CHUNK].strip(" ")


@query("udtf_chunks", CHUNKS_SQL)
def udtf_chunks(spark: SparkSession, d: str) -> DataFrame:
    spark.udtf.register("chunks_of", Chunks)
    return spark.sql("SELECT doc_id, source, pos, content FROM {corpus}, LATERAL chunks_of(text)", corpus=fixture(spark, d, "corpus"))


# Short and spoken terms, and the words that reports use.
TERMS = {
    "归母净利润": "归属于母公司股东的净利润", "归母净利": "归属于母公司股东的净利润", "扣非净利润": "扣除非经常性损益的净利润", "扣非净利": "扣除非经常性损益的净利润",
    "经营现金流": "经营活动产生的现金流量净额", "投资现金流": "投资活动产生的现金流量净额", "筹资现金流": "筹资活动产生的现金流量净额",
    "ROE": "净资产收益率", "ROA": "总资产收益率", "EPS": "基本每股收益", "EBITDA": "息税折旧摊销前利润", "营收": "营业收入", "每股收益": "基本每股收益",
    "资本负债率": "资产负债率", "资产管理负债比例": "资产负债率", "纯利润": "净利润", "营收增长率": "营业收入增长率", "现金流净额": "经营活动产生的现金流量净额",
    "总营收": "营业总收入", "净利润率": "净利率", "股东净利": "归属于母公司股东的净利润", "主营业务收入": "营业收入", "负债率": "资产负债率",
    "资产负债比例": "资产负债率", "资本负债比率": "资产负债率", "资产负载率": "资产负债率", "赚了多少钱": "净利润", "挣了多少钱": "净利润", "赚钱能力": "盈利能力",
    "盈利怎么样": "盈利能力", "欠了多少钱": "总负债", "借了多少钱": "总负债", "债务多少": "总负债", "值多少钱": "净资产", "身价多少": "总市值", "规模多大": "总资产",
    "成本多少": "营业成本", "花了多少钱": "营业成本", "现金流怎么样": "经营活动产生的现金流量净额", "钱够不够": "流动比率", "增长快不快": "营业收入增长率",
    "回报高不高": "净资产收益率", "股价贵不贵": "市盈率", "分红多不多": "股利支付率",
}
#: Words that tell an industry, in the order in which they are tried.
INDUSTRIES = {
    "银行": ["招商银行", "平安银行", "银行"], "保险": ["中国平安", "保险"], "证券": ["中信证券", "证券"], "白酒": ["茅台", "五粮液", "泸州老窖", "洋河", "汾酒", "白酒", "酒"],
    "新能源": ["比亚迪", "宁德时代", "隆基", "新能源", "电池"], "家电": ["美的", "格力", "家电"], "医药": ["恒瑞", "医药", "药"], "电力": ["长江电力", "电力"],
    "半导体": ["中芯国际", "海康", "科大讯飞", "京东方", "半导体", "芯片"], "消费": ["伊利", "消费", "食品"],
}
_ALL_WORDS = [w for ws in INDUSTRIES.values() for w in ws]


def expanded(text: Column) -> Column:
    """Each known term's first place with its full words behind it: longest terms first, none within a longer one's place, and
    none whose full words the text has already. Row-local; the terms stand in the plan as literals."""
    ordered = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(TERMS[t]).alias("full")) for t in sorted(TERMS, key=len, reverse=True)))

    def step(state: Column, t: Column) -> Column:
        # A place that is taken is blanked out in ``free``; a term's place is its first in the text itself.
        size, at, there = F.length(t["term"]), F.position(t["term"], text), F.position(t["term"], state["out"])
        hit = (at > 0) & ~contains(text, t["full"]) & (F.substr(state["free"], at, size) == t["term"])
        out = F.overlay(state["out"], F.concat(t["term"], F.lit("("), t["full"], F.lit(")")), there, size)
        return F.when(hit, F.struct(out.alias("out"), F.overlay(state["free"], F.repeat(F.lit("\x01"), size), at, size).alias("free"))).otherwise(state)

    return F.aggregate(ordered, F.struct(text.alias("out"), text.alias("free")), step, lambda state: state["out"])


def industry_of(text: Column) -> Column:
    """The first industry one of whose words stands in a text; empty where none does."""
    return F.coalesce(*(F.when(text.rlike("|".join(words)), F.lit(name)) for name, words in INDUSTRIES.items()), F.lit(""))


def _pick(words: list[str], by: str) -> str:
    return f"CASE ({by}) % {len(words)} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words)) + " END"


_WORDS = [*_ALL_WORDS, "其他", "无"]
SPOKEN = f"SELECT CAST(s_suppkey AS BIGINT) AS qid, concat({_pick(list(TERMS), 's_suppkey')}, '，', {_pick(_WORDS, 's_suppkey * 7')}, '与', {_pick(list(TERMS), 's_suppkey * 5 + 3')}, {_pick(['', '净利率', '营业收入'], 's_suppkey')}) AS query FROM {{0}}"


def spoken(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SPOKEN.format("{supplier}"), supplier=base(spark, d, "supplier"))


@query("expand_terms")
def expand_terms(spark: SparkSession, d: str) -> DataFrame:
    return spoken(spark, d).select("qid", expanded(F.col("query")).alias("query"))


_INDUSTRY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(query, '{'|'.join(w)}') THEN '{k}'" for k, w in INDUSTRIES.items()) + " ELSE '' END"


@query("detect_industry", f"SELECT qid, {_INDUSTRY_SQL} AS industry FROM ({SPOKEN.format('supplier')}) q")
def detect_industry(spark: SparkSession, d: str) -> DataFrame:
    return spoken(spark, d).select("qid", industry_of(F.col("query")).alias("industry"))
