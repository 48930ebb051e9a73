"""From raw documents to token counts: five stages, each over all that the one before kept.

1. quality: documents that the quality rules reject go;
2. near_duplicates: one document of each group of near copies stays;
3. decontaminate: documents that hold a benchmark item go;
4. personal_data: spans of personal data are replaced in the texts;
5. encode: the texts are encoded and decoded; token counts and digests come out.

Each stage's result is written to the shared folder as Parquet and read again, so a stage
starts from files and a lost executor costs no earlier work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlode.llm import bpe, decontaminate, neardup, pii, quality
from factlode.llm.common import save

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", neardup.stage),
    ("decontaminate", decontaminate.stage),
    ("personal_data", pii.stage),
    ("encode", bpe.stage),
]

#: SQL cannot express the hashed likelihood ratio, the trees or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

