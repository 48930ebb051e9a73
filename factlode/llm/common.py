"""Tables in and out: reading inputs, and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir`` was given.

    Only a session on one machine may do without: it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="factlode-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files
    that survive lost executors, and nothing before them is computed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*saved: DataFrame) -> None:
    """Delete what ``save`` wrote, once nothing that is still to run reads it."""
    for df in saved:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What empties the caches that modules keep in the process of a Python worker, from task to task.
CACHES: list[Callable[[], None]] = []


def let_go() -> None:
    """Empty these caches. Spark hands a worker's process on to the next stage and query, beside whose
    own memory they would lie idle; called by the tasks of the first passes of the pipeline's first two stages."""
    for empty in CACHES:
        empty()


#: Bytes of an Arrow batch: rows alone bound nothing where texts are long.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Python workers get a few MB at a time, unless the session says otherwise."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that the operators use, so extra columns never clash."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def digest(col: Column) -> Column:
    """A short key of a text (null: empty) that tells rows with the same doc_id apart."""
    return F.unhex(F.md5(F.coalesce(col, F.lit(""))))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
