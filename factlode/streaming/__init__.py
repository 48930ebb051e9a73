"""Structured Streaming: statistics, usage and limits over requests as they come."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's state and output, where driver and executors share one (``spark.checkpoint.dir``).

    Only a session on one machine may do without such a setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="factlode-stream-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
