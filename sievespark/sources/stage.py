"""Tables between the steps of a job, written where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a `local` session may go without it, as tests do."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_stage_folder", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark._stage_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return root.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: its lineage ends here, and a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
