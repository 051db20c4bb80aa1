"""The folder that the driver and all executors share, for what is written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one on a single machine and an error on a cluster, whose machines share no such folder."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if base is None:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lexiline-")
    return f"{base.rstrip('/')}/lexiline-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new shared folder and read from there, for what several parts of a plan take."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
