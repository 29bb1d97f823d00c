"""Tables in Parquet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores before heavy work on each, if a small table comes in fewer files than there
    are cores (one file of one row group is one task). A large table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share, below spark.checkpoint.dir. Where that is unset and Spark
    runs in one process (tests), below a temporary folder; on a cluster RuntimeError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="lodestone-")
    return f"{base}/{name}-{uuid.uuid4().hex}"
