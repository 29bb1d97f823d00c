"""Incremental ingestion: a file stream of (source_path, text) rows becomes chunks in a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunker import chunked
from ..functions.text import chunk_id


def chunk_stream(docs: DataFrame, **options: int) -> DataFrame:
    rows = chunked(docs.select("source_path", "text"), **options)
    return rows.select(chunk_id(F.col("source_path"), F.col("chunk_index")).alias("id"), "source_path", "chunk_index", "content", "char_offset")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, **options: int) -> None:
    """Process what has arrived since the last call, exactly once, and return."""
    docs = spark.readStream.schema("source_path string, text string").parquet(source)
    query = chunk_stream(docs, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
