"""Counters over chunks and files: one aggregate each, with partial sums before any exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONTEXT_PART, LARGE_CONTEXT, WHOLE_CONTEXT, context_from


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"))


def chunk_by_id(chunks: DataFrame, id: str) -> DataFrame:
    """The chunk of that id, or no row; the filter reaches the scan."""
    return chunks.where(F.col("id") == id)


def indexed_paths(files: DataFrame) -> DataFrame:
    return files.select("source_path")


def file_counters(files: DataFrame) -> DataFrame:
    names = {"ready": 0, "degraded": 1, "partially_deferred": 2, "needs_action": 3, "failed": 4}
    return files.agg(*[F.count_if(F.col("status") == v).alias(k) for k, v in names.items()])


def status_count(rows: DataFrame, status: int) -> DataFrame:
    return rows.where(F.col("status") == status).agg(F.count("*").alias("n"))


def pending_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_if(F.col("status") == 2).alias("pending_embedding"), F.count_if(F.col("status") == 5).alias("pending_contextualization"))


def context_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("chunks_raw"), F.lit(0)).alias("chunks_raw"), F.coalesce(F.sum("chunks_contextualized"), F.lit(0)).alias("chunks_contextualized"), F.count_if(F.col("chunks_raw") > 0).alias("degraded_files"))


def last_indexed(files: DataFrame) -> DataFrame:
    return files.agg(F.max("indexed_at").alias("last_indexed_at"))


def pending_by_file(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("status").isin(2, 5)).groupBy("source_path").agg(F.count("*").alias("pending"), F.max("retry_count").alias("retries"))


def context_by_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_path").agg(F.count_if(~F.col("is_contextualized")).alias("chunks_raw"), F.count_if(F.col("is_contextualized")).alias("chunks_contextualized"))


def kb_summary(bases: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each knowledge base, also for those without chunks or files."""
    c = chunks.groupBy("kb_id").agg(F.count("*").alias("chunks"))
    f = files.groupBy("kb_id").agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed_at"), F.count_if(F.col("chunks_raw") > 0).alias("degraded_files"))
    return bases.join(c, "kb_id", "left").join(f, "kb_id", "left").fillna(0, ["chunks", "files", "degraded_files"])


def pending_embeddings(chunks: DataFrame, limit: int) -> DataFrame:
    return chunks.where(F.col("status") == 2).orderBy("retry_count", "source_path", "chunk_index").limit(limit)


def pending_contexts(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("status") == 5).orderBy("source_path", "chunk_index")


def document_text(chunks: DataFrame, key: str = "source_path") -> DataFrame:
    """Texts put together again from their chunks in order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x.content), "\n\n").alias("text"))


def document_context(chunks: DataFrame, key: str = "source_path") -> DataFrame:
    """(key, context) as context_of(document_text) gives, without gathering a long document. Its length is a sum; as
    two characters stand between chunks, so many first chunks hold the head, and so many last ones the tail."""
    own = chunks.where(F.col("content").isNotNull()).select(key, "chunk_index", "content")
    sizes = own.groupBy(key).agg((F.sum(F.length("content")) + 2 * (F.count("*") - 1)).alias("n"))
    n, between = F.col("n"), F.lit("\n\n")
    of = lambda which: own.join(sizes.where(which).select(key), key, "left_semi")
    least = lambda rows, *order: rows.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_p") <= CONTEXT_PART // 2)
    head = document_text(least(of(n > WHOLE_CONTEXT), "chunk_index", "content"), key).select(key, F.concat("text", between).alias("head"))
    tail = document_text(least(of((n > WHOLE_CONTEXT) & (n <= LARGE_CONTEXT)), F.desc("chunk_index"), F.desc("content")), key).select(key, F.concat(between, "text").alias("tail"))
    head = head.unionByName(document_text(of(n <= WHOLE_CONTEXT), key).withColumnRenamed("text", "head"))
    return sizes.join(head, key).join(tail, key, "left").select(key, context_from(n, F.col("head"), F.col("tail")).alias("context"))
