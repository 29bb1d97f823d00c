"""Table layouts, status codes and additive migration."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
LAYOUT = 2  # of the files of a store


class ChunkStatus(IntEnum):
    INDEXED = 0
    INDEXED_RAW = 1
    PENDING_EMBEDDING = 2
    PENDING_EXTRACTION = 3
    FAILED = 4
    PENDING_CONTEXT = 5


class FileStatus(IntEnum):
    READY = 0
    DEGRADED = 1
    PARTIALLY_DEFERRED = 2
    NEEDS_ACTION = 3
    FAILED = 4


class ProviderHealth(IntEnum):
    OK = 0
    EMBEDDING_UNAVAILABLE = 1
    CONTEXT_UNAVAILABLE = 2


class SearchMode:
    HYBRID, VECTOR, BM25 = "hybrid", "vector_only", "bm25_only"


class FolderClass:
    LIVE, ORPHAN, PROTECTED = "LiveKb", "Orphan", "Protected"


CHUNKS = "id string, source_path string, chunk_index int, content string, enriched string, char_offset int, metadata string, status int, is_contextualized boolean, last_error string, retry_count int"
EMBEDDINGS = "chunk_id string, model string, embedding array<float>, norm double, source_path string"
FILES = "source_path string, file_hash string, indexed_at timestamp, status int, chunks_raw int, chunks_contextualized int, chunks_pending int, last_error string, last_error_stage string, size bigint, modified timestamp"
METADATA = "key string, value string"
SCAN = "source_path string, file_hash string"
FAILURES = "source_path string, error string"
TABLES = {"failures": FAILURES, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "file_index": FILES, "index_metadata": METADATA}

#: What a column that an older table lacks is filled with, as SQL over the older table.
_DEFAULTS = {"enriched": "content", "metadata": "'{}'", "status": "0", "is_contextualized": "true", "retry_count": "0", "char_offset": "0", "chunks_raw": "0", "chunks_contextualized": "0", "chunks_pending": "0", "norm": "sqrt(aggregate(embedding, 0d, (s, x) -> s + cast(x as double) * cast(x as double)))"}


def migrate(df: DataFrame, name: str) -> DataFrame:
    """df with all columns of the current layout in order; doing it again changes nothing."""
    out = []
    for field in TABLES[name].split(", "):
        column, kind = field.split(" ", 1)
        if column in df.columns:
            c = F.col(column)
            if column == "enriched":
                c = F.coalesce(c, F.col("content"))
            elif column == "norm":
                c = F.coalesce(c, F.expr(_DEFAULTS["norm"]))
        else:
            c = F.expr(_DEFAULTS.get(column, "null"))
        out.append(c.cast(kind).alias(column))
    return df.select(*out)
