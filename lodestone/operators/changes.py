"""Change detection, work sets and orphans: joins of a scan (source_path, file_hash) and a file index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import skippable


def changes(scan: DataFrame, files: DataFrame, known_failed: DataFrame | None = None) -> DataFrame:
    """(source_path, change): added, modified, deleted, known_failed or unchanged, by one full outer join.
    A file that failed before is known_failed only while it is not in the index."""
    s, f = scan.alias("s"), files.select("source_path", "file_hash").alias("f")
    both = s.join(f, F.col("s.source_path") == F.col("f.source_path"), "full_outer")
    path = F.coalesce("s.source_path", "f.source_path")
    kind = F.when(F.col("f.source_path").isNull(), "added").when(F.col("s.source_path").isNull(), "deleted").when(F.col("s.file_hash").eqNullSafe(F.col("f.file_hash")), "unchanged").otherwise("modified")
    out = both.select(path.alias("source_path"), kind.alias("change"))
    if known_failed is None:
        return out
    failed = known_failed.select("source_path").distinct().withColumn("_failed", F.lit(True))
    return out.join(failed, "source_path", "left").select("source_path", F.when((F.col("change") == "added") & F.col("_failed"), "known_failed").otherwise(F.col("change")).alias("change"))


def orphans(scan: DataFrame, files: DataFrame) -> DataFrame:
    return files.select("source_path").join(scan.select("source_path"), "source_path", "left_anti")


def work_set(scan: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """The scanned files that need indexing."""
    if force:
        return scan
    old = files.select("source_path", F.col("file_hash").alias("_hash"), F.col("status").alias("_status"))
    both = scan.join(old, "source_path", "left")
    return both.where(~F.coalesce(skippable(F.col("_hash"), F.col("file_hash"), F.col("_status")), F.lit(False))).select(*scan.columns)


def flags(counts: dict[str, int], stored_hash: str | None, default_hash: str, custom_prompt: bool, version: int, target: int, degraded_files: int) -> dict:
    """What the counts of changes and the stored facts say about staleness."""
    prompt = stored_hash is not None and stored_hash != default_hash and not custom_prompt
    schema = version < target
    dirty = any(counts.get(k, 0) for k in ("added", "modified", "deleted"))
    return {"is_prompt_stale": prompt, "is_schema_stale": schema, "is_contextualization_degraded": degraded_files > 0, "is_clean": not (dirty or prompt or schema)}
