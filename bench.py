"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from lodestone.operators import textindex
from lodestone.plans.workflow import index
from lodestone.queries import QUERIES, WORDS, K, corpus
from lodestone.sources.files import Config

NAMES = ["bm25_topk", "knn_cosine_topk", "hybrid_search", "check_changes", "work_set", "chunk_documents", "sentence_counts", "hydrate_siblings", "kb_summary"]


def best(f, runs: int = 2) -> float:
    """The best of several runs; the first is cold."""
    took = []
    for _ in range(runs):
        began = time.time()
        f()
        took.append(time.time() - began)
    return round(min(took), 3)


def control(spark: SparkSession, sf: str) -> float:
    """A plain scan and count, which shows the machine's share in the other figures."""
    return best(lambda: spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").collect())


def unchanged_run(spark: SparkSession, work: str) -> float:
    """An indexing run over 12 files that are all known."""
    docs = Path(work, "docs")
    docs.mkdir()
    for k in range(12):
        (docs / f"{k}.txt").write_text(f"Document {k}. " * 200)
    config = Config(id="bench", sourcePaths=[str(docs)])
    index(spark, f"{work}/kb/store", config)
    return best(lambda: index(spark, f"{work}/kb/store", config))


def indexed_search(spark: SparkSession, sf: str, work: str) -> float:
    """bm25_topk over a persisted text index."""
    rows = textindex.indexed_rows(corpus(spark, sf, True).select("id", "content"), "id")
    textindex.laid_out(textindex.postings(rows)).write.parquet(f"{work}/postings")
    held = spark.read.schema(textindex.POSTINGS).parquet(f"{work}/postings")
    n, length = textindex.chunks_of(held).selectExpr("count(*)", "sum(dl)").first()  # a store has them in its version file
    return best(lambda: textindex.bm25_top(held, WORDS, K, None, n, length).collect())


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    controls = [control(spark, sf)]
    took = {name: best(lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()) for name in NAMES}
    work = tempfile.mkdtemp(prefix="bench-")
    try:
        took["bm25_topk_indexed"] = indexed_search(spark, sf, work)
        took["unchanged_run_12_files"] = unchanged_run(spark, work)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    controls.append(control(spark, sf))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "control": controls, "sf": sf}))


if __name__ == "__main__":
    main()
