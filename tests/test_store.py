"""Buckets, counters and the segments of the text index: what a commit writes, and that nothing else changes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_id, context_of
from lodestone.operators import stats, textindex
from lodestone.operators.search import bm25_topk
from lodestone.plans import store as S
from lodestone.plans.store import Store


def _chunks(spark, files, each=3, text="text"):
    rows = [(f"f{k}.txt", i, f"{text} {k} part{i} " + "word " * 3) for k in files for i in range(each)]
    return spark.createDataFrame(rows, "source_path string, chunk_index int, content string").withColumn("id", chunk_id(F.col("source_path"), F.col("chunk_index")))


def _files(spark, files):
    return spark.createDataFrame([(f"f{k}.txt", "h", k % 5, 1, 2) for k in files], "source_path string, file_hash string, status int, chunks_raw int, chunks_contextualized int")


def _made(spark, root, n, buckets=None):
    store = Store(spark, str(root))
    chunks = _chunks(spark, range(n))
    vectors = chunks.select(F.col("id").alias("chunk_id"), F.lit("m").alias("model"), F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"))
    if buckets:
        store.buckets = buckets
    store.commit(chunks=chunks, embeddings=vectors, file_index=_files(spark, range(n)))
    return store


def _bytes(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def _counted(store):
    files, chunks = store.table("file_index"), store.table("chunks")
    said = stats.file_counters(files).first().asDict() | stats.pending_counts(chunks).first().asDict() | stats.context_stats(files).first().asDict()
    return said | {"chunks": chunks.count(), "files": files.count()}


def test_a_commit_writes_the_touched_buckets_only(spark, tmp_path):
    store = _made(spark, tmp_path / "s", 400, 128)
    before, keyed = _bytes(tmp_path / "s"), {n: dict(p) for n, p in store.keyed.items()}
    assert store.table("embeddings").where("norm = 5 and source_path is not null").count() == 1200
    S.replace_files(store, _chunks(spark, [7], 1, "new"))
    written = {f: n for f, n in _bytes(tmp_path / "s").items() if f not in before}
    assert sum(written.values()) < 0.03 * sum(before.values()) and len(written) <= 2  # chunks and vectors of one bucket
    assert sum(store.keyed["chunks"][b] != f for b, f in keyed["chunks"].items()) == 1 and store.keyed["file_index"] == keyed["file_index"]
    assert store.table("chunks").count() == 1198 and store.table("chunks").where("content like 'new 7 %'").count() == 1 and store.table("embeddings").count() == 1197
    assert {k: store.count(k) for k in S.COUNTERS} == _counted(store)
    # lookups by id read one bucket, unless chunks have ids of their own
    id = store.table("chunks").where("source_path = 'f9.txt' and chunk_index = 1").first().id
    assert len(store.near([id]).inputFiles()) == 1 and store.near([id]).where(F.col("id") == id).count() == 1
    S.replace_files(store, _chunks(spark, [8], 1).withColumn("id", F.lit("own")))
    assert store.count("odd_ids") == 1 and len(store.near([id]).inputFiles()) > 100
    # a writer that comes late goes back to its version
    late = Store(spark, store.root)
    S.delete_paths(store, _files(spark, [1, 2, 3]))
    with pytest.raises(RuntimeError):
        S.delete_paths(late, _files(spark, [4]))
    late.refresh()
    assert late.keyed == store.keyed and late.count("files") == 397 and _counted(late) == {k: late.count(k) for k in S.COUNTERS}


def test_buckets_double_as_the_store_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "CHUNKS_A_BUCKET", 8)
    store = _made(spark, tmp_path / "s", 100)
    assert store.buckets == 64 and store.table("chunks").count() == 300 == store.table("embeddings").where("source_path is not null").count()
    assert {k: store.count(k) for k in S.COUNTERS} == _counted(store)
    version = store.version
    assert store.spread(100) == version  # never fewer
    S.delete_paths(store, store.table("file_index").select("source_path"))
    assert store.keyed == {n: {} for n in S.KEYED} and store.count("chunks") == 0 and store.table("chunks").count() == 0 and store.last_indexed is None


def test_a_store_from_before_there_were_buckets(spark, tmp_path):
    root = tmp_path / "s"
    old = _chunks(spark, range(9))
    old.select("id", "source_path", "chunk_index", "content").write.parquet(f"{root}/v1-a/chunks")
    old.select(F.col("id").alias("chunk_id"), F.lit("m").alias("model"), F.array(F.lit(1.0).cast("float")).alias("embedding")).write.parquet(f"{root}/v1-a/embeddings")
    _files(spark, range(9)).write.parquet(f"{root}/v1-a/file_index")
    (root / "versions").mkdir()
    (root / "versions" / "v1.json").write_text(json.dumps({"version": 1, "tables": {n: f"v1-a/{n}" for n in S.KEYED}}))
    store = Store(spark, str(root))
    assert store.table("chunks").count() == 27 and not store.counted
    S.delete_paths(store, _files(spark, [1, 2]))
    again = Store(spark, str(root))
    assert again.counted and not again.places and {n: again.table(n).count() for n in S.KEYED} == {"chunks": 21, "embeddings": 21, "file_index": 7}
    assert again.table("chunks").where("enriched is null or status is null").count() == 0 and _counted(again) == {k: again.count(k) for k in S.COUNTERS}


def test_index_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BATCH_CHUNKS", 16)
    store = _made(spark, tmp_path / "s", 120, 32)

    def searched(query):
        rows, dead, n, length = textindex.of_index(spark, store.root, store.index)
        found = [(x.chunk_id, round(x.score, 9)) for x in textindex.bm25_top(rows, query, 40, dead, n, length).collect()]
        texts = store.table("chunks").select(F.col("id").alias("chunk_id"), "content")
        assert found == [(x.chunk_id, round(x.score, 9)) for x in bm25_topk(texts, query, 40).collect()]
        return len(found)

    S.refresh_index(store)
    first = store.index["segments"][0]["folder"]
    assert S.index_is_current(store) and searched("part1 word") == 40
    S.replace_files(store, _chunks(spark, [5], 2, "zebra"))
    assert not S.index_is_current(store)
    before = _bytes(tmp_path / "s")
    S.refresh_index(store)
    written = sum(n for f, n in _bytes(tmp_path / "s").items() if f not in before and "dead" not in f)
    assert written < 0.5 * sum(n for f, n in before.items() if "/index/" in f)  # mostly footers, in a store this small
    assert [(s["folder"] == first, s["n"], s["dead"]) for s in store.index["segments"]] == [(True, 360, 3), (False, 2, 0)]
    assert searched("zebra") == 2 and searched("part2 zebra") == 40
    # the small segment is made anew with the next change, the large one stays; what goes is dead
    S.replace_files(store, _chunks(spark, [6], 3, "zebra"))
    S.delete_paths(store, _files(spark, [7]))
    S.refresh_index(store)
    assert [(s["n"], s["dead"]) for s in store.index["segments"]] == [(360, 9), (5, 0)] and searched("zebra 119") == 8
    # over a quarter of the large one is dead: one segment is left
    S.delete_paths(store, _files(spark, range(10, 70)))
    S.refresh_index(store)
    assert [(s["n"], s["dead"]) for s in store.index["segments"]] == [(store.count("chunks"), 0)] and store.index["dead"] is None
    assert searched("zebra part1") == 40
    S.delete_paths(store, store.table("file_index").select("source_path"))
    S.refresh_index(store)
    assert store.index["segments"] == [] and searched("zebra") == 0


def test_vacuum_keeps_what_is_named_or_leased(spark, tmp_path):
    store = _made(spark, tmp_path / "s", 40, 16)
    S.refresh_index(store)
    reader, late = Store(spark, store.root, read_only=True), Store(spark, store.root, read_only=True)
    lease = reader.lease(60, now=1000.0)
    for k in range(3):
        S.replace_files(store, _chunks(spark, [k], 1, "new"))
    S.refresh_index(store)
    unfinished = tmp_path / "s" / f"v{store.version + 1}-00000000" / "chunks"  # a writer is at it
    unfinished.mkdir(parents=True)
    full = _bytes(tmp_path / "s")
    assert store.vacuum(1, now=1010.0) > 0 and late.version == reader.version
    assert reader.table("chunks").count() == 120 and store.table("chunks").where("content like 'new%'").count() == 3  # the leased version is whole
    assert textindex.of_index(spark, store.root, reader.index)[0].count() > 0 and unfinished.exists()
    assert store.vacuum(1, now=2000.0) > 0 and not (tmp_path / "s" / lease).exists()
    assert os.listdir(tmp_path / "s" / "versions") in ([f"v{store.version}.json"], [f".v{store.version}.json.crc", f"v{store.version}.json"], [f"v{store.version}.json", f".v{store.version}.json.crc"])
    assert len(_bytes(tmp_path / "s")) < len(full) and Store(spark, store.root).table("chunks").count() == 114 and Store(spark, store.root).table("embeddings").count() == 111
    S.refresh_index(store)
    assert store.vacuum(1, now=2000.0) >= 0 and S.index_is_current(store)


def test_context_of_chunks_equals_that_of_texts(spark):
    r = random.Random(4)
    rows = [(f"p{p}", i, "x" * r.randint(0, 9) + f"{p}-{i} " * r.randint(0, size)) for p, (n, size) in enumerate([(1, 0), (1, 2000), (3, 10), (2500, 0), (900, 3), (30, 90), (60, 200), (5000, 1)]) for i in range(n)] + [("none", 0, None), ("empty", 0, "")]
    df = spark.createDataFrame(rows, "source_path string, chunk_index int, content string")
    want = {x.source_path: x.context for x in stats.document_text(df.where("content is not null")).select("source_path", context_of(F.col("text")).alias("context")).collect()}
    got = stats.document_context(df)
    assert {x.source_path: x.context for x in got.collect()} == want and len(want) == 9
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()  # no more rows than that of a document move


def test_counters_follow_every_transition(spark, tmp_path):
    store = _made(spark, tmp_path / "s", 12)
    ids = store.table("chunks").select("id", "source_path")

    def same():
        files, chunks = store.table("file_index"), store.table("chunks")
        said = files.selectExpr("count(*)", *[f"count_if(status = {k})" for k in range(5)], "sum(chunks_raw)", "count_if(chunks_raw > 0)").first()
        names = ("files", "ready", "degraded", "partially_deferred", "needs_action", "failed", "chunks_raw", "degraded_files")
        assert tuple(said) == tuple(store.count(n) for n in names)
        assert tuple(chunks.selectExpr("count(*)", "count_if(status = 2)", "count_if(status = 5)").first()) == tuple(store.count(n) for n in ("chunks", "pending_embedding", "pending_contextualization"))

    S.update_chunks(store, ids.where("source_path < 'f3'"), 2, "late")
    same()
    S.prepare_partial(store, "contextualization")
    same()
    S.contextualized(store, store.table("chunks").where("source_path = 'f5.txt'").withColumn("status", F.lit(2)))
    same()
    S.promote(store, ids.where("source_path = 'f5.txt'").select(F.col("id").alias("chunk_id"), F.lit("m").alias("model"), F.array(F.lit(1.0).cast("float")).alias("embedding"), "source_path"))
    same()
    S.mark_files_failed(store, spark.createDataFrame([("f6.txt", "e"), ("none", "e")], "source_path string, error string"), "extract")
    S.persist_pending(store, _chunks(spark, [30], 2), spark.createDataFrame([("f30.txt", "h")], "source_path string, file_hash string"))
    same()
    assert store.last_indexed is not None
    S.settle(store)
    same()
    assert store.count("pending_embedding") == 0 and Store(spark, store.root).counters == store.counters
