import json
import uuid

from lodestone.plans import queue
from lodestone.plans.api import KnowledgeBases
from lodestone.plans.providers import AuthError, HashingEmbedder, embed_isolating
from lodestone.plans.store import Store
from lodestone.plans.workflow import index, partial
from lodestone.sources.files import Config, read_config, write_config
from lodestone.streaming.ingest import ingest


class Picky:
    model = "m"

    def __init__(self, bad, error=ValueError):
        self.bad, self.error = bad, error

    def embed(self, texts):
        if any(self.bad(t) for t in texts):
            raise self.error("no")
        return [[1.0] for _ in texts]


def test_binary_split():
    ids = [str(i) for i in range(9)]
    one = embed_isolating(ids, ids, Picky(lambda t: t == "4"), 9)
    assert set(one.failed) == {"4"} and len(one.vectors) == 8 and not one.deferred
    assert embed_isolating(ids, ids, Picky(lambda t: True), 9).deferred
    single = embed_isolating(["a"], ["a"], Picky(lambda t: True), 9)
    assert set(single.failed) == {"a"} and not single.deferred
    try:
        embed_isolating(ids, ids, Picky(lambda t: True, AuthError), 9)
        raise AssertionError
    except AuthError:
        pass


def test_index_search_change_and_reindex(spark, tmp_path):
    docs, base, kb = tmp_path / "docs", tmp_path / "base", str(uuid.uuid4())
    (docs / "sub").mkdir(parents=True)
    (base / kb).mkdir(parents=True)
    (docs / "a.txt").write_text("Lithium battery capacity fades. " * 60)
    (docs / "sub" / "b.md").write_text("Weather in Seoul is mild.")
    (docs / "c.pdf").write_text("ignored")
    (docs / "blank.txt").write_text("  \n ")
    write_config(base / kb / "config.json", Config(id=kb, name="test", sourcePaths=[str(docs), str(tmp_path / "missing")]))
    assert read_config(base / kb / "config.json").name == "test"
    config, root = Config(id=kb, sourcePaths=[str(docs)]), str(base / kb / "store")
    write_config(base / kb / "config.json", config)
    first = index(spark, root, config, HashingEmbedder())
    assert first.indexed == 2 and first.exit_code == 0
    store = Store(spark, root)
    assert {r.status for r in store.table("chunks").select("status").distinct().collect()} == {0}
    assert store.table("embeddings").count() == store.table("chunks").count() > 2
    again = index(spark, root, config, HashingEmbedder())
    assert again.indexed == 0 and again.skipped == 2
    bases = KnowledgeBases(spark, str(base), HashingEmbedder())
    assert [b["kb_id"] for b in bases.list_knowledge_bases()] == [kb]
    hit = bases.search_documents(kb, "battery capacity", top_k=2)
    assert hit["search_mode"] == "hybrid" and hit["results"][0]["source_path"] == "a.txt"
    one = bases.get_document_chunk(kb, hit["results"][0]["chunk_id"])
    assert "battery" in one["content"] and one["total_chunks"] > 1
    assert "error" in bases.get_document_chunk(kb, "x") and "error" in bases.search_documents("nope", "x")
    (docs / "a.txt").write_text("Changed now.")
    (docs / "sub" / "b.md").unlink()
    (docs / "d.txt").write_text("New file.")
    found = bases.check_changes(kb)
    assert found["modified"] == ["a.txt"] and found["deleted"] == ["sub/b.md"] and "d.txt" in found["added"] and not found["is_clean"]
    index(spark, root, config, HashingEmbedder())
    assert {r.source_path for r in Store(spark, root).table("file_index").collect()} == {"a.txt", "d.txt"}
    assert partial(spark, root, config, "contextualization", HashingEmbedder()) == 0
    assert Store(spark, root).table("embeddings").count() == 2
    assert bases.get_index_info(kb)["status"] == "ready"
    assert bases.start_reindex(kb, "embedding")["status"] == "queued" and bases.start_reindex(kb)["status"] == "upgraded"
    assert bases.get_index_info(kb)["queue"]["position"] == 1
    assert queue.drain(str(base), lambda e: 0) == 1 and bases.cancel_reindex(kb)["reason"] == "not_found"


def test_queue_rules():
    entries = []
    assert queue.merge(entries, "k", "embedding", deferred=True) == "queued"
    assert queue.merge(entries, "k", "embedding") == "already_queued" and entries[0]["deferred"] is False
    entries[0]["started_at"] = "t"
    assert queue.merge(entries, "k", "embedding") == "already_running"
    assert queue.merge(entries, "k") == "queued_after_current" and len(entries) == 2
    assert queue.recover(entries) == 1 and entries[0]["last_error"] == queue.DIED
    assert queue.merge(entries, "k") == "queued"
    assert queue.cancel(None, "k")["reason"] == "no_queue" and json.dumps(queue.cancel(entries, "k"))


def test_streaming_ingest_is_incremental(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("a", "First text.")], "source_path string, text string").write.mode("append").parquet(source)
    ingest(spark, source, target, state)
    spark.createDataFrame([("b", "Second text.")], "source_path string, text string").write.mode("append").parquet(source)
    ingest(spark, source, target, state)
    assert sorted(r.source_path for r in spark.read.parquet(target).collect()) == ["a", "b"]
