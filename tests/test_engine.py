"""Engine states that a run goes through, each with its own small knowledge base."""

import io
import json
import os
import random
import re
import sys
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark import cloudpickle

from lodestone.__main__ import main, run_one
from lodestone.functions.chunker import BOUNDARY, chunks, sentences
from lodestone.operators import textindex
from lodestone.operators.search import bm25_scores, hydrate, rrf, top
from lodestone.plans import clients, providers, queue, serve
from lodestone.plans.api import KnowledgeBases
from lodestone.plans.keys import Keys
from lodestone.plans.lock import IndexLock
from lodestone.plans.providers import AuthError, HashingEmbedder, KeywordContextualizer, asked_of, by_file, embed_windows
from lodestone.plans.store import Store, index_is_current, migrate, replace_files
from lodestone.plans.workflow import RETRIES, index, partial_run, prompt_hash
from lodestone.sources import files
from lodestone.sources.files import Config, Provider, read_config, write_config

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no tests on their path


class Base:
    def __init__(self, spark, path, **config):
        self.spark, self.base, self.kb = spark, path / "base", str(uuid.uuid4())
        self.docs, self.folder = path / "docs", self.base / self.kb
        self.docs.mkdir()
        self.folder.mkdir(parents=True)
        self.config = Config(id=self.kb, name="n", sourcePaths=[str(self.docs)], **config)
        write_config(self.folder / "config.json", self.config)
        self.root = str(self.folder / "store")

    def put(self, name, text):
        (self.docs / name).write_text(text)

    def rows(self, table):
        return Store(self.spark, self.root).table(table).collect()

    def facts(self):
        return {r.key: r.value for r in self.rows("index_metadata")}


@pytest.fixture
def kb(spark, tmp_path):
    return Base(spark, tmp_path)


class Refusing(HashingEmbedder):
    def embed(self, texts):
        raise AuthError("401")


class Down(HashingEmbedder):
    def embed(self, texts):
        if len(texts) > 1:
            raise ValueError("down")
        raise ValueError("down too")


def test_chunks_equal_a_plain_version():
    """Index by index, without generators or a shared packing loop."""

    def inside(text, at):
        depth = 0
        for c in text[:at]:
            depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        return depth > 0

    def split(text):
        out, begin = [], 0
        for m in BOUNDARY.finditer(text):
            if text[begin : m.start()].strip() and not inside(text, m.start()):
                out.append((text[begin : m.start()].strip(), begin))
                begin = m.end()
        if text[begin:].strip():
            out.append((text[begin:].strip(), begin))
        return out

    def limited(text, offset, most):
        if len(text) <= most:
            return [(text.strip(), offset)] if text.strip() else []
        parts = split(text)
        if len(parts) == 1:
            return [(text[a : a + most].strip(), offset + a) for a in range(0, len(text), most) if text[a : a + most].strip()]
        out, cur, at = [], "", 0
        for s, o in parts:
            if cur and len(cur) + len(s) + 1 > most:
                out += limited(cur, offset + at, most)
                cur = ""
            at = at if cur else o
            cur = cur + " " + s if cur else s
        return out + limited(cur, offset + at, most)

    def plain(text, size, overlap, most):
        out, cur, at = [], "", 0
        for s, o in split(text):
            if not cur:
                cur, at = s, o
            elif len(cur) + len(s) + 1 <= size:
                cur += " " + s
            else:
                out.append((cur.strip(), at))
                if overlap > 0 and len(cur) > overlap:
                    end = cur[len(cur) - overlap :]
                    end = end[end.index(" ") + 1 :] if " " in end else end
                    cur, at = end + " " + s, o - len(end)
                else:
                    cur, at = s, o
        if cur.strip():
            if out and len(cur.strip()) < int(size * 0.3):
                out[-1] = (out[-1][0] + " " + cur.strip(), out[-1][1])
            else:
                out.append((cur.strip(), at))
        return [x for c, o in out for x in ([(c, o)] if len(c) <= most else limited(c, o, most))]

    r = random.Random(3)
    words = ["Alpha", "beta", "3.14", "(see", "note.)", "Gamma)", "합니다.", "했어요.", "한국", "一二。", "三。四", "x" * 130, "\n\n", "　", "end.", "End.", "(a", "b)", "1."]
    for _ in range(600):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 120)))
        size, overlap, most = r.choice([(60, 15, 90), (100, 0, 120), (200, 50, 4000), (1000, 150, 4000)])
        assert sentences(text) == split(text)
        assert chunks(text, size, overlap, most) == plain(text, size, overlap, most)


def test_word_index_equals_the_scan(spark, monkeypatch):
    monkeypatch.setattr(textindex, "BATCH_CHUNKS", 7)
    r = random.Random(1)
    rows = [(f"c{k:02d}", "".join(r.choice("abAB é") for _ in range(r.randint(0, 60)))) for k in range(80)] + [("none", None), ("aab", "x"), ("aab x", "\x85y\u3000abab")]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    held = textindex.laid_out(textindex.postings(textindex.indexed_rows(df))).persist()
    for query in ("aaa", "abab aab bbb", "AB a é", "zzz"):
        for whole in (200_000, 0):
            monkeypatch.setattr(textindex, "READ_WHOLE", whole)
            want = {x.chunk_id: round(x.score, 9) for x in bm25_scores(df, query).collect()}
            assert {x.chunk_id: round(x.score, 9) for x in textindex.named(textindex.bm25_indexed(held, query), held).collect()} == want
    best = [(x.chunk_id, round(x.score, 9), x.rank) for x in top(bm25_scores(df, "abab aab"), 5).collect()]
    for held_here, ties, words in ((1, 1, 2), (1, 1000, 2000), (20_000, 1, 9), (20_000, 1000, 9)):  # by Spark or not; more ties are looked up, more words are joined
        monkeypatch.setattr(textindex, "HELD", held_here)
        monkeypatch.setattr(textindex, "TIES", ties)
        monkeypatch.setattr(textindex, "NAMED_WORDS", words)
        assert [(x.chunk_id, round(x.score, 9), x.rank) for x in textindex.bm25_top(held, "abab aab", 5).collect()] == best
    assert textindex.bm25_top(held, "aaa", 0).count() == 0 == textindex.bm25_top(held.limit(0), "aaa", 3).count() == textindex.bm25_top(held, "ab", 3).count()
    held.unpersist()


def test_fusion_of_nothing(spark):
    assert rrf([], 5).collect() == [] and rrf([], 5).columns == ["chunk_id", "score", "rank"]


def test_joins_of_all_ids_are_not_forced_to_broadcast(spark):
    chunks = spark.createDataFrame([("a", "p", 0, "x")], "id string, source_path string, chunk_index int, content string")
    ranked = spark.createDataFrame([("a", 1.0, 0)], "chunk_id string, score double, rank int")
    plan = hydrate(ranked, chunks)._jdf.queryExecution().logical().toString()
    assert "UnresolvedHint" not in plan and "broadcast" not in plan


def test_commit_is_decided_by_creating_a_file(spark, tmp_path):
    root = str(tmp_path / "s")
    one, two = Store(spark, root), Store(spark, root)
    rows = spark.createDataFrame([("k", "1")], "key string, value string")
    assert one.commit(index_metadata=rows) == 1
    with pytest.raises(RuntimeError):
        two.commit(index_metadata=rows)
    reader = Store(spark, root, read_only=True)
    assert one.commit(index_metadata=rows.limit(0)) == 2
    assert reader.version == 1 and reader.table("index_metadata").count() == 1  # a reader stays where it is
    (tmp_path / "s" / "versions" / "v3.json").write_text("")  # a writer died here
    late = Store(spark, root)
    assert late.version == 2 and late.commit(index_metadata=rows) == 4 and Store(spark, root).version == 4
    with pytest.raises(PermissionError):
        Store(spark, root, read_only=True).commit(index_metadata=rows)


def test_lock_excludes_and_tells(kb):
    kb.put("a.txt", "Some text.")
    lock = IndexLock(kb.folder)
    assert lock.acquire() and not IndexLock(kb.folder).acquire()
    lock.update(3, 9, current_stage="embed", failed_count=1)
    lock.update(4, 9, provider_health=0)
    assert lock.info()["current_stage"] == "embed" and lock.info()["current"] == 4 and lock.info()["failed_count"] == 1
    bases = KnowledgeBases(kb.spark, str(kb.base))
    busy = index(kb.spark, kb.root, kb.config)
    assert busy.busy and busy.exit_code == 1 and bases.get_index_info(kb.kb)["indexing_progress"]["total"] == 9
    lock.release()
    (kb.folder / "lock.json").write_text(json.dumps({"pid": 2**22 + 5}))  # left by a process that is gone
    assert bases.get_index_info(kb.kb)["status"] == "ready" and index(kb.spark, kb.root, kb.config).indexed == 1
    assert not (kb.folder / "lock.json").exists() and not os.listdir(f"{kb.root}/scratch")
    assert "run" in (kb.folder / "timing.log").read_text()


def test_null_providers_index_ready_files_and_search(kb):
    kb.put("a.txt", "A text about batteries.")
    assert index(kb.spark, kb.root, kb.config).indexed == 1
    assert [(r.status, r.chunks_raw, r.chunks_contextualized, r.chunks_pending) for r in kb.rows("file_index")] == [(0, 0, 1, 0)]
    assert index_is_current(Store(kb.spark, kb.root))
    hit = KnowledgeBases(kb.spark, str(kb.base)).search_documents(kb.kb, "batteries")
    assert hit["search_mode"] == "bm25_only" and len(hit["results"]) == 1 and hit["total_chunks_searched"] == 1
    version = Store(kb.spark, kb.root).version
    again = index(kb.spark, kb.root, kb.config)
    assert again.skipped == 1 and Store(kb.spark, kb.root).version == version + 1  # metadata only
    kb.put("b.txt", "Batteries again, other words.")
    index(kb.spark, kb.root, kb.config)
    assert len(KnowledgeBases(kb.spark, str(kb.base)).search_documents(kb.kb, "batteries")["results"]) == 2
    (kb.docs / "a.txt").unlink()
    index(kb.spark, kb.root, kb.config)
    store = Store(kb.spark, kb.root)
    rows, dead, n, _ = textindex.of_index(kb.spark, kb.root, store.index)
    live = textindex.chunks_of(rows) if dead is None else textindex.chunks_of(rows).join(dead, ["batch", "place"], "left_anti")
    assert [r.chunk_id for r in live.collect()] == [r.id for r in kb.rows("chunks")] and n == 1


def test_only_files_of_another_size_or_time_are_opened(kb):
    kb.put("a.txt", "One text.")
    kb.put("b.txt", "Another text.")
    index(kb.spark, kb.root, kb.config)
    stat = os.stat(kb.docs / "a.txt")
    kb.put("a.txt", "Two text.")
    os.utime(kb.docs / "a.txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    version = Store(kb.spark, kb.root).version
    assert index(kb.spark, kb.root, kb.config).skipped == 2 and Store(kb.spark, kb.root).version == version + 1  # opened, it would be seen
    kb.put("b.txt", "Other words.")
    bases = KnowledgeBases(kb.spark, str(kb.base))
    assert bases.check_changes(kb.kb)["modified"] == ["b.txt"]
    run = index(kb.spark, kb.root, kb.config)
    assert (run.indexed, run.skipped) == (1, 1) and {r.content for r in kb.rows("chunks")} == {"One text.", "Other words."}
    assert index(kb.spark, kb.root, kb.config, force=True).indexed == 2 and {r.content for r in kb.rows("chunks")} == {"Two text.", "Other words."}


def test_names_are_paths_and_not_patterns(kb):
    for name in ("a [1].txt", "b{2}.txt", "c*.md", "d e.txt", "f%20g.txt"):
        kb.put(name, f"Text of {name}.")
    assert index(kb.spark, kb.root, kb.config).indexed == 5
    assert {r.source_path for r in kb.rows("file_index")} == {"a [1].txt", "b{2}.txt", "c*.md", "d e.txt", "f%20g.txt"}


def test_files_that_cannot_be_read_need_action(kb):
    def fails(raw):
        if b"bad" in raw:
            raise ValueError("broken")
        return raw.decode(), {"audio.model_size": "base"}

    files.register(".odd", fails)
    try:
        kb.put("x.odd", "good words")
        kb.put("new.odd", "bad from the start")
        first = index(kb.spark, kb.root, kb.config)
        assert first.indexed == 1 and first.failed == {"new.odd": "ValueError: broken"} and first.exit_code == 0
        assert json.loads(kb.rows("chunks")[0].metadata) == {"audio.model_size": "base"}
        kb.put("x.odd", "bad now")
        index(kb.spark, kb.root, kb.config)
        row = kb.rows("file_index")[0]
        assert (row.status, row.last_error_stage) == (3, "extract") and [r.content for r in kb.rows("chunks")] == ["good words"]
        found = KnowledgeBases(kb.spark, str(kb.base)).check_changes(kb.kb)
        assert found["known_failed"] == ["new.odd"] and found["modified"] == ["x.odd"] and found["modified_count"] == 1
        assert kb.facts()["last_failed_count"] == "0" and json.loads(kb.facts()["last_failed_reasons"]) == ["ValueError: broken"] * 2
    finally:
        files.PARSERS.pop(".odd")


def test_pages_are_parsed(kb):
    kb.put("p.html", "<html><head><title>T</title><script>x()</script></head><body><p>One &amp; <b>two</b></p><div>Three</div></body></html>")
    index(kb.spark, kb.root, kb.config)
    assert [r.content for r in kb.rows("chunks")] == ["T\nOne & two\nThree"]


def test_a_refused_key_defers_without_costing_tries(kb):
    kb.put("a.txt", "One text.")
    kb.put("b.txt", "Another text.")
    run = index(kb.spark, kb.root, kb.config, Refusing())
    assert run.deferred == 2 and int(run.health) == 1 and {r.status for r in kb.rows("file_index")} == {2}
    assert {(r.status, r.retry_count) for r in kb.rows("chunks")} == {(2, 0)} and kb.facts()["last_provider_health"] == "1"
    assert index(kb.spark, kb.root, kb.config, HashingEmbedder()).deferred == 0 and {r.status for r in kb.rows("file_index")} == {0}


def test_tries_run_out(kb):
    kb.put("a.txt", "First sentence is here. " * 60)
    for _ in range(RETRIES):
        assert index(kb.spark, kb.root, kb.config, Down()).deferred > 1
    assert {r.retry_count for r in kb.rows("chunks")} == {RETRIES}
    index(kb.spark, kb.root, kb.config, Down())
    assert {r.status for r in kb.rows("chunks")} == {4} and [(r.status, r.last_error_stage) for r in kb.rows("file_index")] == [(4, "embed")]


def test_a_file_over_several_frames_is_deferred_as_one(spark):
    class Half(HashingEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return super().embed(texts)

    rows = [(f"i{k:03d}", "p", k, "bad" if k < 40 else "good", None) for k in range(60)] + [("z", "q", 0, "good", None)]
    df = spark.createDataFrame(rows, "id string, source_path string, chunk_index int, content string, enriched string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = by_file(embed_windows(asked_of(df, Half()), Half(), 100).persist()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 61 and {r.source_path: r.deferred for r in got} == {"p": True, "q": False} and len({r.deferred for r in got if r.source_path == "p"}) == 1


class Counting(HashingEmbedder):
    """Notes every call in a folder; dies at one of them."""

    def __init__(self, folder, dies_at=0):
        super().__init__()
        self.folder, self.dies_at = str(folder), dies_at

    def embed(self, texts):
        if self.dies_at and len(os.listdir(self.folder)) >= self.dies_at:
            raise SystemExit
        open(f"{self.folder}/{uuid.uuid4().hex}-{len(texts)}", "w").close()
        return super().embed(texts)


def test_a_run_that_died_asks_for_the_rest_only(kb, tmp_path, monkeypatch):
    monkeypatch.setattr(providers, "ROUND", 4)
    kb.put("a.txt", "".join(f"Sentence number {k} is here. " for k in range(700)))
    (tmp_path / "calls").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        index(kb.spark, kb.root, kb.config, Counting(tmp_path / "calls", 6), batch=1)
    first = os.listdir(tmp_path / "calls")
    n = len(kb.rows("chunks"))
    kept = sum(f.endswith("_SUCCESS") for _, _, names in os.walk(f"{kb.root}/ledger") for f in names)
    assert len(first) == 6 < n and kept > 0 and kb.rows("embeddings") == []
    assert index(kb.spark, kb.root, kb.config, Counting(tmp_path / "calls"), batch=1).deferred == 0
    again = len(os.listdir(tmp_path / "calls")) - 6
    assert n - 6 <= again < n and len(kb.rows("embeddings")) == n  # what was answered in finished rounds is not asked again
    assert not os.path.exists(f"{kb.root}/ledger") or not any(os.walk(f"{kb.root}/ledger/embed"))


def test_windows_of_a_long_file_are_spread(spark):
    rows = spark.range(4000).selectExpr("concat('i', id) AS id", "'p' AS source_path", "cast(id AS int) AS chunk_index", "'text' AS text", "'k' AS key")
    plan = embed_windows(rows, HashingEmbedder(), 10)
    assert len({r[0] for r in plan.select(F.spark_partition_id()).distinct().collect()}) == spark.sparkContext.defaultParallelism


class Seeing(KeywordContextualizer):
    """Says whether the prompt holds the document's context."""

    def enrich(self, prompt):
        if "stop" in prompt.rsplit("<chunk>", 1)[-1]:
            raise RuntimeError("no answer")
        return "CONTEXT: " + ("seen" if "<document_summary>" in prompt else "blind")


def test_partial_context_has_the_document_and_counts(kb):
    kb.put("a.txt", "A text of one chunk.")
    kb.put("b.txt", "Please stop here.")
    index(kb.spark, kb.root, kb.config, HashingEmbedder(), KeywordContextualizer())
    run = partial_run(kb.spark, kb.root, kb.config, "contextualization", HashingEmbedder(), Seeing())
    chunks = {r.source_path: r for r in kb.rows("chunks")}
    assert chunks["a.txt"].enriched.startswith("seen") and chunks["a.txt"].is_contextualized and not chunks["b.txt"].is_contextualized
    state = {r.source_path: (r.status, r.chunks_raw, r.chunks_contextualized, r.chunks_pending) for r in kb.rows("file_index")}
    assert state == {"a.txt": (0, 0, 1, 0), "b.txt": (1, 1, 0, 0)} and run.degraded == 1
    hit = KnowledgeBases(kb.spark, str(kb.base), HashingEmbedder()).search_documents(kb.kb, "seen", search_mode="bm25")
    assert [r["content"] for r in hit["results"]] == ["A text of one chunk."]  # enriched is searched, content comes back


def test_staleness(kb):
    kb.put("a.txt", "A text.")
    index(kb.spark, kb.root, kb.config)
    bases = KnowledgeBases(kb.spark, str(kb.base))
    assert bases.check_changes(kb.kb)["is_clean"]
    store = Store(kb.spark, kb.root)
    store.commit(index_metadata=kb.spark.createDataFrame([("effective_prompt_hash", "old"), ("schema_version", "1")], "key string, value string"))
    found = bases.check_changes(kb.kb)
    assert found["is_prompt_stale"] and found["is_schema_stale"] and not found["is_clean"]
    kb.config.systemPrompt = "Own words"
    index(kb.spark, kb.root, kb.config)
    info = bases.get_index_info(kb.kb)
    assert info["effective_prompt_hash"] == prompt_hash("Own words") and not info["is_prompt_stale"] and info["system_prompt"] == "Own words"


def test_replace_and_migrate(kb):
    kb.put("a.txt", "Old text.")
    index(kb.spark, kb.root, kb.config, HashingEmbedder())
    store = Store(kb.spark, kb.root)
    assert replace_files(store, store.table("chunks").limit(0)) == store.version
    new = kb.spark.createDataFrame([("n_0", "a.txt", 0, "new")], "id string, source_path string, chunk_index int, content string")
    replace_files(store, new)
    assert [(r.id, r.content, r.enriched) for r in kb.rows("chunks")] == [("n_0", "new", "new")] and kb.rows("embeddings") == []
    legacy = kb.spark.createDataFrame([("x", "p", 0, "c")], "id string, source_path string, chunk_index int, content string")
    row = migrate(legacy, "chunks").first()
    assert (row.enriched, row.status, row.is_contextualized, row.metadata, row.retry_count) == ("c", 0, True, "{}", 0)
    assert migrate(migrate(legacy, "chunks"), "chunks").first() == row


class Wire:
    def __init__(self, answer):
        self.answer, self.seen = answer, []

    def __call__(self, url, headers, body):
        self.seen.append((url, headers, body))
        return self.answer


def test_clients_speak_their_services():
    wire = Wire({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    openai = clients.embedder_of(Provider("OpenAI", "m"), "k", send=wire)
    assert openai.embed(["a", "b"]) == [[1.0], [2.0]] and wire.seen[0] == ("https://api.openai.com/v1/embeddings", {"Authorization": "Bearer k"}, {"model": "m", "input": ["a", "b"]})
    wire = Wire({"embeddings": [[1.0, 2.0]]})
    ollama = clients.embedder_of(Provider("ollama", "m", keepAlive="9m"), send=wire)
    assert ollama.embed_query("q") == [1.0, 2.0] and wire.seen[0][0].endswith(":11434/api/embed") and wire.seen[0][2]["keep_alive"] == "9m"
    wire = Wire({"embeddings": [{"values": [3.0, 4.0]}], "embedding": {"values": [0.0, 2.0]}})
    gemini = clients.embedder_of(Provider("gemini", "m", dimension=2), "secret", send=wire)
    assert gemini.embed(["x" * 20_000]) == [[0.6, 0.8]] and gemini.embed_query("q") == [0.0, 1.0]
    document, query = wire.seen[0][2]["requests"][0], wire.seen[1][2]
    assert len(document["content"]["parts"][0]["text"]) == 12_000 and document["outputDimensionality"] == 2 and (document["taskType"], query["taskType"]) == ("RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY")
    assert "secret" not in wire.seen[0][0] + repr(gemini) and wire.seen[0][1] == {"x-goog-api-key": "secret"}
    for name, said in (("anthropic", {"content": [{"text": "A"}]}), ("openai", {"choices": [{"message": {"content": "A"}}]}), ("ollama", {"message": {"content": "A"}})):
        wire = Wire(said)
        assert clients.contextualizer_of(Provider(name, "m", numCtx=99), "k", "be brief", send=wire).enrich("p") == "A" and "be brief" in json.dumps(wire.seen[0][2])
    assert clients.embedder_of(Provider()).embed(["x"]) == [[]] and clients.contextualizer_of(Provider()).enrich("x") == ""
    with pytest.raises(ValueError):
        clients.embedder_of(Provider("nobody", "m"))
    assert clients.unit([1.0] * 3072) == [1.0] * 3072 and clients.unit([0.0]) == [0.0]


def test_keys(monkeypatch):
    asked = []

    def ask(label):
        asked.append(label)
        return f"key{len(asked)}"

    monkeypatch.setenv("OPENAI_API_KEY", "env")
    keys, preset = Keys(ask), Provider("openai", "m", apiKeyPreset="openai")
    assert keys.of(preset) == ("OPENAI_API_KEY", "env") and asked == []
    for n in (1, 2, 3):
        keys.refuse("OPENAI_API_KEY")
        assert keys.of(preset)[1] == f"key{n}"
    keys.refuse("OPENAI_API_KEY")
    assert keys.of(preset)[1] is None  # asked once, and again twice
    assert keys.of(Provider("ollama", "m", apiKeyPreset="x")) == (None, None) and Keys().of(Provider("gemini", "m", apiKeyPreset="nope"))[1] is None


def test_search_asks_again_after_a_refused_key(spark, tmp_path, monkeypatch):
    class Keyed(HashingEmbedder):
        def __init__(self, key, **_):
            super().__init__()
            self.key = key

        def embed_query(self, text):
            if self.key != "right":
                raise AuthError("403")
            return super().embed_query(text)

    clients.register("keyed", Keyed)
    monkeypatch.setenv("KEYED_API_KEY", "wrong")
    kb = Base(spark, tmp_path, embedding=Provider("keyed", "m", apiKeyPreset="keyed"))
    kb.put("a.txt", "Some words.")
    index(spark, kb.root, kb.config, HashingEmbedder())
    assert KnowledgeBases(spark, str(kb.base), keys=Keys(lambda label: "right")).search_documents(kb.kb, "words")["search_mode"] == "hybrid"
    assert "refused" in KnowledgeBases(spark, str(kb.base), keys=Keys(lambda label: "bad")).search_documents(kb.kb, "words")["error"]
    monkeypatch.delenv("KEYED_API_KEY")
    bare = KnowledgeBases(spark, str(kb.base))
    assert bare.search_documents(kb.kb, "words")["search_mode"] == "bm25_only" and "KEYED_API_KEY" in bare.search_documents(kb.kb, "words", search_mode="vector")["error"]


def test_queue_runs_partial_modes_with_the_configured_providers(spark, tmp_path):
    kb = Base(spark, tmp_path, embedding=Provider("hashing", "h", dimension=16))
    kb.put("a.txt", "Some words.")
    assert run_one(spark, kb.folder) == 0 and len(kb.rows("embeddings")[0].embedding) == 16
    write_config(kb.folder / "config.json", Config(id=kb.kb, sourcePaths=[str(kb.docs)], embedding=Provider("hashing", "h2", dimension=8)))
    bases = KnowledgeBases(spark, str(kb.base))
    assert bases.start_reindex(kb.kb, "embedding")["status"] == "queued"
    assert main(["exec-queue", str(kb.base)]) == 0
    assert [(r.model, len(r.embedding)) for r in kb.rows("embeddings")] == [("h2", 8)] and not queue.load(str(kb.base))
    assert main(["exec", str(kb.folder), "--partial", "embedding"]) == 0 and main(["nothing"]) == 64
    lock = queue.orchestrator(str(kb.base))
    assert lock.acquire() and queue.drain(str(kb.base), lambda e: 0) == -1
    lock.release()


def test_lists_and_evicts(kb):
    kb.put("a.txt", "Some words.")
    index(kb.spark, kb.root, kb.config)
    odd = kb.base / "other"
    odd.mkdir()
    (odd / "config.json").write_text("{")
    bases = KnowledgeBases(kb.spark, str(kb.base))
    assert [(b["kb_id"], b["total_files"], b["total_chunks"]) for b in bases.list_knowledge_bases()] == [(kb.kb, 1, 1)]
    assert list(bases.stores) == [kb.kb]
    (kb.folder / "config.json").unlink()
    assert bases.evict() == [kb.kb] and bases.list_knowledge_bases() == []
    old = kb.folder.stat().st_mtime
    assert bases.prune_orphans(now=old + 1) == [] and bases.prune_orphans(now=old + 99, dry_run=True) == [kb.kb] and bases.prune_orphans(now=old + 99) == [kb.kb] and not kb.folder.exists()


def test_tools_over_lines(kb):
    kb.put("a.txt", "Some “words”.")
    index(kb.spark, kb.root, kb.config)
    asks = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search_documents", "arguments": {"kb_id": kb.kb, "query": "words"}}}, {"id": 4, "method": "tools/call", "params": {"name": "nothing"}}, {"id": 5, "method": "tools/call", "params": {"name": "check_changes", "arguments": {"kb_id": "no"}}}, {"id": 6, "method": "tools/call", "params": {"name": "check_changes", "arguments": {}}}]
    out = io.StringIO()
    assert serve.serve(KnowledgeBases(kb.spark, str(kb.base)), io.StringIO("\n".join(map(json.dumps, asks)) + "\nnot json\n"), out) == 0
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in said] == [1, 2, 3, 4, 5, 6, None] and len(said[1]["result"]["tools"]) == 7
    assert "“words”" in said[2]["result"]["content"][0]["text"] and said[4]["result"]["isError"] and [said[k]["error"]["code"] for k in (3, 5, 6)] == [-32601, -32602, -32700]
    assert re.search(r'"kb_id": \{"type": "string"\}', json.dumps(said[1])) and read_config(kb.folder / "config.json").id == kb.kb
