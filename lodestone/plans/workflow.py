"""The indexing run: scan, work set, chunk, enrich, commit, embed, commit."""

from __future__ import annotations

import json
import logging
import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunker import chunked
from ..functions.text import DEFAULT_BATCH, DEFAULT_PROMPT, batch_size, chunk_id, context_of, prompt_of, trimmed
from ..operators import stats
from ..operators.changes import orphans, work_set
from ..schema import SCHEMA_VERSION, ProviderHealth, migrate
from ..sources.files import Config, contents, listing, parse, scan
from .lock import IndexLock
from .providers import EMBEDDED, Contextualizer, Embedder, Ledger, NullContextualizer, NullEmbedder, asked_of, by_file, contextualize, embed_windows
from .store import Store, contextualized, delete_paths, index_is_current, mark_files_failed, persist_pending, prepare_partial, promote, refresh_index, set_metadata, settle, update_chunks

RETRIES = 3
FAILURES_TOLD = 1000  # of a run, in its result and metadata; the store's table of failures has all
CHUNKS_A_FILE = 8  # expected of new files, to lay out the store before they come
LOG = logging.getLogger("lodestone")


@dataclass
class RunResult:
    indexed: int = 0
    skipped: int = 0
    failed: dict[str, str] = field(default_factory=dict)
    failed_files: int = 0
    deferred: int = 0
    degraded: int = 0
    needs_action: int = 0
    cancelled: bool = False
    busy: bool = False
    health: ProviderHealth = ProviderHealth.OK

    @property
    def exit_code(self) -> int:
        if self.busy:
            return 1
        return 2 if self.cancelled else int(self.failed_files > 0 and not self.indexed)


class _Run:
    """What one run needs at every step: its store, its own scratch folder, its lock and the timing log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.began = spark, root, time.monotonic()
        self.lock = IndexLock(Path(root).parent)
        self.scratch = f"{root}/scratch/{uuid.uuid4().hex}"
        self.log = Path(root).parent / "timing.log"
        self.contexts: Ledger | None = None  # of the contextualizer that was asked
        self.failures: list[DataFrame] = []  # of each part, in the scratch folder

    def held(self) -> bool:
        if not self.lock.acquire():
            LOG.error("another process is indexing %s", self.root)
            return False
        self.store = Store(self.spark, self.root)
        return True

    def told(self, stage: str, **facts) -> None:
        line = f"{datetime.now(UTC).isoformat()} {stage} {time.monotonic() - self.began:.3f}s " + " ".join(f"{k}={v}" for k, v in facts.items())
        LOG.info(line)
        with self.log.open("a", encoding="utf-8") as f:
            f.write(line.rstrip() + "\n")
        self.lock.update(facts.get("current", 0), facts.get("total", 0), current_stage=stage, failed_count=facts.get("failed"), provider_health=facts.get("health"))

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.scratch}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.scratch}/{name}")

    def ledger(self, task: str, model: str) -> Ledger:
        return Ledger(self.spark, self.root, task, model)

    def answers(self, provider: Contextualizer):
        """Has the answers to prompts from the ledger, and from the provider what it does not have."""
        name = f"{type(provider).__name__}/{getattr(provider, 'model', '')}"
        ledger, schema = self.ledger("context", name), "key string, answer string"
        self.contexts = ledger

        def ask(prompts: DataFrame, call) -> DataFrame:
            known = ledger.kept(schema)
            if known is None:
                return ledger.asked(prompts, ["key"], call, schema)[0]
            known = known.where(F.col("answer").isNotNull()).dropDuplicates(["key"])
            known = self.written(prompts.join(known, "key").select("key", "answer"), f"answers-{uuid.uuid4().hex[:6]}")
            got, _ = ledger.asked(prompts.join(known, "key", "left_anti"), ["key"], call, schema)
            return known.unionByName(got)

        return ask

    def cancelled(self) -> bool:
        return Path(self.root, "cancel").exists() or (Path(self.root).parent / "cancel").exists()

    def close(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.scratch)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.lock.release()


def prompt_hash(prompt: str) -> str:
    return sha256(prompt.encode()).hexdigest()[:16]


def _prompted(rows: DataFrame) -> DataFrame:
    """Adds prompt to chunks with the column context."""
    total = rows.groupBy("source_path").agg(F.count("*").alias("total"))
    name = F.element_at(F.split("source_path", "/"), -1)
    return rows.join(total, "source_path").withColumn("prompt", prompt_of(F.col("content"), F.col("context"), name, F.col("chunk_index"), F.col("total")))


def prompted_chunks(texts: DataFrame, max_chars: int = 0) -> DataFrame:
    """(source_path, text, metadata) -> chunks with their prompts."""
    texts = texts if "metadata" in texts.columns else texts.withColumn("metadata", F.lit("{}"))
    rows = chunked(texts.select("source_path", "metadata", context_of(F.col("text")).alias("context"), "text"), max_chars=max_chars)
    return _prompted(rows.withColumn("id", chunk_id(F.col("source_path"), F.col("chunk_index"))))


def _enriched(run: _Run, rows: DataFrame, provider: Contextualizer, name: str) -> DataFrame:
    """Chunks with prompts -> rows of the table chunks, enriched where the provider answers. Answers are kept in the
    ledger until finish."""
    if not isinstance(provider, NullContextualizer):
        rows = run.written(rows, f"{name}-prompts")
    return run.written(migrate(contextualize(rows, provider, run.answers(provider)), "chunks"), name)


def _embed(run: _Run, waiting: DataFrame, provider: Embedder, batch: int) -> tuple[int, ProviderHealth]:
    """Embed waiting chunks. What the provider answers is kept in the ledger before it is used, so that neither a
    task that is run again nor a run after one that died calls for it again. Returns the number of deferred chunks
    and the provider's health."""
    store = run.store
    if isinstance(provider, NullEmbedder):
        settle(store)
        return 0, ProviderHealth.OK
    ledger, asked = run.ledger("embed", provider.model), asked_of(waiting, provider)
    before, known, left = ledger.kept(EMBEDDED), None, asked
    if before is not None:
        before = before.where(F.col("embedding").isNotNull()).select("key", "embedding").dropDuplicates(["key"])
        known = run.written(asked.join(before, "key").select(F.col("id").alias("chunk_id"), "source_path", "key", "embedding", F.lit(None).cast("string").alias("error"), F.lit(False).alias("deferred"), F.lit(False).alias("refused")), f"known-{uuid.uuid4().hex[:6]}")
        left = asked.join(known.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    window = left.withColumn("window", F.floor(F.col("chunk_index") / max(1, batch)))
    got, unasked = ledger.asked(window, ["source_path", "window"], lambda rows: embed_windows(rows.drop("window"), provider, batch), EMBEDDED, lambda rows: not rows.where("refused").isEmpty())
    every = got if known is None else known.select(*got.columns).unionByName(got)
    if unasked is not None:
        every = every.unionByName(unasked.select(F.col("id").alias("chunk_id"), "source_path", "key", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("deferred"), F.lit(True).alias("refused")))
    got = by_file(every)
    vectors = got.where(F.col("embedding").isNotNull()).select("chunk_id", F.lit(provider.model).alias("model"), "embedding", "source_path")
    promote(store, vectors, got.where(F.col("error").isNotNull()).select("chunk_id", "source_path", "error"))
    n = got.agg(F.count_if("deferred").alias("late"), F.count_if("refused").alias("refused")).first()
    # A refused key is no fault of the chunks, so it costs them no try.
    late = got.where("deferred and not refused").select(F.col("chunk_id").alias("id"), "source_path")
    if n.late > n.refused:
        update_chunks(store, late, 2, "deferred")
    if not n.late:
        ledger.settle()
    return n.late, ProviderHealth.EMBEDDING_UNAVAILABLE if n.refused else ProviderHealth.OK


def _retry(run: _Run, provider: Embedder, batch: int) -> tuple[int, ProviderHealth]:
    """All waiting chunks: those out of tries fail, and with them files that wait for nothing else."""
    store = run.store
    chunks = store.table("chunks").where("status = 2")
    worn = chunks.where(F.col("retry_count") >= RETRIES).select("id", "source_path")
    if not worn.isEmpty():
        update_chunks(store, worn, 4, f"retry budget exhausted ({RETRIES})")
        settle(store, worn)
    waiting = store.table("chunks").where("status = 2")
    if waiting.isEmpty():
        return 0, ProviderHealth.OK
    return _embed(run, waiting, provider, batch)


def _finished(run: _Run, result: RunResult, config: Config) -> None:
    """Counters of the state after the run, and the run's metadata."""
    if not index_is_current(run.store):
        refresh_index(run.store)
        run.told("text index")
    state = {name: run.store.count(name) for name in ("degraded", "needs_action", "failed", "partially_deferred")}
    result.degraded, result.needs_action = state["degraded"], state["needs_action"]
    told = dict(sorted(result.failed.items()))
    facts = {"last_indexed_count": result.indexed, "last_skipped_count": result.skipped, "last_failed_count": state["failed"], "last_degraded_count": state["degraded"], "last_partially_deferred_count": state["partially_deferred"], "last_run_duration_ms": int(1000 * (time.monotonic() - run.began)), "last_run_completed_utc": datetime.now(UTC).isoformat(), "last_provider_health": int(result.health), "last_failed_files": _json(list(told)), "last_failed_reasons": _json(list(told.values()))}
    set_metadata(run.store, {k: str(v) for k, v in facts.items()})
    run.told("run", indexed=result.indexed, skipped=result.skipped, failed=result.failed_files, deferred=result.deferred, health=int(result.health))


def _opened(run: _Run, config: Config) -> None:
    """The facts that staleness is judged by."""
    prompt = config.systemPrompt or DEFAULT_PROMPT
    set_metadata(run.store, {"effective_prompt_hash": prompt_hash(prompt), "system_prompt": config.systemPrompt or None, "schema_version": str(SCHEMA_VERSION)})


def _batch(config: Config, batch: int) -> int:
    return batch or config.embedding.batchSize or batch_size(config.embedding.provider, config.embedding.model) or DEFAULT_BATCH


def index(spark: SparkSession, root: str, config: Config, embedder: Embedder | None = None, contextualizer: Contextualizer | None = None, force: bool = False, batch: int = 0) -> RunResult:
    """One run over the configured folders. Files whose hash is known are skipped; an emptied folder loses
    its entries; a blank file keeps its old chunks and hash; a file that cannot be read keeps its chunks and
    needs action. While another run holds the lock nothing is done (busy, exit code 1)."""
    run, result = _Run(spark, root), RunResult()
    if not run.held():
        result.busy = True
        return result
    try:
        store = run.store
        if not force and store.version and _unchanged(run, config, result):
            return result
        _opened(run, config)
        listed = run.written(scan(spark, config.sourcePaths, None if force else store.table("file_index")), "listed")
        gone = orphans(listed, store.table("file_index"))
        if not gone.isEmpty():
            delete_paths(store, gone)
        if run.cancelled():
            result.cancelled = True
            return result
        work = run.written(work_set(listed, store.table("file_index"), force), "work")
        total = work.count()
        result.skipped = listed.count() - total
        run.told("scanned", total=total)
        store.spread(store.count("chunks") + CHUNKS_A_FILE * total)
        done = 0
        for part in contents(spark, work):
            if run.cancelled():
                result.cancelled = True
                break
            done += 1
            _index_part(run, result, parse(part), config, contextualizer or NullContextualizer(), f"part{done}")
            run.told("chunked", current=result.indexed + result.failed_files, total=total, failed=result.failed_files)
        result.deferred, result.health = _retry(run, embedder or NullEmbedder(), _batch(config, batch))
        if not result.cancelled and (run.failures or "failures" in store.places):
            none = spark.createDataFrame([], "source_path string, error string")
            store.commit(failures=reduce(DataFrame.unionByName, run.failures, none))
        _finished(run, result, config)
        return result
    finally:
        run.close()


def _unchanged(run: _Run, config: Config, result: RunResult) -> bool:
    """A run over folders in which no size and time of change differs, with no chunk waiting, is one job, opens no
    file and writes nothing but its metadata."""
    store = run.store
    if store.metadata.get("effective_prompt_hash") != prompt_hash(config.systemPrompt or DEFAULT_PROMPT) or run.cancelled():
        return False
    now = listing(run.spark, config.sourcePaths).select("source_path", "size", "modified")
    files = store.table("file_index").select("source_path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), "status")
    both = now.join(files, "source_path", "full_outer")
    same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified")) & (F.col("status") != 2)
    n = both.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(same, F.lit(False))).alias("odd")).first()
    if n.odd:
        return False
    result.skipped = n.n
    _finished(run, result, config)
    return True


def _index_part(run: _Run, result: RunResult, parsed: DataFrame, config: Config, provider: Contextualizer, name: str) -> None:
    """Texts of some files to waiting chunks, with one commit; files that cannot be read are marked."""
    parsed = run.written(parsed, f"{name}-parsed")
    bad = parsed.where("error is not null").select("source_path", "error")
    counts = parsed.agg(F.count_if(F.col("error").isNotNull()).alias("bad"), F.count_if(F.length(trimmed(F.col("text"))) > 0).alias("good")).first()
    if counts.bad:
        result.failed |= {r.source_path: r.error for r in bad.orderBy("source_path").limit(max(0, FAILURES_TOLD - len(result.failed))).collect()}
        mark_files_failed(run.store, bad, "extract")
        run.failures.append(bad)
    result.failed_files += counts.bad
    result.indexed += counts.good
    if counts.good:
        ready = parsed.where(F.col("error").isNull() & (F.length(trimmed(F.col("text"))) > 0))
        persist_pending(run.store, _enriched(run, prompted_chunks(ready, config.embedding.maxChunkChars), provider, f"{name}-chunks"), ready)
        if run.contexts:
            run.contexts.settle()


def partial(spark: SparkSession, root: str, config: Config, kind: str, embedder: Embedder | None = None, contextualizer: Contextualizer | None = None, force: bool = False, batch: int = 0) -> int:
    """partial_run, for its number of deferred chunks."""
    return partial_run(spark, root, config, kind, embedder, contextualizer, force, batch).deferred


def partial_run(spark: SparkSession, root: str, config: Config, kind: str, embedder: Embedder | None = None, contextualizer: Contextualizer | None = None, force: bool = False, batch: int = 0) -> RunResult:
    """Embed, or contextualize and embed, all chunks again; resumes what an earlier run of the same kind
    left, and refuses over one of the other kind unless forced."""
    if kind not in ("contextualization", "embedding"):
        raise ValueError(f"unknown kind of partial run '{kind}'")
    run, result = _Run(spark, root), RunResult()
    if not run.held():
        result.busy = True
        return result
    try:
        store = run.store
        embedding, context = store.count("pending_embedding"), store.count("pending_contextualization")
        resume = context > 0 if kind == "contextualization" else embedding > 0 and context == 0
        if not resume and (embedding or context) and not force:
            raise RuntimeError("another partial run is not finished")
        _opened(run, config)
        if not resume:
            prepare_partial(store, kind)
        if kind == "contextualization":
            own = store.table("chunks").where("status = 5")
            rows = _prompted(own.join(stats.document_context(own), "source_path"))
            contextualized(store, _enriched(run, rows.withColumn("status", F.lit(2)), contextualizer or NullContextualizer(), "context"))
            if run.contexts:
                run.contexts.settle()
            run.told("contextualized", total=context)
        result.deferred, result.health = _retry(run, embedder or NullEmbedder(), _batch(config, batch))
        result.indexed = store.count("ready") + store.count("degraded")
        _finished(run, result, config)
        return result
    finally:
        run.close()


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False)
