"""The seven tools. Errors come back as values, as the callers are programs."""

from __future__ import annotations

import json
import re
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_PROMPT, GUID
from ..operators import changes as J
from ..operators import stats
from ..operators.search import TOP_K, hybrid, hydrate, materialised, with_siblings
from ..operators.textindex import bm25_top, of_index
from ..schema import SCHEMA_VERSION
from ..sources.files import Config, read_config, scan
from . import queue
from .clients import embedder_of
from .keys import Keys, missing
from .lock import IndexLock
from .providers import AuthError, Embedder
from .store import COUNTERS, Store, index_is_current, metadata
from .workflow import prompt_hash

GRACE_SECONDS = 5
PATHS_TOLD = 10_000  # of each kind of change in one answer; counts are of all, changes_frame() has every path


def _iso(t) -> str | None:
    return t.isoformat() if t else None


def classify(folder: Path, require_guid: bool = False) -> str:
    name = folder.name
    if name[:1] in "._" or "-backup-" in name.lower():
        return "Protected"
    if require_guid and not re.match(GUID, name):
        return "Protected"
    return "LiveKb" if (folder / "config.json").exists() else "Orphan"


class KnowledgeBases:
    """embedder, if given, serves all bases; else each base's own is made from its configuration, with a key
    from keys."""

    def __init__(self, spark: SparkSession, base: str, embedder: Embedder | None = None, keys: Keys | None = None):
        self.spark, self.base, self.embedder, self.keys = spark, Path(base), embedder, keys or Keys()
        self.stores: dict[str, Store] = {}

    def _live(self, kb_id: str) -> Path | None:
        folder = self.base / kb_id
        return folder if kb_id and folder.is_dir() and classify(folder) == "LiveKb" else None

    def _missing(self, kb_id: str) -> dict:
        return {"status": "error", "error": f"Knowledge base '{kb_id}' not found."}

    def _store(self, folder: Path) -> Store:
        """The base's store at its current version; opened once."""
        store = self.stores.get(folder.name)
        if store is None:
            store = self.stores[folder.name] = Store(self.spark, str(folder / "store"), read_only=True)
        store.refresh()
        return store

    def evict(self) -> list[str]:
        """Let go of bases whose folder has gone."""
        gone = [k for k in self.stores if self._live(k) is None]
        for k in gone:
            del self.stores[k]
        return gone

    def _listed(self) -> list[tuple[Path, Config]]:
        """Live folders whose config parses and whose name is its id."""
        out = []
        for folder in sorted(p for p in self.base.iterdir() if p.is_dir()):
            if classify(folder) == "LiveKb":
                try:
                    config = read_config(folder / "config.json")
                except (OSError, ValueError, TypeError):
                    continue
                if config.id.lower() == folder.name.lower():
                    out.append((folder, config))
        return out

    def list_knowledge_bases(self) -> list[dict]:
        """All bases, by the counters of their versions; no table is read."""
        self.evict()
        found = self._listed()
        if not found:
            return []
        counts = {config.id: self._counts(self._store(folder)) for folder, config in found}
        return [{"kb_id": c.id, "name": c.name, "total_files": counts[c.id]["files"], "total_chunks": counts[c.id]["chunks"], "last_indexed_at": _iso(counts[c.id]["last_indexed"]), "is_contextualization_degraded": counts[c.id]["degraded_files"] > 0, "is_indexing": IndexLock(f).info() is not None} for f, c in found]

    def _counts(self, store: Store) -> dict:
        """Counters of a base, from its version file; a store from before there were counters is counted."""
        if store.counted:
            return {name: store.count(name) for name in COUNTERS} | {"last_indexed": store.last_indexed}
        files, chunks = store.table("file_index"), store.table("chunks")
        out = stats.file_counters(files).first().asDict() | stats.pending_counts(chunks).first().asDict() | stats.context_stats(files).first().asDict()
        return out | {"chunks": chunks.count(), "files": files.count(), "last_indexed": stats.last_indexed(files).first().last_indexed_at}

    def _embedder(self, config: Config) -> tuple[Embedder | None, str | None]:
        """The embedder to search with and the variable of its key; None where a key is needed and missing."""
        if self.embedder is not None:
            return self.embedder, None
        if not config.embedding.model.strip():
            return None, None
        variable, key = self.keys.of(config.embedding)
        return (None if variable and not key else embedder_of(config.embedding, key or "")), variable

    def search_documents(self, kb_id: str, query: str, top_k: int = TOP_K, threshold: float = 0.3, search_mode: str | None = None) -> dict:
        """A refused key is forgotten and asked for again once."""
        if not query or not query.strip():
            return {"error": "Query is empty."}
        folder = self._live(kb_id)
        if folder is None:
            return {"error": f"Knowledge base '{kb_id}' not found."}
        store = self._store(folder)
        try:
            config = read_config(folder / "config.json")
            for last in (False, True):
                embedder, variable = self._embedder(config)
                if embedder is None and variable and (search_mode or "").lower() == "vector":
                    return {"error": missing(variable)}
                try:
                    return self._searched(store, kb_id, embedder, query, top_k, threshold, search_mode)
                except AuthError as e:
                    if last or variable is None:
                        return {"error": f"The embedding provider refused the key: {e}"}
                    self.keys.refuse(variable)
        except Exception as e:  # the caller is a program on the other end of a pipe
            return {"error": f"{type(e).__name__}: {e}"}

    def _searched(self, store: Store, kb_id: str, embedder: Embedder | None, query: str, top_k: int, threshold: float, mode: str | None) -> dict:
        chunks = store.table("chunks")
        rows, dead, n, length = of_index(self.spark, store.root, store.index) if index_is_current(store) else (None, None, 0, 0)
        vector = (embedder.embed_query(query) or None) if embedder is not None and (mode or "").lower() != "bm25" else None
        words = None if rows is None else lambda k: bm25_top(rows, query, k, dead, n, length)
        ranked = materialised(hybrid(chunks, store.table("embeddings") if vector else None, query, vector, top_k, threshold, mode, embedder.model if vector else None, words))
        listed = ranked.collect()
        found = hydrate(ranked.drop("search_mode"), store.near(r.chunk_id for r in listed)).collect()
        said = listed[0] if listed else None
        return {"kb_id": kb_id, "results": [{k: v for k, v in r.asDict().items() if k != "rank"} for r in found], "query": query, "search_mode": said.search_mode if said else "vector_only" if vector else "bm25_only", "total_chunks_searched": store.count("chunks") if store.counted else chunks.count()}

    def get_document_chunk(self, kb_id: str, chunk_id: str) -> dict:
        folder = self._live(kb_id)
        if folder is None:
            return {"error": f"Knowledge base '{kb_id}' not found."}
        chunks = self._store(folder).near([chunk_id])
        found = stats.chunk_by_id(chunks, chunk_id).first()
        if found is None:
            return {"error": f"Chunk '{chunk_id}' not found."}
        row = with_siblings(chunks.where(F.col("source_path") == found.source_path)).where(F.col("id") == chunk_id).first()
        return {"chunk_id": row.id, "source_path": row.source_path, "chunk_index": row.chunk_index, "total_chunks": row.total_chunks, "content": row.content, "char_offset": row.char_offset, "metadata": row.metadata, "has_previous": row.has_previous, "has_next": row.has_next}

    def changes_frame(self, kb_id: str) -> DataFrame:
        """(source_path, change) of every file that changed."""
        folder = self.base / kb_id
        store, config = self._store(folder), read_config(folder / "config.json")
        files = store.table("file_index")
        return J.changes(scan(self.spark, config.sourcePaths, files).select("source_path", "file_hash"), files, store.table("failures")).where("change <> 'unchanged'")

    def check_changes(self, kb_id: str, limit: int = PATHS_TOLD) -> dict:
        """Counts of all changes, up to `limit` paths of each kind, and whether the index is stale."""
        folder = self._live(kb_id)
        if folder is None:
            return self._missing(kb_id)
        store, config = self._store(folder), read_config(folder / "config.json")
        facts = metadata(store)
        found = self.changes_frame(kb_id).persist()
        kinds = ("added", "modified", "deleted", "known_failed")
        counts = {r.change: r["count"] for r in found.groupBy("change").count().collect()}
        paths = {k: [r.source_path for r in found.where(F.col("change") == k).orderBy("source_path").limit(limit).collect()] if counts.get(k) else [] for k in kinds}
        found.unpersist()
        degraded = self._counts(store)["degraded_files"]
        version = int(facts.get("schema_version", SCHEMA_VERSION))
        flags = J.flags(counts, facts.get("effective_prompt_hash"), prompt_hash(DEFAULT_PROMPT), bool(facts.get("system_prompt")), version, SCHEMA_VERSION, degraded)
        return {"kb_id": kb_id, **paths, **{f"{k}_count": counts.get(k, 0) for k in kinds}, **flags}

    def get_index_info(self, kb_id: str) -> dict:
        folder = self._live(kb_id)
        if folder is None:
            return self._missing(kb_id)
        store, config = self._store(folder), read_config(folder / "config.json")
        entries = queue.load(str(self.base)) or []
        entry = next((e for e in entries if e["kb_id"] == kb_id), None)
        lock = IndexLock(folder).info()
        status = "indexing" if lock or (entry and queue.running(entry) and self._alive(None)) else "failed" if entry and entry.get("last_error") else "queued" if entry else "ready"
        facts, counts = metadata(store), self._counts(store)
        info = {"kb_id": kb_id, "kb_name": config.name, "folder": str(folder), "status": status, "is_indexing": lock is not None, "indexing_progress": {k: lock.get(k) for k in ("current", "total", "pid", "current_stage")} if lock else None}
        info |= {"total_chunks": counts["chunks"], "total_files": counts["files"], "last_indexed_at": _iso(counts["last_indexed"])}
        info |= {k: counts[k] for k in ("ready", "degraded", "partially_deferred", "needs_action", "failed", "pending_embedding", "pending_contextualization")}
        info |= {"total_chunks_contextualized": counts["chunks_contextualized"], "total_chunks_raw": counts["chunks_raw"], "files_contextualization_degraded": counts["degraded_files"]}
        stored, default = facts.get("effective_prompt_hash"), prompt_hash(DEFAULT_PROMPT)
        info |= {"system_prompt": facts.get("system_prompt"), "effective_prompt_hash": stored, "default_prompt_hash": default, "is_prompt_stale": stored is not None and stored != default and not facts.get("system_prompt")}
        for name in ("last_failed_count", "last_indexed_count", "last_skipped_count", "last_degraded_count", "last_partially_deferred_count", "last_run_duration_ms", "last_provider_health"):
            info[name] = int(facts[name]) if name in facts else None
        info |= {"last_run_completed_utc": facts.get("last_run_completed_utc"), "last_failed_files": json.loads(facts.get("last_failed_files", "[]")), "last_failed_reasons": json.loads(facts.get("last_failed_reasons", "[]"))}
        if entry:
            info["queue"] = {"position": queue.position(entries, kb_id), "scheduled_at": entry.get("scheduled_at"), "deferred": entry.get("deferred"), "partial_mode": entry.get("partial_mode"), "last_error": entry.get("last_error")}
        return info

    def _alive(self, said: bool | None) -> bool:
        """Whether a process works through the queue: looked up, unless the caller knows."""
        return queue.orchestrator(str(self.base)).info() is not None if said is None else said

    def start_reindex(self, kb_id: str, partial_mode: str | None = None, force: bool = False, deferred: bool = False, alive: bool | None = None) -> dict:
        if self._live(kb_id) is None:
            return {"status": "not_found", "kb_id": kb_id, "queue_position": 0}
        entries = queue.load(str(self.base)) or []
        if not self._alive(alive):
            queue.recover(entries)
        status = queue.merge(entries, kb_id, partial_mode, force, deferred)
        queue.save(str(self.base), entries)
        return {"status": status, "kb_id": kb_id, "queue_position": queue.position(entries, kb_id)}

    def cancel_reindex(self, kb_id: str, alive: bool | None = None) -> dict:
        entries = queue.load(str(self.base))
        if entries and not self._alive(alive):
            queue.recover(entries)
        out = queue.cancel(entries, kb_id)
        if out["cancelled"]:
            queue.save(str(self.base), entries)
        return out

    def prune_orphans(self, now: float | None = None, dry_run: bool = False) -> list[str]:
        """Remove GUID-named folders without a config that have not changed for a few seconds."""
        now = time.time() if now is None else now
        gone = [p for p in sorted(self.base.iterdir()) if p.is_dir() and classify(p, require_guid=True) == "Orphan" and now - p.stat().st_mtime > GRACE_SECONDS]
        for p in gone:
            if not dry_run:
                shutil.rmtree(p)
        return [p.name for p in gone]
