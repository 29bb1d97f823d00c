"""The re-index queue: pure functions over a list of entries, and a loop that runs them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from ..sources.files import read_json, write_json
from .lock import IndexLock

FILE = "queue.json"
DIED = "orchestrator_died_or_killed"
Entry = dict


def rank(mode: str | None) -> int:
    return {"embedding": 1, "contextualization": 2}.get(mode or "", 3)


def running(e: Entry) -> bool:
    return bool(e.get("started_at")) and not e.get("last_error")


def pending(e: Entry) -> bool:
    return not e.get("started_at") and not e.get("last_error")


def load(base: str) -> list[Entry] | None:
    raw = read_json(Path(base, FILE))
    return raw.get("entries", []) if isinstance(raw, dict) else None


def save(base: str, entries: list[Entry]) -> None:
    write_json(Path(base, FILE), {"version": 1, "entries": entries})


def recover(entries: list[Entry]) -> int:
    """Entries that a dead runner left as running become failed ones."""
    stale = [e for e in entries if running(e)]
    for e in stale:
        e["started_at"], e["last_error"] = None, DIED
    return len(stale)


def merge(entries: list[Entry], kb_id: str, mode: str | None = None, force: bool = False, deferred: bool = False, now: str | None = None) -> str:
    """Put a request into the queue, in place, and say what became of it."""
    request = {"kb_id": kb_id, "scheduled_at": now or datetime.now(UTC).isoformat(), "is_reindex": mode is None, "partial_mode": mode, "force": force, "deferred": deferred, "started_at": None, "last_error": None}
    old = next((e for e in entries if e["kb_id"] == kb_id), None)
    if old is None:
        entries.append(request)
        return "queued"
    covered = rank(old.get("partial_mode")) >= rank(mode)
    if running(old):
        if covered:
            return "already_running"
        entries.append(request)
        return "queued_after_current"
    request["force"] = force or bool(old.get("force"))
    if old.get("last_error"):
        old.update(request)
        return "queued"
    if covered:
        old["force"], old["deferred"] = request["force"], bool(old.get("deferred")) and deferred
        return "already_queued"
    old.update(request)
    return "upgraded"


def cancel(entries: list[Entry] | None, kb_id: str) -> dict:
    if entries is None:
        return {"kb_id": kb_id, "cancelled": False, "reason": "no_queue"}
    old = next((e for e in entries if e["kb_id"] == kb_id), None)
    if old is None:
        return {"kb_id": kb_id, "cancelled": False, "reason": "not_found"}
    if running(old):
        return {"kb_id": kb_id, "cancelled": False, "reason": "already_running"}
    entries[:] = [e for e in entries if e["kb_id"] != kb_id]
    return {"kb_id": kb_id, "cancelled": True}


def position(entries: list[Entry], kb_id: str) -> int:
    """1-based among the waiting entries; 0 while running or absent."""
    if any(running(e) and e["kb_id"] == kb_id for e in entries):
        return 0
    waiting = [e["kb_id"] for e in entries if pending(e)]
    return waiting.index(kb_id) + 1 if kb_id in waiting else 0


def orchestrator(base: str) -> IndexLock:
    """The lock of the process that works through a base's queue; it lies beside the queue."""
    return IndexLock(Path(base, ".orchestrator"))


def drain(base: str, work: Callable[[Entry], int], sweep_all: bool = False) -> int:
    """Run waiting entries, first come first served, deferred ones only in a sweep. A run that raises or
    ends with 1 leaves its message; only the finished entry goes. Returns the number of runs, -1 if another
    process is at it."""
    lock = orchestrator(base)
    if not lock.acquire():
        return -1
    try:
        return _drained(base, work, sweep_all)
    finally:
        lock.release()


def _drained(base: str, work: Callable[[Entry], int], sweep_all: bool) -> int:
    entries, runs = load(base) or [], 0
    if recover(entries):
        save(base, entries)
    while True:
        entries = load(base) or []
        e = next((e for e in entries if pending(e) and (sweep_all or not e.get("deferred"))), None)
        if e is None:
            return runs
        if not Path(base, e["kb_id"], "config.json").exists():
            entries.remove(e)
            save(base, entries)
            continue
        e["started_at"] = datetime.now(UTC).isoformat()
        save(base, entries)
        runs += 1
        try:
            code = work(dict(e))
            error = "the run failed" if code == 1 else None
        except Exception as x:
            error = f"{type(x).__name__}: {x}"
        entries = load(base) or []
        own = next((x for x in entries if x["kb_id"] == e["kb_id"] and x.get("started_at") == e["started_at"]), None)
        if own is not None:
            if error:
                own["last_error"] = error
            else:
                entries.remove(own)
            save(base, entries)
