"""The tools over JSON-RPC 2.0: one request a line in, one answer a line out."""

from __future__ import annotations

import inspect
import json
import logging
from typing import TextIO, get_type_hints

from .. import __doc__ as ABOUT
from .api import KnowledgeBases

TOOLS = ("list_knowledge_bases", "search_documents", "get_document_chunk", "check_changes", "get_index_info", "start_reindex", "cancel_reindex")
HIDDEN = frozenset(["self", "alive"])
KINDS = {str: "string", int: "integer", float: "number", bool: "boolean"}
PROTOCOL = "2024-11-05"


def write(value) -> str:
    """The JSON that goes out: as it is read, without escapes that are not needed."""
    return json.dumps(value, ensure_ascii=False, default=str)


def described(name: str) -> dict:
    """A tool's name, purpose and parameters, from its signature."""
    f = getattr(KnowledgeBases, name)
    hints = get_type_hints(f)
    given = [p for p in inspect.signature(f).parameters.values() if p.name not in HIDDEN]
    kind = lambda p: next((KINDS[t] for t in (hints[p.name], *getattr(hints[p.name], "__args__", ())) if t in KINDS), "string")
    return {"name": name, "description": inspect.getdoc(f) or name.replace("_", " "), "inputSchema": {"type": "object", "properties": {p.name: {"type": kind(p)} for p in given}, "required": [p.name for p in given if p.default is p.empty]}}


def answer(bases: KnowledgeBases, method: str, params: dict):
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "2", "title": (ABOUT or "").strip()}}
    if method == "tools/list":
        return {"tools": [described(t) for t in TOOLS]}
    if method == "tools/call":
        if params.get("name") not in TOOLS:
            raise KeyError(f"unknown tool {params.get('name')}")
        given = {k: v for k, v in (params.get("arguments") or {}).items() if k not in HIDDEN}
        found = getattr(bases, params["name"])(**given)
        return {"content": [{"type": "text", "text": write(found)}], "isError": isinstance(found, dict) and "error" in found}
    if method == "ping":
        return {}
    raise KeyError(f"unknown method {method}")


def serve(bases: KnowledgeBases, source: TextIO, target: TextIO) -> int:
    """Answer until the input ends. Orphaned folders are removed first; that failing stops nothing."""
    try:
        bases.prune_orphans()
    except OSError:
        logging.getLogger("lodestone").warning("orphaned folders could not be removed", exc_info=True)
    for line in source:
        if not line.strip():
            continue
        said: dict = {"jsonrpc": "2.0", "id": None}
        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise ValueError("a request is an object")
            if "id" not in request:  # a notification wants no answer
                continue
            said["id"] = request["id"]
            said["result"] = answer(bases, request.get("method", ""), request.get("params") or {})
        except json.JSONDecodeError as e:
            said["error"] = {"code": -32700, "message": str(e)}
        except KeyError as e:
            said["error"] = {"code": -32601, "message": str(e.args[0])}
        except (TypeError, ValueError) as e:
            said["error"] = {"code": -32602, "message": str(e)}
        target.write(write(said) + "\n")
        target.flush()
    return 0
