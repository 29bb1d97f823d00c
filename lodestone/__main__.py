"""python -m lodestone VERB [--import MODULE]... [options]

  exec KB_FOLDER [--force] [--partial contextualization|embedding]
  exec-queue BASE [--all]
  serve BASE                the seven tools as JSON-RPC lines on standard input and output
  prune-orphans BASE
  smoke-parse FILE          what the registered parser makes of a file

--import names a module that registers further providers or parsers.
"""

from __future__ import annotations

import sys
from importlib import import_module
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.api import KnowledgeBases
from .plans.clients import contextualizer_of, embedder_of
from .plans.keys import Keys
from .plans.queue import drain
from .plans.serve import serve
from .plans.workflow import index, partial_run
from .sources.files import PARSERS, read_config

VERBS = ("exec", "exec-queue", "serve", "prune-orphans", "smoke-parse")


def run_one(spark: SparkSession, folder: str | Path, force: bool = False, mode: str | None = None, keys: Keys | None = None) -> int:
    """Index a knowledge base with the providers of its configuration. Its cancel file goes in the end."""
    keys = keys or Keys()
    config = read_config(Path(folder, "config.json"))
    try:
        embedder = embedder_of(config.embedding, keys.of(config.embedding)[1] or "")
        contextualizer = contextualizer_of(config.contextualizer, keys.of(config.contextualizer)[1] or "", config.systemPrompt)
        root = str(Path(folder, "store"))
        if mode:
            return partial_run(spark, root, config, mode, embedder, contextualizer, force).exit_code
        return index(spark, root, config, embedder, contextualizer, force).exit_code
    finally:
        Path(folder, "cancel").unlink(missing_ok=True)


def _option(args: list[str], name: str) -> list[str]:
    return [b for a, b in zip(args, args[1:], strict=False) if a == name]


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in VERBS:
        print(__doc__)
        return 64
    for module in _option(args, "--import"):
        import_module(module)
    verb, where = args[:2]
    if verb == "smoke-parse":
        parser = PARSERS.get(Path(where).suffix.lower())
        found = parser(Path(where).read_bytes()) if parser else ""
        print(found[0] if isinstance(found, tuple) else found)
        return 0 if parser else 1
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if verb == "exec":
        return run_one(spark, where, "--force" in args, next(iter(_option(args, "--partial")), None))
    if verb == "exec-queue":
        drain(where, lambda e: run_one(spark, Path(where, e["kb_id"]), bool(e.get("force")), e.get("partial_mode")), "--all" in args)
        return 0
    if verb == "serve":
        return serve(KnowledgeBases(spark, where), sys.stdin, sys.stdout)
    print("\n".join(KnowledgeBases(spark, where).prune_orphans()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
