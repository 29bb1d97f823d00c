"""Folders of documents, the parser registry, and JSON configuration and queue files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from html.parser import HTMLParser
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_hash, storage_path

#: A parser gives a text, or a text and the facts about it that chunks carry as metadata (a transcription's
#: model and time, say).
Parser = Callable[[bytes], "str | tuple[str, dict[str, str]]"]
BREAKS = frozenset("address article aside blockquote br div dd dl dt figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th title tr ul".split())


def _plain(raw: bytes) -> str:
    return raw.decode("utf-8-sig", "replace")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def _html(raw: bytes) -> str:
    """All text of a page, a line for each block."""
    reader = _Text()
    reader.feed(_plain(raw))
    reader.close()
    return "\n".join(line for line in (x.strip() for x in "".join(reader.parts).split("\n")) if line)


#: Extension -> parser. Richer formats are added here; an extension without a parser is not scanned.
PARSERS: dict[str, Parser] = {".txt": _plain, ".md": _plain, ".html": _html, ".htm": _html}


def register(extension: str, parser: Parser) -> None:
    PARSERS[extension.lower()] = parser


FILES_AT_ONCE = 20_000  # paths that the driver names to one job
LISTED = "source_path string, file string, size bigint, modified timestamp"


def listing(spark: SparkSession, roots: list[str], parsers: dict[str, Parser] | None = None, hashed: bool = False) -> DataFrame:
    """(source_path, file, size, modified) of all supported files below the roots, none of which is opened unless
    their file_hash is asked for. Paths are relative, with the root's number before them if there are several;
    roots that are missing or empty are skipped."""
    known = PARSERS if parsers is None else parsers
    pattern = "(?i)(" + "|".join(k.replace(".", r"\.") for k in sorted(known)) + ")$"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = spark.createDataFrame([], LISTED + (", file_hash string" if hashed else ""))
    for number, root in enumerate(roots):
        where = jvm.org.apache.hadoop.fs.Path(root)
        fs = where.getFileSystem(conf)
        if not fs.exists(where):
            continue
        base = fs.makeQualified(where).toUri().getPath().rstrip("/")
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(pattern))
        plain = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.sub(r"([^\w/])", r"\\\1", base) + "/", "")
        path = storage_path(plain, F.lit(number) if len(roots) > 1 else None)
        out = out.unionByName(rows.select(path.alias("source_path"), F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *[F.sha2("content", 256).alias("file_hash")] * hashed))
    return out


def _named(spark: SparkSession, names: list[str]) -> DataFrame:
    """Files by their paths, which are no patterns."""
    return spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in names])


def scan(spark: SparkSession, roots: list[str], files: DataFrame | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """The listing with file_hash. files is what is known of them (a file index): a file of known size and time of
    change keeps its hash and is not opened; all others are read once. Without files every one is read. A change that
    keeps both size and time is not seen this way."""
    if files is None:
        return listing(spark, roots, parsers, True)
    known = files.select("source_path", "file_hash", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    both = listing(spark, roots, parsers).join(known, "source_path", "left")
    same = F.coalesce(F.col("file_hash").isNotNull() & (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified")), F.lit(False))
    own = ["source_path", "file", "size", "modified"]
    new = both.where(~same).select(*own)
    names = [r.file for r in new.select("file").limit(FILES_AT_ONCE + 1).collect()]
    if len(names) > FILES_AT_ONCE:
        return listing(spark, roots, parsers, True)
    old = both.where(same).select(*own, "file_hash")
    return old.unionByName(new.join(_named(spark, names).select(F.col("path").alias("file"), F.sha2("content", 256).alias("file_hash")), "file").select(*own, "file_hash")) if names else old


def contents(spark: SparkSession, files: DataFrame) -> Iterator[DataFrame]:
    """Listed files with their content, some thousands at a time: only these are opened. They come in the order of the
    store's buckets, so that hardly any bucket is written for two of these parts."""
    rows = files.orderBy(path_hash(F.col("source_path"))).select("file").toLocalIterator()
    while names := [(r.file,) for r in islice(rows, FILES_AT_ONCE)]:
        # the rows beside them are as many as the names, so they are broadcast
        read = _named(spark, [n for (n,) in names]).select(F.col("path").alias("file"), "content")
        own = files.join(F.broadcast(spark.createDataFrame(names, "file string")), "file")
        yield read.join(F.broadcast(own), "file")


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(source_path, file_hash, text, metadata, error): an unknown extension gives an empty text, a parser that
    fails its message. metadata is JSON of what the parser tells beside the text."""
    known = dict(PARSERS if parsers is None else parsers)

    @F.pandas_udf("struct<text:string,metadata:string,error:string>")
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for p, raw in zip(path, content, strict=True):
            parser = known.get(Path(p).suffix.lower())
            try:
                found = parser(bytes(raw)) if parser else ""
                text, facts = found if isinstance(found, tuple) else (found, {})
                out.append((text, json.dumps(facts, ensure_ascii=False), None))
            except Exception as e:  # the message is kept with the file
                out.append((None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "metadata", "error"])

    facts = [c for c in ("source_path", "file_hash", "size", "modified") if c in files.columns]
    return files.select(*facts, run("source_path", "content").alias("r")).select(*facts, "r.text", "r.metadata", "r.error")


@dataclass
class Provider:
    provider: str = ""
    model: str = ""
    baseUrl: str | None = None
    apiKeyPreset: str | None = None
    dimension: int = 0
    maxChunkChars: int = 0
    batchSize: int = 0
    keepAlive: str | None = None
    numCtx: int | None = None


@dataclass
class Config:
    id: str = ""
    name: str = ""
    created: str = ""
    sourcePaths: list[str] = field(default_factory=list)
    contextualizer: Provider = field(default_factory=Provider)
    embedding: Provider = field(default_factory=Provider)
    systemPrompt: str | None = None


def _known(kind: type, raw: dict) -> dict:
    return {k: v for k, v in raw.items() if k in kind.__dataclass_fields__ and v is not None}


def read_config(path: str | Path) -> Config:
    raw = json.loads(Path(path).read_text("utf-8"))
    config = Config(**{k: v for k, v in _known(Config, raw).items() if k not in ("contextualizer", "embedding")})
    for part in ("contextualizer", "embedding"):
        setattr(config, part, Provider(**_known(Provider, raw.get(part) or {})))
    return config


def write_config(path: str | Path, config: Config) -> None:
    write_json(path, asdict(config))


def write_json(path: str | Path, value) -> None:
    """Written beside its place and then moved there, so a reader never sees half a file."""
    path = Path(path)
    other = path.with_name(path.name + ".new")
    other.write_text(json.dumps(value, ensure_ascii=False, indent=2), "utf-8")
    other.replace(path)


def read_json(path: str | Path):
    """None if the file is missing or unreadable."""
    try:
        return json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return None
