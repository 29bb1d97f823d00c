"""Embedding and contextualizing behind two small protocols, and binary-split isolation of bad inputs.

A provider is any object with these methods that can be sent to executors; clients.py has those of services.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import enriched_of

MAX_DEPTH = 20
ROUND = 100_000  # chunks whose answers are kept together


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def embed_query(self, text: str) -> list[float]: ...


class Contextualizer(Protocol):
    def enrich(self, prompt: str) -> str: ...


class AuthError(Exception):
    """Stops a run at once; it is never taken for a bad input."""


class NullEmbedder:
    model = ""

    def embed(self, texts):
        return [[] for _ in texts]

    def embed_query(self, text):
        return []


class HashingEmbedder:
    """A deterministic embedder for tests: hashed word counts of unit length."""

    def __init__(self, dim: int = 64, model: str = "hashing"):
        self.dim, self.model = dim, model

    def embed_query(self, text):
        v = np.zeros(self.dim)
        for w in text.lower().split():
            h = sha256(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % self.dim] += 1 if h[4] & 1 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def embed(self, texts):
        return [self.embed_query(t) for t in texts]


class NullContextualizer:
    def enrich(self, prompt):
        return ""


class KeywordContextualizer:
    """A deterministic contextualizer for tests: the source line as context, the longest words as keywords."""

    def enrich(self, prompt):
        words = sorted(set(re.findall(r"\w{4,}", prompt.rsplit("<chunk>", 1)[-1].lower())), key=lambda w: (-len(w), w))
        return f"CONTEXT: {prompt.splitlines()[0]}\nKEYWORDS: {', '.join(words[:5])}"


@dataclass
class SplitResult:
    vectors: dict[str, list[float]] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    deferred: bool = False
    calls: int = 0


def embed_isolating(ids: list[str], texts: list[str], provider: Embedder, batch: int) -> SplitResult:
    """Embed in windows; a window that fails is halved until the bad inputs stand alone. When more than
    half of a window of several fails, or halving goes too deep, the provider is taken to be down: the
    file is deferred. AuthError passes through."""
    out = SplitResult()

    def half(low: int, high: int, depth: int) -> int:
        """Number of failed inputs; -1 once it goes too deep."""
        if depth > MAX_DEPTH:
            return -1
        out.calls += 1
        try:
            found = provider.embed(texts[low:high])
            if len(found) != high - low:
                raise ValueError(f"{len(found)} vectors for {high - low} texts")
        except AuthError:
            raise
        except Exception as e:
            if high - low == 1:
                out.failed[ids[low]] = f"{type(e).__name__}: {e}"
                return 1
            middle = low + (high - low) // 2
            first = half(low, middle, depth + 1)
            second = half(middle, high, depth + 1) if first >= 0 else -1
            return -1 if first < 0 or second < 0 else first + second
        out.vectors.update(zip(ids[low:high], found, strict=True))
        return 0

    for low in range(0, len(ids), max(1, batch)):
        high = min(len(ids), low + max(1, batch))
        bad = half(low, high, 0)
        if bad < 0 or (high - low > 1 and 2 * bad > high - low):
            out.deferred = True
            break
    if out.deferred:
        out.vectors, out.failed = {}, {}
    return out


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by source_path and window -> one frame a window, whatever the frames' borders."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for key, own in frame.groupby(["source_path", "window"], sort=False):
            if held and (held[0]["source_path"].iat[0], held[0]["window"].iat[0]) != key:
                yield pd.concat(held)
                held = []
            held.append(own)
    if held:
        yield pd.concat(held)


class Pace:
    """Keeps a task's share of a provider's calls_per_second, if it names one."""

    def __init__(self, provider: object, tasks: int):
        rate = getattr(provider, "calls_per_second", 0)
        self.gap, self.next = (max(1, tasks) / rate if rate else 0.0), 0.0

    def wait(self) -> None:
        if self.gap:
            now = time.monotonic()
            time.sleep(max(0.0, self.next - now))
            self.next = max(now, self.next) + self.gap


class _Paced:
    def __init__(self, provider: Embedder, pace: Pace):
        self.provider, self.pace = provider, pace

    def embed(self, texts: list[str]) -> list[list[float]]:
        self.pace.wait()
        return self.provider.embed(texts)


ASKED = "id string, source_path string, chunk_index int, text string, key string"
EMBEDDED = "chunk_id string, source_path string, key string, embedding array<float>, error string, deferred boolean, refused boolean"


def asked_of(chunks: DataFrame, provider: Embedder) -> DataFrame:
    """What of waiting chunks is sent, as ASKED; key is a digest of the text."""
    text = F.coalesce("enriched", "content")
    longest = getattr(provider, "input_chars", 0)
    text = F.substring(text, 1, longest) if longest else text
    return chunks.select("id", "source_path", "chunk_index", text.alias("text"), F.sha2(text, 256).alias("key"))


def embed_windows(asked: DataFrame, provider: Embedder, batch: int) -> DataFrame:
    """EMBEDDED, with each window of a file (as many chunks as go into a call) on its own: windows are dealt out over
    all tasks, however long a file is. Once the provider refuses the key, a task's other windows are deferred
    without a call."""
    tasks = asked.sparkSession.sparkContext.defaultParallelism

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refused, paced = False, _Paced(provider, Pace(provider, tasks))
        for own in _windows(frames):
            ids, got = own["id"].tolist(), SplitResult(deferred=True)
            if not refused:
                try:
                    got = embed_isolating(ids, own["text"].tolist(), paced, batch)
                except AuthError:
                    refused = True
            rows = [(i, path, key, got.vectors.get(i), got.failed.get(i), got.deferred, refused) for i, path, key in zip(ids, own["source_path"], own["key"], strict=True)]
            yield pd.DataFrame(rows, columns=["chunk_id", "source_path", "key", "embedding", "error", "deferred", "refused"])

    rows = asked.withColumn("window", F.floor(F.col("chunk_index") / max(1, batch)))
    return rows.repartition(tasks, "source_path", "window").sortWithinPartitions("source_path", "window", "chunk_index").mapInPandas(run, EMBEDDED)


def by_file(got: DataFrame) -> DataFrame:
    """EMBEDDED where a file is deferred as a whole once one of its windows is; got is read twice, so it should be a
    written table."""
    late = got.where("deferred").groupBy("source_path").agg(F.max("refused").alias("_refused"))
    both = got.join(late, "source_path", "left")
    all_ = F.col("_refused").isNotNull()
    return both.select("chunk_id", "source_path", "key", F.when(~all_, F.col("embedding")).alias("embedding"), F.when(~all_, F.col("error")).alias("error"), all_.alias("deferred"), F.coalesce("_refused", F.lit(False)).alias("refused"))


def contextualize(chunks: DataFrame, provider: Contextualizer, ask: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """chunks with a column prompt -> enriched and is_contextualized; a call that fails leaves raw text that is
    not contextualized. Without a provider all text counts as contextualized as it is. Prompts are dealt out over all
    tasks; ask, if given, has the answers of prompts (key, prompt) from where they are kept."""
    if isinstance(provider, NullContextualizer):
        return chunks.withColumn("enriched", F.col("content")).withColumn("is_contextualized", F.lit(True)).drop("prompt")
    tasks = chunks.sparkSession.sparkContext.defaultParallelism

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(provider, tasks)
        for frame in frames:
            answers = []
            for prompt in frame["prompt"]:
                pace.wait()
                try:
                    answers.append(provider.enrich(prompt))
                except Exception:
                    answers.append(None)
            yield pd.DataFrame({"key": frame["key"], "answer": pd.Series(answers, index=frame.index, dtype=object)})

    call = lambda asked: asked.select("key", "prompt").repartition(tasks).mapInPandas(run, "key string, answer string")
    keyed = chunks.withColumn("key", F.sha2("prompt", 256))
    prompts = keyed.select("key", "prompt").dropDuplicates(["key"])
    answers = call(prompts) if ask is None else ask(prompts, call)
    both = keyed.join(answers.select("key", "answer"), "key", "left")
    text = enriched_of(F.coalesce("answer", F.lit("")), F.col("content"))
    return both.withColumn("is_contextualized", F.col("answer").isNotNull()).withColumn("enriched", text).drop("answer", "prompt", "key")


class Ledger:
    """Answers of providers, kept as they come, so that a run that dies has not asked in vain. Questions are asked in
    rounds, and each round's answers are a Parquet folder of their own; what an earlier run has left there is not
    asked again. settle() drops all, once their chunks are committed."""

    def __init__(self, spark: SparkSession, root: str, task: str, model: str):
        self.spark, self.place = spark, f"{root}/ledger/{task}-{sha256(model.encode()).hexdigest()[:16]}"
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}" if name else self.place)

    def kept(self, schema: str) -> DataFrame | None:
        """Rows of all rounds that were finished, if there are any."""
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path())] if self.fs.exists(self._path()) else []
        whole = [f"{self.place}/{n}" for n in names if self.fs.exists(self._path(f"{n}/_SUCCESS"))]
        return self.spark.read.schema(schema).parquet(*whole) if whole else None

    def asked(self, left: DataFrame, deal: list[str], ask: Callable[[DataFrame], DataFrame], schema: str, stop: Callable[[DataFrame], bool] = lambda _: False) -> tuple[DataFrame, DataFrame | None]:
        """Ask for all rows of left in rounds, those of equal deal in one; the answers of this run, and the rows that
        were not asked because stop said so of a round."""
        rounds = max(1, -(-left.count() // ROUND))
        turn = F.pmod(F.xxhash64(*deal), F.lit(rounds))
        done: list[str] = []
        for k in range(rounds):
            done.append(f"{self.place}/{uuid.uuid4().hex}")
            ask(left.where(turn == k)).write.parquet(done[-1])
            if k + 1 < rounds and stop(self.spark.read.schema(schema).parquet(done[-1])):
                return self.spark.read.schema(schema).parquet(*done), left.where(turn > k)
        return self.spark.read.schema(schema).parquet(*done), None

    def settle(self) -> None:
        self.fs.delete(self._path(), True)
