"""A persisted word index in segments: BM25 over substrings without reading any text.

A query's tokens hold no white space, so each of their occurrences lies within one word, a run of other characters of
the folded text. The index has, for every word and every batch of chunks, the chunks with the word and how often. A
search first looks for the words that hold a token, by a scan of words alone, and then reads the postings of these
words only: a token occurs in a chunk as often as its words do, times its occurrences in each.

A segment is made without any exchange before the one that sorts it: a task counts its own chunks' words, batch by
batch. A refresh adds one segment and lists dead chunks of others; segments that are not much larger are made anew with
it, so there are few, of sizes that grow by a factor. Rows of the empty word name the chunks of a batch.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_tokens
from .search import FLOOR_IDF, K1, B, bm25_score, occurrences, top

POSTINGS = "word string, batch bigint, n int, places array<int>, tfs array<int>, dls array<int>, ph int, chunk_id string, h bigint"
DEAD = "batch bigint, place int, dl int, segment string"
EMPTY: dict = {"segments": [], "dead": None, "buckets": {}, "of": 0, "next": 0}
BATCH_CHUNKS, BATCH_CHARS = 4096, 16 << 20  # of a batch, whose words are held at once
ABSORB = 4  # a refresh makes segments anew that have up to so many times its chunks
MOST_DEAD = 0.25  # of a segment's chunks; beyond, it is made anew
FREQUENT = 256  # chunks of a batch; words in more are spread over files by batch
TIES = 1000  # chunks beyond the best that are looked at for equal scores
READ_WHOLE = 200_000  # live chunks; in a larger index matching words are looked up first, and only their postings are read
HELD = 20_000  # chunks with a token, as a few numbers each, that come to the driver
NAMED_WORDS = 2000  # matching words that are named in the filter of the postings; more are joined


def indexed_rows(chunks: DataFrame, id: str = "chunk_id", text: str = "content") -> DataFrame:
    """(chunk_id, ph, folded, name, dl, h): what of a chunk is searched. ph is a hash of its file, where there is one."""
    folded, name = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.col(id))
    dl = F.greatest(F.length(folded) - 2, F.lit(0)) + F.greatest(F.length(name) - 2, F.lit(0))
    ph = F.col("ph") if "ph" in chunks.columns else F.lit(0)
    return chunks.select(F.col(id).alias("chunk_id"), ph.cast("int").alias("ph"), folded.alias("folded"), name.alias("name"), dl.cast("int").alias("dl"), F.xxhash64(folded).alias("h"))


def postings(rows: DataFrame, segment: int = 0) -> DataFrame:
    """Rows of a segment (POSTINGS) for indexed_rows, in no order. Batches are numbered by segment and task."""
    names = [f.split()[0] for f in POSTINGS.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, types[f.split()[1]]) for n, f in zip(names, POSTINGS.split(", "), strict=True)])

    def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (segment << 40) + (TaskContext.get().partitionId() << 20)
        held: list[pa.RecordBatch] = []
        docs = chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at, docs, chars
            name, ph, folded, own_name, dl, h = (pa.concat_arrays([b.column(k) for b in held]) for k in range(6))
            dls = dl.to_numpy()
            split = [pc.utf8_split_whitespace(text) for text in (folded, own_name)]  # as str.split; gives empty words too
            each = pa.concat_arrays([x.flatten() for x in split])
            places = np.concatenate([np.repeat(np.arange(docs), pc.list_value_length(x).fill_null(0).to_numpy()) for x in split])
            real = pc.not_equal(each, "")
            coded = each.filter(real).dictionary_encode()
            number = coded.indices.to_numpy().astype(np.int64)
            pairs, tfs = np.unique((number << 32) | places[real.to_numpy(zero_copy_only=False)], return_counts=True)  # by word, then place
            places = pairs & 0xFFFFFFFF
            words = coded.dictionary.cast(pa.string())
            sizes = np.bincount(pairs >> 32, minlength=len(words))
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            own = [words, pa.array(np.full(len(words), at)), pa.array(sizes.astype(np.int32)), *(lists(x, cuts) for x in (places, tfs, dls[places]))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(words), schema.field(k).type) for k in range(6, 9))], schema=schema)
            ones = np.arange(docs + 1)
            rows = [pa.array([""] * docs, pa.string()), pa.array(np.full(docs, at)), pa.array(np.ones(docs, np.int32)), *(lists(x, ones) for x in (ones[:-1], np.zeros(docs), dls))]
            yield pa.RecordBatch.from_arrays([*rows, ph, name.cast(pa.string()), h], schema=schema)
            held.clear()
            at, docs, chars = at + 1, 0, 0

        for batch in batches:
            first = 0
            for k, size in enumerate(pc.utf8_length(batch.column(2)).to_pylist(), 1):
                docs, chars = docs + 1, chars + size
                if docs >= BATCH_CHUNKS or chars >= BATCH_CHARS:
                    held.append(batch.slice(first, k - first))
                    first = k
                    yield from flush()
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if docs:
            yield from flush()

    # Sorted, so that a task that is run again numbers its chunks alike.
    return rows.select("chunk_id", "ph", "folded", "name", "dl", "h").sortWithinPartitions("ph", "chunk_id", "h").mapInArrow(run, POSTINGS)


def laid_out(rows: DataFrame) -> DataFrame:
    """In the order that searches prune by. A word's batches lie together, unless it is in very many chunks."""
    spread = F.when((F.col("word") == "") | (F.col("n") >= FREQUENT), F.pmod(F.xxhash64("batch"), F.lit(64))).otherwise(-1)
    return rows.withColumn("_deal", spread).repartition("word", "_deal").sortWithinPartitions("word", "ph", "batch").drop("_deal")


def chunks_of(segment: DataFrame) -> DataFrame:
    """(chunk_id, h, ph, batch, place, dl) of the chunks in a segment."""
    return segment.where("word = ''").select("chunk_id", "h", "ph", "batch", F.col("places")[0].alias("place"), F.col("dls")[0].alias("dl"))


def _segment(spark: SparkSession, root: str, segment: dict) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(f"{root}/{segment['folder']}")


def refreshed(spark: SparkSession, root: str, index: dict, changed: DataFrame, ranges: list[tuple[int, int]] | None, read: Callable[[list[int]], DataFrame]) -> dict:
    """The index after changes. changed has all chunks (chunk_id, ph, content) whose ph lies in the ranges (None:
    all chunks there are); read gives the chunks of some values of ph, and may give others beside them."""
    rows = indexed_rows(changed)
    inside = F.lit(True)
    if ranges is not None:
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | F.col("ph").between(low, high)
    known = spark.createDataFrame([], "chunk_id string, h bigint, ph int, batch bigint, place int, dl int, segment string")
    for s in index["segments"]:
        known = known.unionByName(chunks_of(_segment(spark, root, s)).withColumn("segment", F.lit(s["folder"])))
    old_dead = spark.read.schema(DEAD).parquet(f"{root}/{index['dead']}") if index["dead"] else spark.createDataFrame([], DEAD)
    live = known.where(inside).join(old_dead.select("batch", "place"), ["batch", "place"], "left_anti")
    same = ["chunk_id", "h"]
    new_dead = live.join(rows.select(*same), same, "left_anti").select("batch", "place", "dl", "segment")
    fresh = rows.join(live.select(*same), same, "left_anti")
    number, folder = index["next"], f"index/s{index['next']}-{uuid.uuid4().hex[:8]}"
    dead = old_dead.unionByName(new_dead)
    dead.write.parquet(f"{root}/{folder}-dead")
    dead = spark.read.schema(DEAD).parquet(f"{root}/{folder}-dead")
    lost = {r.segment: (r.n, r.dl) for r in dead.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()}
    kept = [s | {"dead": lost.get(s["folder"], (0, 0))[0], "dead_dl": lost.get(s["folder"], (0, 0))[1]} for s in index["segments"]]
    count = fresh.count() if kept else None
    again = [s for s in kept if s["dead"] > MOST_DEAD * s["n"]]
    size = (count or 0) + sum(s["n"] - s["dead"] for s in again)
    for s in sorted((s for s in kept if s not in again), key=lambda s: s["n"]):
        if s["n"] <= ABSORB * size:
            again.append(s)
            size += s["n"] - s["dead"]
    if again:
        gone = [s["folder"] for s in again]
        moved = known.where(F.col("segment").isin(gone)).join(dead.select("batch", "place"), ["batch", "place"], "left_anti").select(*same, "ph")
        hashes = [r.ph for r in moved.select("ph").distinct().collect()]
        fresh = fresh.unionByName(indexed_rows(read(hashes)).join(moved.select(*same), same, "left_semi"))
        kept = [s for s in kept if s["folder"] not in gone]
    segments, died = kept, None
    if count is None or size:
        laid_out(postings(fresh, number)).write.parquet(f"{root}/{folder}")
        added = _segment(spark, root, {"folder": folder}).where("word = ''").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("dls")[0]), F.lit(0)).alias("dl")).first()
        if added.n:
            segments = [*kept, {"folder": folder, "n": added.n, "dl": added.dl, "dead": 0, "dead_dl": 0}]
    if any(s["dead"] for s in segments):
        died = f"{folder}-dead"
    return {"segments": segments, "dead": died, "next": number + 1}


def of_index(spark: SparkSession, root: str, index: dict) -> tuple[DataFrame, DataFrame | None, int, int]:
    """Postings, dead chunks, and number and summed length of the live ones."""
    folders = [f"{root}/{s['folder']}" for s in index["segments"]]
    rows = spark.read.schema(POSTINGS).parquet(*folders) if folders else spark.createDataFrame([], POSTINGS)
    dead = spark.read.schema(DEAD).parquet(f"{root}/{index['dead']}") if index["dead"] else None
    return rows, dead, sum(s["n"] - s["dead"] for s in index["segments"]), sum(s["dl"] - s["dead_dl"] for s in index["segments"])


def holds(tokens: list[str]) -> Column:
    """Whether a word holds a token."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.col("word").contains(t)
    return hit


def matching(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """(word) of the words that hold a token; reads words only."""
    return rows.select("word").where(holds(tokens)).distinct()


def found_in(rows: DataFrame, tokens: list[str], dead: DataFrame | None, n: int) -> DataFrame:
    """(batch, place, dl, tf0, tf1, ...) of the live chunks that a token occurs in."""
    words = matching(rows, tokens)
    if n > READ_WHOLE:
        named = [r.word for r in words.limit(NAMED_WORDS + 1).collect()]
        own = rows.where(F.col("word").isin(named)) if len(named) <= NAMED_WORDS else rows.join(words, "word", "left_semi")
    else:
        own = rows.where(holds(tokens))
    times = F.array(*[occurrences(F.col("word"), t).cast("long") for t in tokens])
    each = own.select("batch", times.alias("times"), F.inline(F.arrays_zip("places", "tfs", "dls")))
    counts = [F.sum(F.col("tfs") * F.col("times")[k]).alias(f"tf{k}") for k in range(len(tokens))]
    found = each.groupBy("batch", F.col("places").alias("place"), F.col("dls").alias("dl")).agg(*counts)
    return found if dead is None else found.join(dead.select("batch", "place"), ["batch", "place"], "left_anti")


def _parsed(query: str) -> dict[str, int]:
    """The query's tokens, folded, and how often each stands in it."""
    return dict(Counter(t.lower() for t in query_tokens(query)))


def _sizes(rows: DataFrame, dead: DataFrame | None, n: int | None, length: int | None) -> tuple[int, int]:
    if n is not None and length is not None:
        return n, length
    live = chunks_of(rows) if dead is None else chunks_of(rows).join(dead.select("batch", "place"), ["batch", "place"], "left_anti")
    return tuple(live.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())


def _scored(found: DataFrame, repeats: list[int], n: int, length: int) -> DataFrame:
    """(batch, place, score) of what found_in gives, which is held for the two passes over it."""
    found = found.persist()
    counted = found.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(repeats))]).first()
    known = found.select("*", F.lit(n).alias("n"), F.lit(length / max(1, n)).alias("avgdl"), *[F.lit(v).alias(k) for k, v in counted.asDict().items()])
    return known.select("batch", "place", bm25_score(repeats).alias("score"))


def _scored_here(found: list[Row], repeats: list[int], n: int, length: int) -> list[tuple[int, int, float]]:
    """The same of a few rows, on the driver."""
    dl = np.array([r.dl for r in found], float)
    score = np.zeros(len(found))
    for k, times in enumerate(repeats):
        tf = np.array([r[f"tf{k}"] for r in found], float)
        df = float((tf > 0).sum())
        idf = np.log((n - df + 0.5) / (df + 0.5))
        score += times * (idf if idf > 0 else FLOOR_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl * max(1, n) / length))
    return [(r.batch, r.place, x) for r, x in zip(found, score.tolist(), strict=True)]


def bm25_indexed(rows: DataFrame, query: str, dead: DataFrame | None = None, n: int | None = None, length: int | None = None) -> DataFrame:
    """(batch, place, score) as bm25_scores gives over the texts; named() has the chunks' ids. n and length, the
    number and summed length of the live chunks, are counted where they are not known."""
    tokens = _parsed(query)
    if not tokens:
        return rows.select("batch", F.lit(0).alias("place"), F.lit(0.0).alias("score")).limit(0)
    n, length = _sizes(rows, dead, n, length)
    return _scored(found_in(rows, list(tokens), dead, n), list(tokens.values()), n, length)


def named(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """(chunk_id, score) of scored chunks."""
    ids = rows.where("word = ''").select("batch", F.col("places")[0].alias("place"), "chunk_id")
    return scored.join(ids, ["batch", "place"]).select("chunk_id", "score")


def bm25_top(rows: DataFrame, query: str, k: int, dead: DataFrame | None = None, n: int | None = None, length: int | None = None) -> DataFrame:
    """The k best (chunk_id, score, rank) as top(bm25_scores(...), k) gives. Ids decide ties only, so they are looked
    up for the best chunks and those of the same score as the last of them. Up to HELD chunks with a token are
    scored where the query was asked, in one job; more are scored by Spark."""
    tokens, k = _parsed(query), max(0, k)
    best: list[tuple[int, int, float]] = []
    if tokens and k:
        n, length = _sizes(rows, dead, n, length)
        found, repeats = found_in(rows, list(tokens), dead, n), list(tokens.values())
        if n > READ_WHOLE:  # held, as it is looked at again where there is more than a few
            found = found.persist()
        few = found.limit(HELD + 1).collect()
        if len(few) <= HELD:
            best = _scored_here(few, repeats, n, length)
            found.unpersist()
        else:
            scored = _scored(found, repeats, n, length)
            digits = F.round("score", 9)
            best = [tuple(r) for r in scored.orderBy(F.desc(digits)).limit(k + TIES).collect()]
            if round(best[k - 1][2], 9) == round(best[-1][2], 9):  # more ties than were looked at
                return top(named(scored.where(digits >= round(best[-1][2], 9)), rows), k)
            found.unpersist()
    best.sort(key=lambda r: -round(r[2], 9))
    kept = {f"{b}/{p}": x for b, p, x in best if round(x, 9) >= round(best[min(k, len(best)) - 1][2], 9)}
    ids = []
    if len(kept) > k + TIES:
        return top(named(rows.sparkSession.createDataFrame(best, "batch bigint, place int, score double"), rows), k)
    if kept:
        batches = sorted({int(x.split("/")[0]) for x in kept})
        own = rows.where((F.col("word") == "") & F.col("batch").between(batches[0], batches[-1])).select(F.concat_ws("/", "batch", F.col("places")[0]).alias("at"), "chunk_id")
        ids = own.where(F.col("at").isin(list(kept))).collect()
    order = sorted((-round(kept[r["at"]], 9), r.chunk_id, kept[r["at"]]) for r in ids)[:k]
    return rows.sparkSession.createDataFrame([(name, score, i) for i, (_, name, score) in enumerate(order)], "chunk_id string, score double, rank int")
