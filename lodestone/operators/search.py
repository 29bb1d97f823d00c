"""Ranked retrieval: trigram BM25, exact cosine, reciprocal rank fusion, hydration."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_of, query_tokens

K1, B, FLOOR_IDF = 1.2, 0.75, 1e-6
RRF_K = 60
TOP_K, THRESHOLD, CANDIDATES = 5, 0.3, 3
HELD_GRAMS, OUT_GRAMS = 1 << 20, 1 << 16  # trigrams of chunks that a task holds before it adds them up; of a batch it gives


def occurrences(text: Column, phrase: str) -> Column:
    """Overlapping occurrences of a phrase in case-folded text. Where a phrase cannot overlap itself, the
    length that its removal takes gives the count without a regular expression."""
    p = phrase.lower()
    if any(p.startswith(p[k:]) for k in range(1, len(p))):
        return F.regexp_count(text, F.lit("(?=" + re.sub(r"([^\w\s])", r"\\\1", p) + ")"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)).cast("int")


def bm25_scores(chunks: DataFrame, query: str, id: str = "chunk_id", text: str = "content", index_ids: bool = True) -> DataFrame:
    """(id, score) of every chunk that a token of the query occurs in. Ids are searched too (index_ids).
    One pass counts, and one row of sums (numbers of chunks, lengths, matches) meets every scored row."""
    tokens = query_tokens(query)
    if not tokens:
        return chunks.select(id, F.lit(0.0).alias("score")).where(F.lit(False))
    folded, name = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.col(id))
    trigrams = F.greatest(F.length(folded) - 2, F.lit(0))
    if index_ids:
        trigrams = trigrams + F.greatest(F.length(name) - 2, F.lit(0))
    distinct = list(dict.fromkeys(t.lower() for t in tokens))
    repeats = [sum(t.lower() == d for t in tokens) for d in distinct]
    counts = [occurrences(F.col("_t"), t) + (occurrences(F.col("_i"), t) if index_ids else 0) for t in distinct]
    # Behind a generator each text is counted once; else the filter and every use of a count would count again.
    counted = F.inline(F.array(F.struct("dl", *[c.alias(f"tf{k}") for k, c in enumerate(counts)])))
    rows = chunks.select(id, folded.alias("_t"), name.alias("_i"), trigrams.alias("dl")).select(id, counted)
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(distinct))])
    hit = F.greatest(*[F.col(f"tf{k}") for k in range(len(distinct))], F.lit(0)) > 0
    return scored_by_bm25(rows.where(hit), stats, repeats, id)


def bm25_score(repeats: list[int]) -> Column:
    """The score of a row with dl, tf0, tf1, ... and the corpus statistics n, avgdl, df0, df1, ..."""

    def part(k: int) -> Column:
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, FLOOR_IDF).otherwise(idf)
        return repeats[k] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    total = part(0)
    for k in range(1, len(repeats)):
        total = total + part(k)
    return total


def scored_by_bm25(rows: DataFrame, stats: DataFrame, repeats: list[int], id: str) -> DataFrame:
    """(id, score) of rows with dl and tf0, tf1, ... by the one row of stats: n, avgdl and df0, df1, ..."""
    return rows.crossJoin(F.broadcast(stats)).select(id, bm25_score(repeats).alias("score"))  # stats is one row


def top(scored: DataFrame, k: int, id: str = "chunk_id") -> DataFrame:
    """The k best with rank from 0; ties by id after rounding, so that the last bit decides nothing."""
    best = scored.orderBy(F.desc(F.round("score", 9)), id).limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), id)) - 1)


def bm25_topk(chunks: DataFrame, query: str, k: int, **options) -> DataFrame:
    return top(bm25_scores(chunks, query, **options), k, options.get("id", "chunk_id"))


def _cosines(query: list[float]) -> Callable[..., Column]:
    """(vector, its norm) -> cosine with the query, a batch of vectors as one matrix. 0 for vectors of another length
    and those of norm 0; sums are in double."""
    q = np.array(query, np.float64)
    own = float(np.sqrt(q @ q))

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, norms in batches:
            sizes = np.diff(np.asarray(lists.offsets))
            fits = sizes == len(q)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            matrix = flat.reshape(-1, len(q)) if fits.all() else flat[np.repeat(fits, sizes)].reshape(-1, len(q))
            size = norms.to_numpy(zero_copy_only=False)[fits].astype(np.float64)
            out = np.zeros(len(lists))
            with np.errstate(all="ignore"):
                score = (matrix @ q) / (size * own)
            out[fits] = np.where(size > 0, score, 0.0)
            yield pa.array(out, mask=np.asarray(lists.is_null()))

    return run


def knn_scores(vectors: DataFrame, query: list[float], threshold: float = THRESHOLD, id: str = "chunk_id", vector: str = "embedding", model: str | None = None) -> DataFrame:
    """(id, score) with score >= threshold; only vectors of the model, if one is named. The column norm has the
    vectors' lengths, where the table has it; else they are taken here. A null vector has no score."""
    if model is not None:
        vectors = vectors.where(F.col("model") == model)
    if not query or not any(query):
        return vectors.where(F.col(vector).isNotNull()).select(id, F.lit(0.0).alias("score")).where(F.col("score") >= threshold)
    norm = F.col("norm") if "norm" in vectors.columns else norm_of(F.col(vector))
    return vectors.select(id, _cosines(query)(F.col(vector), norm).alias("score")).where(F.col("score") >= threshold)


def knn_topk(vectors: DataFrame, query: list[float], k: int = TOP_K, threshold: float = THRESHOLD, **options) -> DataFrame:
    return top(knn_scores(vectors, query, threshold, **options), k, options.get("id", "chunk_id"))


def rrf(lists: list[DataFrame], k: int, id: str = "chunk_id", constant: int = RRF_K) -> DataFrame:
    """Fused (id, score, rank) of ranked lists (id, rank from 0); ties in the order of first appearance. No
    lists, or no places, give no rows."""
    if not lists:
        return SparkSession.active().createDataFrame([], f"{id} string, score double, rank int")
    rows = [x.select(id, "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = rows[0]
    for x in rows[1:]:
        both = both.unionByName(x)
    fused = both.groupBy(id).agg(F.sum(1.0 / (constant + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = [F.desc(F.round("score", 12)), "seen", id]
    best = fused.orderBy(*order).limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select(id, "score", "rank")


def with_siblings(chunks: DataFrame, path: str = "source_path") -> DataFrame:
    """total_chunks of each chunk's file, has_previous and has_next. Counted by a join of partial sums,
    so a file with very many chunks is not gathered in one task."""
    totals = chunks.groupBy(path).agg(F.count("*").alias("total_chunks"))
    index = F.col("chunk_index")
    both = chunks.join(totals, path)
    return both.withColumn("has_previous", index > 0).withColumn("has_next", (F.col("total_chunks") > 0) & (index < F.col("total_chunks") - 1))


def materialised(few: DataFrame) -> DataFrame:
    """A result of a few rows (a top-k list), computed now and held as a local table."""
    rows = few.collect()
    return few.sparkSession.createDataFrame([tuple(r) for r in rows], few.schema)


def hydrate(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with their chunks, in rank order; unknown ids go. Siblings are counted for their files only.
    How the joins run is left to the sizes that Spark finds, as ranked may be a top-k list or all ids."""
    own = chunks.join(ranked, chunks.id == ranked.chunk_id).select(chunks["*"], "chunk_id", "score", "rank")
    totals = chunks.select("source_path").join(own.select("source_path").distinct(), "source_path", "left_semi").groupBy("source_path").agg(F.count("*").alias("total_chunks"))
    out = own.join(totals, "source_path")
    return out.select("chunk_id", "source_path", "chunk_index", "total_chunks", "content", F.col("score").cast("float").alias("score"), (F.col("chunk_index") > 0).alias("has_previous"), (F.col("chunk_index") < F.col("total_chunks") - 1).alias("has_next"), "rank").orderBy("rank")


def mode_of(requested: str | None, has_embedder: bool) -> str | None:
    """bm25 or vector as asked for; anything else means to decide by what is there."""
    asked = {"bm25": "bm25", "vector": "vector"}.get((requested or "").lower(), "auto")
    if asked == "vector" and not has_embedder:
        raise ValueError("vector search needs an embedding provider")
    return "bm25" if asked == "auto" and not has_embedder else asked


def hybrid(chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None, k: int = TOP_K, threshold: float = THRESHOLD, mode: str | None = None, model: str | None = None, words: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """(chunk_id, score, rank, search_mode). chunks has id, content and enriched; the latter is searched, unless
    words gives so many best (chunk_id, score, rank) from an index.

    Both lists have CANDIDATES * k rows at most. They are computed once, before the fusion looks at them
    several times.
    """
    decided = mode_of(mode, query_vector is not None and vectors is not None)
    searched = chunks.select(F.col("id").alias("chunk_id"), F.coalesce("enriched", "content").alias("content"))
    words = words or (lambda k: top(bm25_scores(searched, query), k))
    if decided == "bm25":
        return words(k).withColumn("search_mode", F.lit("bm25_only"))
    if decided == "vector":
        return top(knn_scores(vectors, query_vector, threshold, model=model), k).withColumn("search_mode", F.lit("vector_only"))
    wide = CANDIDATES * k
    listed = materialised(words(wide))
    near = materialised(top(knn_scores(vectors, query_vector, threshold, model=model), wide))
    if listed.isEmpty():
        return near.where(F.col("rank") < k).withColumn("search_mode", F.lit("vector_only"))
    return rrf([listed, near], k).withColumn("search_mode", F.lit("hybrid"))


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text in order, three code points of 21 bits in one number, and how often each is there."""
    code = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((code[:-2] << 42) | (code[1:-1] << 21) | code[2:], return_counts=True)


def _gram_texts(grams: np.ndarray) -> pa.Array:
    """Trigrams as strings."""
    parts = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF], axis=1)
    chars = parts.astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([chars[k : k + 3] for k in range(0, len(chars), 3)], pa.string())


def postings(chunks: DataFrame, id: str = "chunk_id", text: str = "content") -> DataFrame:
    """(trigram, id, tf): counts of trigrams, each chunk's by itself, so nothing moves; textindex.py has the index
    that searches read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own in zip(batch.column(0), batch.column(1), strict=True):
                grams, counts = _grams(own.as_py())
                yield pa.RecordBatch.from_arrays([_gram_texts(grams), pa.array([name.as_py()] * len(counts), pa.string()), pa.array(counts.astype(np.int64))], names=["trigram", id, "tf"])

    return chunks.select(F.col(id).cast("string"), F.lower(F.col(text))).mapInArrow(run, f"trigram string, {id} string, tf long")


def _task_sums(chunks: DataFrame, text: str) -> DataFrame:
    """(trigram, df, tf) of each task's chunks; a task with very many different trigrams gives some more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        grams, sums = empty, np.zeros((2, 0), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merge() -> None:
            nonlocal grams, sums, found, held
            every = np.concatenate([grams, *(g for g, _ in found)])
            df = np.concatenate([sums[0], np.ones(held, np.int64)])
            tf = np.concatenate([sums[1], *(n for _, n in found)])
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.flatnonzero(np.diff(every, prepend=-1))
            grams, sums = every[first], np.stack([np.add.reduceat(x[order], first) if len(first) else empty for x in (df, tf)])
            found, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(grams), OUT_GRAMS):
                part = slice(k, k + OUT_GRAMS)
                yield pa.RecordBatch.from_arrays([_gram_texts(grams[part]), pa.array(sums[0, part]), pa.array(sums[1, part])], names=["trigram", "df", "tf"])

        for batch in batches:
            for own in batch.column(0):
                found.append(_grams(own.as_py()))
                held += len(found[-1][0])
                if held > HELD_GRAMS:
                    merge()
                    if len(grams) > HELD_GRAMS:  # very many different ones: what is held stays bounded
                        yield from out()
                        grams, sums = empty, np.zeros((2, 0), np.int64)
        merge()
        yield from out()

    return chunks.select(F.lower(F.col(text))).mapInArrow(run, "trigram string, df long, tf long")


def posting_sizes(chunks: DataFrame, text: str = "content") -> DataFrame:
    """(trigram, df, tf): how many rows of postings a trigram has, and their sum. A task adds up its own chunks' trigrams
    before anything leaves it, so what moves is as much as there are different trigrams in a task, not postings."""
    return _task_sums(chunks, text).groupBy("trigram").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def candidates(index: DataFrame, query: str, id: str = "chunk_id") -> DataFrame:
    """Ids that hold all trigrams of some token, from postings without positions; the text still has to be
    looked at."""
    out = None
    for token in dict.fromkeys(t.lower() for t in query_tokens(query)):
        grams = {token[i : i + 3] for i in range(len(token) - 2)}
        own = index.where(F.col("trigram").isin(*sorted(grams))).groupBy(id).agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(id)
        out = own if out is None else out.union(own)
    return index.select(id).limit(0) if out is None else out.distinct()
