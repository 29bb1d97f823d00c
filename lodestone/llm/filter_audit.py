"""Filter interaction audit over a packed bitmap index.

Which filters a document fails, its labels and its part become bitsets, made batch by batch inside each task: one bit a
document, the documents of a part side by side. For every filter and every set of filters that may have run before
it, AND-NOT and a population count say how many documents it removes there. A task sends its counts, 80 rows a
part; summed over tasks they give every order of the filters at once, as a step depends only on the set before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, materialise

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2  # words; percent of words; percent of characters
BATCH_ROWS = 1 << 17  # documents whose bitsets are made together
PARTS_HELD = 2000  # parts counted by a task until it sends what it has
HOT_SHARE = 1000  # texts with over a 1000th of all rows, 1000 at most, are joined by broadcast

_STEPS = [(before, f) for before in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not before >> f & 1]
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails, good, toxic) of every document; fails has a bit for each of A to D. The texts are
    read once, here, and only their digests move. A doc_id with several labels has each that any of its rows has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), words.alias("words"), upper.alias("upper"), F.length(text).alias("chars"), text.rlike(r"[#$%&*|]").alias("marked"))
    n = F.size("words")
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * n, 100 * F.col("upper") > MAX_UPPER * F.col("chars"), F.col("marked")]
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    # Rows without an id have no label; a second key deals them out.
    spread = F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(-1)
    own = read.select("doc_id", "part", "digest", bits.alias("fails"), spread.alias("deal"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("deal", F.lit(-1))
    no = F.lit(False)
    both = own.join(marks, ["doc_id", "deal"], "left")
    return both.select("doc_id", "part", "digest", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def with_copies(rows: DataFrame) -> DataFrame:
    """rows with the bit of E set where a smaller doc_id has the same text. Texts that many rows have meet their
    smallest id by broadcast, the others by shuffle."""
    groups = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "copies")
    total = rows.count()
    hot = F.col("n") * HOT_SHARE > total
    near = rows.join(F.broadcast(groups.where(hot).select("digest", "least")), "digest", "left")
    rest = near.where(F.col("least").isNull()).drop("least").join(groups.where(~hot).select("digest", "least"), "digest", "left")
    late = F.when(F.col("doc_id") > F.col("least"), 1 << 4).otherwise(0)
    out = lambda d: d.select("part", F.col("fails").bitwiseOR(late).alias("fails"), "good", "toxic")
    return out(near.where(F.col("least").isNotNull())).unionByName(out(rest))


def bitset(hits: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    """64-bit words with a bit set at each place whose row is a hit."""
    bits = np.zeros(words * 64, np.uint8)
    bits[place[hits]] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def counted(part: np.ndarray, parts: int, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Parts x steps x counts of rows whose parts are numbered; every part has a row."""
    sizes = np.bincount(part, minlength=parts)
    words = -(-sizes // 64)
    first = np.cumsum(words) - words
    order = np.argsort(part, kind="stable")
    place = np.empty(len(part), np.int64)
    place[order] = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * 64, sizes)
    total = int(words.sum())
    count = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
    every, good_, toxic_ = (bitset(x, place, total) for x in (np.ones(len(part), bool), good, toxic))
    failing = [bitset((fails >> k & 1).astype(bool), place, total) for k in range(len(FILTERS))]
    union = [np.zeros(total, np.uint64)]
    for mask in range(1, 1 << len(FILTERS)):
        low = (mask & -mask).bit_length() - 1
        union.append(union[mask & (mask - 1)] | failing[low])
    whole = len(union) - 1
    alone = [count(failing[f] & ~union[whole ^ (1 << f)]) for f in range(len(FILTERS))]
    out = np.empty((parts, len(_STEPS), len(_COUNTS)), np.int64)
    for k, (before, f) in enumerate(_STEPS):
        gone = failing[f] & ~union[before]
        columns = [every & ~union[before | 1 << f], gone, failing[f] & union[before], None, gone & good_, gone & toxic_]
        for c, bits in enumerate(columns):
            out[:, k, c] = alone[f] if bits is None else count(bits)
    return out


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        names = list(held)
        values = np.stack([held[n] for n in names]) if names else np.zeros((0, len(_STEPS), len(_COUNTS)), np.int64)
        held.clear()
        columns = [pa.array(np.repeat(np.array(names, object), len(_STEPS)), pa.string())]
        columns += [pa.array(np.tile(np.array([s[k] for s in _STEPS], np.int32), len(names))) for k in range(2)]
        columns += [pa.array(values[:, :, c].ravel()) for c in range(len(_COUNTS))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "before", "filter", *_COUNTS])

    for batch in gathered(batches, BATCH_ROWS):
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        values = counted(coded.indices.to_numpy(), len(coded.dictionary), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))
        for name, own in zip(coded.dictionary.to_pylist(), values, strict=True):
            held[name] = held[name] + own if name in held else own
        if len(held) > PARTS_HELD:
            yield flush()
    yield flush()


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, set of the filters before, filter) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            out.append(("".join(FILTERS[k] for k in order), step + 1, before, f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source; null: the empty string), order of the filters A to E and step: documents kept after it,
    removed by it, redundant (failing it, removed before), unique_fails (failing it alone), good_lost and
    toxic_lost (removed here, with that label), and shapley: what its filter removes, summed over all orders.

    A null text is empty: it fails A alone, and E where a smaller doc_id is empty too. A null doc_id has no label and
    never fails E, nor is it smaller than any; rows of one doc_id and one text do not fail E by each other, and each
    counts. Texts are judged whole, however long. An empty table gives no rows; other columns are not looked at.
    """
    rows = materialise(facts(docs, labels), "facts")
    found = with_copies(rows).mapInArrow(_audited, "part string, before int, filter int, " + ", ".join(f"{c} long" for c in _COUNTS))
    sums = found.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    # A set of k filters stands before a filter in k! (4 - k)! orders.
    times = F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))])
    weight = F.element_at(times, F.bit_count("before") + 1)
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter")))
    every = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, before int, filter int")
    return sums.join(F.broadcast(every), ["before", "filter"]).select("part", "filter_order", "step", *_COUNTS, "shapley")  # 600 rows
