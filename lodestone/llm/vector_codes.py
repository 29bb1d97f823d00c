"""Vector code compression: each vector's parts as indexes into trained codebooks.

Components are taken as integers. A part's nearest entry has the least |c|^2 - 2 x.c; the products come from one
float32 matrix product a part, and a proven bound of its rounding error makes each of them an interval. Every entry whose
interval reaches down to the best upper end is evaluated again in int64, and the first of the least wins. So the
codes are exact, though nearly all of the work is float32.

Each round is one job over all vectors: tasks assign their parts and send one sum and count a codebook cell; what comes
to the driver is the size of the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, materialise, unused

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_BYTES = 8 << 20  # of the float32 products that are held at once
BLOCK_VALUES = 1 << 20  # components that are assigned together
#: Largest component, as an integer, whose distances and sums int64 holds; larger ones are computed as Python's integers.
FITS = 1 << 24
HOT_SHARE = 1000  # labels with over a 1000th of all rows, 1000 at most, are joined by broadcast
_LIMB = 32  # bits of a sum that travel in one row
_U = 2.0**-24  # unit roundoff of float32
LONG = (1 << 63) - 1


def kept_rows(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has numbers only."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return vectors.where(F.col(f"`{vector}`").isNotNull() & F.forall(F.col(f"`{vector}`"), usable))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: int64 where all results are at most FITS, else Python's integers."""
    wide = values.astype(np.float64)
    if not len(wide) or np.abs(wide).max() <= FITS // SCALE - 1:
        return np.floor(wide * SCALE).astype(np.int64)
    def exact(x: float) -> int:
        top, below = x.as_integer_ratio()
        return SCALE * top // below

    return np.array([exact(x) for x in wide.tolist()], dtype=object)


def matrix_of(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have that width, and their components as integers, a row each."""
    sizes = np.diff(np.asarray(lists.offsets))
    good = sizes == width
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return good, integers(flat[np.repeat(good, sizes)]).reshape(int(good.sum()), width)


def candidates(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Parts x entries: whether an entry can be nearest. x: rows x d, book: entries x d, both int64, at most FITS.

    With k terms and u the unit roundoff of float32, a product's error is at most k u / (1 - k u) times the sum of
    the sizes of its terms, in any order of summation; two more roundings a term come from taking the integers as
    float32. The sum of sizes is at most |x| |c|. Everything else is float64, whose own roundings the slack covers.
    """
    k = x.shape[1] + 3
    gamma = k * _U / (1 - k * _U)
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    square = (book * book).sum(axis=1).astype(np.float64)
    size_x = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    reach = (2 * gamma * (1 + 1e-9)) * size_x[:, None] * np.sqrt(square)
    score = square - 2 * product
    reach += 1e-14 * (square + np.abs(product))
    return score - reach <= (score + reach).min(axis=1)[:, None]


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each row of x the first of its nearest entries, exact."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64)
    if x.dtype == object or book.dtype == object:
        return np.array([min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(row, book[e], strict=True)), e)) for row in x], np.int64)
    out = np.empty(len(x), np.int64)
    step = max(1, BLOCK_BYTES // (32 * len(book)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        row, entry = np.nonzero(candidates(part, book))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = entry[first]
        many = np.flatnonzero(np.diff(np.append(first, len(row))) > 1)
        if len(many):
            again = np.isin(row, many)
            row, entry = row[again], entry[again]
            far = ((part[row] - book[entry]) ** 2).sum(axis=1)  # int64
            order = np.lexsort((entry, far, row))
            row, entry = row[order], entry[order]
            lead = np.flatnonzero(np.diff(row, prepend=-1))
            best[row[lead]] = entry[lead]
        out[a : a + step] = best
    return out


def assigned(matrix: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Vectors x parts: entry indexes. books: parts x entries x d."""
    d = books.shape[2]
    return np.stack([nearest(matrix[:, p * d : (p + 1) * d], books[p]) for p in range(len(books))], axis=1)


def errors_of(matrix: np.ndarray, books: np.ndarray, codes: np.ndarray) -> list[int]:
    parts, _, d = books.shape
    there = books[np.arange(parts), codes].reshape(len(matrix), parts * d)
    if matrix.dtype == object or books.dtype == object:
        return [min(LONG, sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(matrix, there, strict=True)]
    out = np.zeros(len(matrix), np.float64)
    gap = matrix - there
    out = (gap * gap).sum(axis=1)
    if matrix.shape[1] * (2 * FITS) ** 2 > LONG:  # many wide components: sums may pass a long
        out = np.where((gap.astype(np.float64) ** 2).sum(axis=1) > LONG * 0.99, LONG, out)
    return out.tolist()


class _Sums:
    """Sums and counts of the parts that each entry was given."""

    def __init__(self, books: np.ndarray):
        self.books = books
        parts, entries, d = books.shape
        self.counts = np.zeros(parts * entries, np.int64)
        self.sums = np.zeros((parts * entries, d), np.int64)
        self.large: dict[tuple[int, int], int] = {}

    def take(self, matrix: np.ndarray) -> None:
        parts, entries, d = self.books.shape
        cell = (assigned(matrix, self.books) + np.arange(parts) * entries).ravel()
        flat = matrix.reshape(-1, d)
        self.counts += np.bincount(cell, minlength=parts * entries)
        if matrix.dtype == object:
            for c, row in zip(cell.tolist(), flat, strict=True):
                for k, v in enumerate(row):
                    self.large[c, k] = self.large.get((c, k), 0) + int(v)
            return
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        if len(first) and d:
            self.sums[cell[order][first]] += np.add.reduceat(flat[order], first, axis=0)

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(cell, component or -1 for the count, limb, value); a number is the sum of value << (_LIMB * limb)."""
        out = [(c, -1, 0, int(self.counts[c])) for c in np.flatnonzero(self.counts).tolist()]
        for c, _, _, _ in list(out):
            for k in range(self.sums.shape[1]):
                total, limb = int(self.sums[c, k]) + self.large.get((c, k), 0), 0
                while total:
                    low = total & ((1 << _LIMB) - 1)
                    if -(1 << _LIMB) <= total < 1 << _LIMB:
                        low = total
                    if low:
                        out.append((c, k, limb, low))
                    total, limb = (total - low) >> _LIMB, limb + 1
        return out


def first_books(rows: DataFrame, id: str, vector: str, parts: int, entries: int) -> np.ndarray:
    """Codebooks from the vectors of the smallest ids, of the width of the very first: parts x entries x d.
    Rows of one id go by their vectors."""
    i, v = F.col(f"`{id}`"), F.col(f"`{vector}`")
    head = rows.where(i.isNotNull()).select(i.alias("i"), v.alias("v")).orderBy("i", "v").limit(1).collect()
    if not head:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(head[0].v)
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    some = rows.where(i.isNotNull() & (F.size(v) == width)).select(i.alias("i"), v.alias("v")).orderBy("i", "v").limit(entries).collect()
    flat = integers(np.array([x for r in some for x in r.v], np.float64)).reshape(len(some), parts, width // parts)
    return np.ascontiguousarray(flat.transpose(1, 0, 2))


def next_books(rows: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the mean of the parts nearest to it, rounded down."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(books)
        for batch in gathered(batches, max(1, BLOCK_VALUES // max(1, parts * d))):
            _, matrix = matrix_of(batch.column(0), parts * d)
            if len(matrix):
                sums.take(matrix)
        found = sums.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cell", "k", "limb", "value"])

    total = rows.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, "cell int, k int, limb int, value long").groupBy("cell", "k", "limb").agg(F.sum("value").alias("value"))
    numbers: dict[tuple[int, int], int] = {}
    for r in total.collect():  # a few numbers a codebook component, whatever the number of vectors
        numbers[r.cell, r.k] = numbers.get((r.cell, r.k), 0) + (r.value << (_LIMB * r.limb))
    out = [int(x) for x in books.ravel()]
    for (cell, k), n in numbers.items():
        if k < 0:
            for c in range(d):
                out[cell * d + c] = numbers.get((cell, c), 0) // n
    wide = any(abs(x) > FITS for x in out)
    return np.array(out, dtype=object if wide else np.int64).reshape(books.shape)


def train(rows: DataFrame, id: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(rows, id, vector, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = next_books(rows, vector, books)
    return books


def code_column(vector: Column, books: np.ndarray) -> Column:
    """(code, error) of each vector; nulls for a vector of another width."""
    parts, entries, d = books.shape
    digits = max(2, len(f"{max(0, entries - 1):x}"))

    @F.arrow_udf("code string, error long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            good, matrix = matrix_of(lists, parts * d)
            if not entries:
                good[:], matrix = False, matrix[:0]
            codes = assigned(matrix, books) if len(matrix) else np.zeros((0, parts), np.int64)
            texts = ["".join(f"{e:0{digits}x}" for e in row) for row in codes.tolist()]
            pairs = iter(zip(texts, errors_of(matrix, books, codes) if len(matrix) else [], strict=True))
            both = [next(pairs) if g else (None, None) for g in good.tolist()]
            yield pa.StructArray.from_arrays([pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.int64())], names=["code", "error"])

    return run(vector)


def digest_of(books: np.ndarray) -> str:
    return sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every row whose vector has numbers only; rows whose
    vector is null, or holds a null, a NaN or an infinity, are left out.

    The vectors of the smallest ids begin the codebooks (rows of one id by their vectors; null ids begin none but
    get codes). A vector of another width than the smallest id's gets null code and error; a width that the parts
    do not divide raises ValueError. Ties go to the lower index; an entry that no part is nearest to stays. Fewer
    vectors than entries give smaller codebooks. Components of any size are exact; an error, or a label's sum,
    beyond a long is the largest long. Null labels are one label. Repeated rows give repeated results; an empty
    table, or one without ids, gives no codes. Other columns, whatever their names, are not looked at.
    """
    rows = kept_rows(vectors, vector)
    books = train(rows, id, vector, parts, entries, rounds)
    i, e, t = (unused(x, [id]) for x in ("_code", "error", "label_error"))
    found = rows.select(F.col(f"`{id}`"), F.col(f"`{label}`").alias("_label"), code_column(F.col(f"`{vector}`"), books).alias(i))
    held = materialise(found.select(f"`{id}`", "_label", F.col(f"{i}.code").alias("code"), F.col(f"{i}.error").alias(e)), "codes")
    sums = held.groupBy("_label").agg(F.count("*").alias("_n"), F.sum(F.col(e).cast("decimal(38,0)")).alias("_sum"))
    sums = materialise(sums.select("_label", "_n", F.when(F.col("_sum") > LONG, LONG).otherwise(F.col("_sum")).cast("long").alias(t)), "labels")
    limit = sums.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_label").isNull() | (F.col("_n") * HOT_SHARE > limit)
    large, rest = sums.where(hot).withColumnRenamed("_label", "_hot"), sums.where(~hot)
    near = held.join(F.broadcast(large), F.col("_label").eqNullSafe(F.col("_hot")), "left")
    out = [f"`{id}`", "code", e, t]
    both = near.where(F.col("_n").isNotNull()).select(*out).unionByName(near.where(F.col("_n").isNull()).select(f"`{id}`", "_label", "code", e).join(rest, "_label").select(*out))
    return both.withColumn("codebooks_sha256", F.lit(digest_of(books)))
