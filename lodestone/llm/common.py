"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

U64 = np.uint64

try:
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim, _LIBC.mallopt  # noqa: B018
except (AttributeError, OSError):  # another C library
    _LIBC = None
# Parameters of mallopt: freed memory over so many bytes goes back at the end of the heap; larger arrays are mapped alone.
_M_TRIM, _M_MMAP = (-1, 2 << 20), (-3, 1 << 20)
#: A side of a few longs or short strings a row is broadcast up to this count, joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark runs in
    one process (tests), a temporary folder that is then set for the session; on a cluster RuntimeError, as
    every machine would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows of whole texts are large, so what readers, writers and Arrow hold at once is counted in fewer of them.
#: With Spark's own settings an executor's heap fills up with such buffers, whatever its size.
LEAN = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "parquet.block.size": 16 << 20}


def lean(spark: SparkSession) -> SparkSession:
    """Set LEAN for the session; smaller values that it has already stay."""
    for name, most in LEAN.items():
        now = re.sub(r"\D", "", str(spark.conf.get(name, None) or ""))
        if not now or int(now) > most:
            spark.conf.set(name, str(most))
    return spark


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, and what was
    written survives the loss of any executor. The files go when the session's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its row count, taken here, is within BROADCAST_ROWS."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lean(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str = "doc_id", folds: int = 5):
    """crc32 of the key as text, modulo the number of folds; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is held out; one without an id is not, nor does anything learn from it."""
    return F.coalesce(fold_of(key) == 0, F.lit(False))


def window_of(text: Column, chars: int) -> Column:
    """The text itself, or of a longer one so many characters from anywhere in it, by a hash of the text."""
    last = F.greatest(F.length(text) - chars, F.lit(0))
    return F.substring(text, F.pmod(F.xxhash64(text, F.lit("window")), last + 1).cast("int") + 1, F.lit(chars))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), element by element."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(31)
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def give_back() -> None:
    """Hand freed memory back to the system. Workers live on from task to task and would keep the most that
    any block ever took."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.mallopt(*_M_TRIM)
        _LIBC.mallopt(*_M_MMAP)
        _LIBC.malloc_trim(0)


def blocks_of(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut texts into stretches of about max_bytes (one longer text stays whole). Yields begin and end of
    each, its texts as one byte array and the n+1 offsets into it; null is empty."""
    ends, raw = offsets_of(texts), texts.buffers()[2]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1)
        offsets = ends[start : stop + 1]
        data = np.frombuffer(raw or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        yield start, stop, data, (offsets - offsets[0]).astype(np.int64)
        start = stop
    give_back()


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """blocks_of a column of Arrow batches, each with its part of the batch."""
    for batch in batches:
        for start, stop, data, offsets in blocks_of(batch.column(batch.schema.get_field_index(column)), max_bytes):
            yield batch.slice(start, stop - start), data, offsets


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of narrow rows, put together to so many rows or a few more; the last has what is left."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


#: From a block's bytes, its offsets and the texts themselves to the results, one for each text.
Judge = Callable[[np.ndarray, np.ndarray, pa.Array], pa.Array]


def text_column(text: Column, kind: str, start: Callable[[], Judge], max_bytes: int = 2 << 20) -> Column:
    """A column computed from whole texts by Arrow batches. Only the text goes to Python and only the result
    comes back; all other columns stay where they are. start is called once in each task."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = start()
        for texts in batches:
            parts = [judge(data, offsets, texts.slice(a, b - a)) for a, b, data, offsets in blocks_of(texts, max_bytes)]
            yield pa.concat_arrays(parts) if parts else judge(np.zeros(0, np.uint8), np.zeros(1, np.int64), texts)

    return run(text)


def struct_array(columns: dict[str, pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def beside(rows: DataFrame, keep: list[str], result: Column, kind: str) -> DataFrame:
    """The columns in keep, then the fields of a struct column of that kind ("name type, ..."). A column in
    keep that is named like a field, upper and lower case being the same, is replaced by it."""
    new = {f.split()[0].lower() for f in kind.split(", ")}
    names = [c for c in dict.fromkeys(keep) if c.lower() not in new]
    kept, own = [F.col(f"`{c}`") for c in names], unused("_result", names)
    return rows.select(*kept, result.alias(own)).select(*kept, f"{own}.*")


def unused(name: str, names: list[str]) -> str:
    """The name, or the first with more underscores that no column has."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
