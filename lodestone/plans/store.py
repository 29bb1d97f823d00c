"""Versioned snapshots of a knowledge base in buckets, and the state transitions over them.

Chunks, vectors and file states lie in buckets by a hash of source_path, one Parquet folder a bucket. A commit writes
new folders for the buckets that it touches and then creates the next version file, which must not exist yet and
names a folder for every bucket; the greatest whole version file is current. Nothing is ever replaced by a commit,
so readers stay on the version they opened and a crash leaves the last one. What a commit costs is the size of the
touched buckets, whatever the size of the store; their number doubles as the store grows, by a commit of its own.
The version file has also the metadata pairs, each bucket's counters and the segments of the text index.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_hash
from ..operators import textindex as T
from ..schema import LAYOUT, TABLES, migrate

VERSIONS, LEASES = "versions", "leases"
KEPT_VERSIONS = 10  # of a vacuum, beside leased ones
KEYED = ("chunks", "embeddings", "file_index")
HASHES = 1 << 16  # values of the hash; a bucket is a range of them
FEWEST, MOST = 16, HASHES  # buckets
CHUNKS_A_BUCKET = 4096  # aimed at; buckets double once there are twice as many
ROWS_A_FILE = 50_000  # chunks of one source file that one task writes
_ID = re.compile(r"([0-9a-f]{16})_\d+")
#: Counters of a bucket, as SQL over its rows.
_OF_CHUNKS = {"chunks": "count(*)", "pending_embedding": "count_if(status = 2)", "pending_contextualization": "count_if(status = 5)", "odd_ids": "count_if(not coalesce(id rlike concat('^', substr(sha2(source_path, 256), 1, 16), '_[0-9]+$'), false))"}
_OF_FILES = {"files": "count(*)", "ready": "count_if(status = 0)", "degraded": "count_if(status = 1)", "partially_deferred": "count_if(status = 2)", "needs_action": "count_if(status = 3)", "failed": "count_if(status = 4)", "chunks_raw": "coalesce(sum(chunks_raw), 0)", "chunks_contextualized": "coalesce(sum(chunks_contextualized), 0)", "degraded_files": "count_if(chunks_raw > 0)", "last_indexed": "coalesce(unix_micros(max(indexed_at)), 0)"}

COUNTERS = tuple(k for k in (_OF_CHUNKS | _OF_FILES) if k not in ("odd_ids", "last_indexed"))


def bucket_of(path: Column, buckets: int) -> Column:
    return F.floor(path_hash(path) / (HASHES // buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version = 0
        self._take({})
        self.refresh()

    def _take(self, found: dict) -> None:
        self.places: dict[str, str] = found.get("tables", {})
        self.buckets: int = found.get("buckets", FEWEST)
        self.keyed: dict[str, dict[int, str]] = {name: {b: folder for folder, own in found.get("keyed", {}).get(name, {}).items() for b in own} for name in KEYED}
        self.counters: dict[str, dict[int, list[int]]] = {kind: {int(b): c for b, c in found.get("counters", {}).get(kind, {}).items()} for kind in ("chunks", "files")}
        self.metadata: dict[str, str] = found.get("metadata", {})
        self.index: dict = found.get("index") or T.EMPTY
        self.layout: int = found.get("layout", LAYOUT)

    def _said(self) -> dict:
        keyed: dict[str, dict[str, list[int]]] = {}
        for name, own in self.keyed.items():
            for b, folder in sorted(own.items()):
                keyed.setdefault(name, {}).setdefault(folder, []).append(b)
        return {"tables": self.places, "buckets": self.buckets, "keyed": keyed, "counters": self.counters, "metadata": self.metadata, "index": self.index, "layout": self.layout}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _numbers(self) -> list[int]:
        """Version numbers that have a file, greatest first."""
        folder = self._path(VERSIONS)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n))), reverse=True)

    def _read(self, number: int) -> dict | None:
        """A version file; None while its writer is at it, or if the writer died there."""
        stream = self._fs.open(self._path(f"{VERSIONS}/v{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def refresh(self) -> None:
        for number in self._numbers():
            if number == self.version:
                return
            if found := self._read(number):
                self._take(found)
                self.version = number
                return

    def table(self, name: str) -> DataFrame:
        """The table as of this version, in the current layout."""
        if name == "index_metadata":
            return self.spark.createDataFrame(sorted(self.metadata.items()), TABLES[name])
        return self.part(name, None)

    def part(self, name: str, buckets: Iterable[int] | None) -> DataFrame:
        """The rows of a table in some buckets; only their folders are looked at."""
        if name in self.places:  # as a whole: failures, and tables of a store from before there were buckets
            rows = migrate(self.spark.read.parquet(f"{self.root}/{self.places[name]}"), name)
            return rows if buckets is None or name not in KEYED else rows.where(bucket_of(F.col("source_path"), self.buckets).isin(list(buckets)))
        own = self.keyed.get(name, {})
        folders = [f"{self.root}/{own[b]}/{name}/b={b}" for b in (sorted(own) if buckets is None else buckets) if b in own]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        if self.layout != LAYOUT:
            return migrate(self.spark.read.parquet(*folders), name)
        return self.spark.read.schema(TABLES[name]).parquet(*folders)

    def touched(self, paths: DataFrame) -> list[int]:
        """The buckets of some source_paths, which a commit is about to write."""
        if self._old():
            self.spread(0)
        return sorted(r[0] for r in paths.select(bucket_of(F.col("source_path"), self.buckets)).distinct().collect())

    def paths_of(self, ids: DataFrame, id: str = "id") -> DataFrame:
        """(source_path) of the files that chunks with these ids belong to; reads ids and paths only."""
        return self.table("chunks").select("id", "source_path").join(ids.select(F.col(id).alias("id")), "id", "left_semi").select("source_path").distinct()

    def near(self, ids: Iterable[str]) -> DataFrame:
        """The part of the chunks that some ids can be in. An id begins with the hash of its path; where chunks
        came with ids of their own, that is all of them."""
        found = [_ID.fullmatch(i or "") for i in ids]
        if not all(found) or "chunks" in self.places or self.count("odd_ids"):
            return self.table("chunks")
        return self.part("chunks", sorted({int(m[1][:4], 16) // (HASHES // self.buckets) for m in found}))

    def count(self, name: str) -> int:
        """A counter over all buckets, without a look at any table."""
        kind, names = ("chunks", list(_OF_CHUNKS)) if name in _OF_CHUNKS else ("files", list(_OF_FILES))
        own = [c[names.index(name)] for c in self.counters[kind].values()]
        return max(own, default=0) if name == "last_indexed" else sum(own)

    @property
    def counted(self) -> bool:
        """Whether the version has counters, as every one has that was written in buckets."""
        return not any(name in self.places for name in KEYED)

    @property
    def last_indexed(self) -> datetime | None:
        at = self.count("last_indexed")
        return datetime.fromtimestamp(at / 1e6, UTC).replace(tzinfo=None) if at else None

    def _write(self, folder: str, name: str, rows: DataFrame, buckets: int) -> list[int]:
        """Rows by bucket and id, with Bloom filters on ids; the buckets that have any. A file of very many chunks is
        written by several tasks."""
        key = {"chunks": "id", "embeddings": "chunk_id", "file_index": "source_path"}[name]
        place = F.col("chunk_index") if name == "chunks" else F.coalesce(F.substring_index("chunk_id", "_", -1).try_cast("int"), F.lit(0)) if name == "embeddings" else F.lit(0)
        out = migrate(rows, name).withColumn("b", bucket_of(F.col("source_path"), buckets)).withColumn("_part", F.floor(place / ROWS_A_FILE))
        where = f"{self.root}/{folder}/{name}"
        out.repartition("b", "_part").sortWithinPartitions("b", key).drop("_part").write.partitionBy("b").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", 2 * CHUNKS_A_BUCKET).parquet(where)
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{folder}/{name}"))]
        return sorted(int(n[2:]) for n in names if n.startswith("b="))

    def _count(self, folder: str, name: str, found: list[int]) -> dict[int, list[int]]:
        if not found:
            return {}
        what = _OF_CHUNKS if name == "chunks" else _OF_FILES
        base = f"{self.root}/{folder}/{name}"
        rows = self.spark.read.schema(f"{TABLES[name]}, b int").option("basePath", base).parquet(*[f"{base}/b={b}" for b in found])
        return {r[0]: [int(x) for x in r[1:]] for r in rows.groupBy("b").agg(*[F.expr(v).alias(k) for k, v in what.items()]).collect()}

    def commit(self, buckets: Iterable[int] | None = None, index: dict | None = None, **tables: DataFrame) -> int:
        """Replace tables together: chunks, embeddings and file_index in the given buckets, or as a whole; vectors
        without source_path are looked up by their chunks. A commit over a version that is no longer current is
        refused: creating a file that must not exist decides between two writers."""
        if self.read_only:
            raise PermissionError("the store was opened for reading")
        own = [name for name in KEYED if name in tables]
        if own and self._old():
            tables = {name: tables[name] if name in tables else self._whole(name) for name in KEYED}
            own, buckets = list(KEYED), None
        touched = None if buckets is None else list(buckets)
        self._write_all(own, touched, tables)
        for name in tables.keys() - set(KEYED) - {"index_metadata"}:
            self.places[name] = f"v{self.version + 1}-{uuid.uuid4().hex[:8]}/{name}"
            migrate(tables[name], name).write.parquet(f"{self.root}/{self.places[name]}")
        if "index_metadata" in tables:
            self.metadata = {r.key: r.value for r in tables["index_metadata"].select("key", "value").collect()}
        if index is not None:
            self.index = index
        number = self._publish()
        if "chunks" in own and self.count("chunks") > 2 * CHUNKS_A_BUCKET * self.buckets and self.buckets < MOST:
            number = self.spread(self.count("chunks"))
        return number

    def _old(self) -> bool:
        """Whether rows are from before there were buckets, or of another layout, and are to be laid out anew."""
        return self.layout != LAYOUT or not self.counted

    def _whole(self, name: str) -> DataFrame:
        rows = self.table(name)
        return rows.drop("source_path") if name == "embeddings" and self._old() else rows

    def _write_all(self, own: list[str], touched: list[int] | None, tables: dict[str, DataFrame]) -> None:
        """Write the tables and take note of where; nothing is current before _publish."""
        folder = f"v{self.version + 1}-{uuid.uuid4().hex[:8]}"
        keyed, places, counters = dict(self.keyed), dict(self.places), dict(self.counters)
        for name in own:
            rows = tables[name]
            if name == "embeddings" and "source_path" not in rows.columns:
                chunks = tables.get("chunks", self.part("chunks", touched))
                rows = rows.join(chunks.select(F.col("id").alias("chunk_id"), "source_path"), "chunk_id", "left")
            found = self._write(folder, name, rows, self.buckets) if touched is None or touched else []
            kept = {} if touched is None else {b: f for b, f in keyed[name].items() if b not in set(touched)}
            keyed[name] = kept | dict.fromkeys(found, folder)
            places.pop(name, None)
            if name != "embeddings":
                kind = "chunks" if name == "chunks" else "files"
                old = {} if touched is None else {b: c for b, c in counters[kind].items() if b not in set(touched)}
                counters[kind] = old | self._count(folder, name, found)
        self.keyed, self.places, self.counters = keyed, places, counters
        if own:
            self.layout = LAYOUT

    def _publish(self) -> int:
        """Create the next version file. When another writer was first, this store goes back to its version."""
        try:
            numbers = self._numbers()
            seen = next((n for n in numbers if self._read(n)), 0)
            if seen != self.version:
                raise RuntimeError(f"version {seen} was committed meanwhile")
            number = max([*numbers[:1], self.version]) + 1  # beyond a file that a dead writer left
            try:
                out = self._fs.create(self._path(f"{VERSIONS}/v{number}.json"), False)
            except Py4JJavaError as e:
                raise RuntimeError(f"version {number} was committed meanwhile") from e
        except RuntimeError:
            self._take((self._read(self.version) or {}) if self.version else {})
            raise
        out.write(bytearray(json.dumps({"version": number, **self._said()}).encode()))
        out.close()
        self.version = number
        return number

    def spread(self, chunks: int) -> int:
        """As many buckets as a store of that many chunks should have, never fewer than now. All rows move, so an
        indexing run calls it once, before its first commit."""
        wanted = self.buckets
        while wanted < MOST and wanted * CHUNKS_A_BUCKET < chunks:
            wanted *= 2
        if self.read_only or wanted == self.buckets and not self._old():
            return self.version
        tables = {name: self._whole(name) for name in KEYED if self.keyed[name] or name in self.places}
        self.buckets = wanted
        self._write_all(list(tables), None, tables)
        return self._publish()

    def lease(self, seconds: float, now: float | None = None) -> str:
        """Have vacuum() keep this version for some time; returns the lease's name."""
        name = f"{LEASES}/{uuid.uuid4().hex}.json"
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(json.dumps({"version": self.version, "expires": (time.time() if now is None else now) + seconds}).encode()))
        out.close()
        return name

    def release(self, lease: str) -> None:
        self._fs.delete(self._path(lease), False)

    def _listed(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def vacuum(self, keep: int = KEPT_VERSIONS, now: float | None = None) -> int:
        """Remove what neither the last versions nor a leased one names: version files, buckets and index segments.
        Leases that have run out go as well. What a writer is at has a later number and stays. Returns the number of
        folders and version files removed."""
        if self.read_only:
            raise PermissionError("the store was opened for reading")
        self.refresh()
        numbers, leased, gone = self._numbers(), set(), 0
        for name in self._listed(LEASES):
            said = json.loads(self._text(f"{LEASES}/{name}") or "{}")
            if said.get("expires", 0) > (time.time() if now is None else now):
                leased.add(said["version"])
            else:
                self.release(f"{LEASES}/{name}")
        whole = [n for n in numbers if n <= self.version and self._read(n)]
        kept = set(whole[: max(1, keep)]) | (leased & set(whole))
        named: set[str] = set()
        for n in kept:
            found = self._read(n)
            named |= set(found["tables"].values()) | {f"{folder}/{name}/b={b}" for name, own in found.get("keyed", {}).items() for folder, all_ in own.items() for b in all_}
            index = found.get("index") or T.EMPTY
            named |= {s["folder"] for s in index["segments"]} | {index["dead"]}
        above = {p[:i] for p in named if p for i, c in enumerate(p) if c == "/"}

        def cleared(folder: str) -> None:
            nonlocal gone
            for name in self._listed(folder):
                path = f"{folder}/{name}"
                if path in above:
                    cleared(path)
                elif path not in named and "=" in name or path not in named and "/" not in folder:
                    self._fs.delete(self._path(path), True)
                    gone += 1

        for n in numbers:
            if n < self.version and n not in kept:
                self._fs.delete(self._path(f"{VERSIONS}/v{n}.json"), False)
                gone += 1
        for name in self._listed(""):
            if (m := re.fullmatch(r"v(\d+)-[0-9a-f]{8}", name)) and int(m[1]) <= self.version:
                if name in above:
                    cleared(name)
                else:
                    self._fs.delete(self._path(name), True)
                    gone += 1
        for name in self._listed("index"):
            if (m := re.match(r"s(\d+)-", name)) and int(m[1]) < self.index["next"] and f"index/{name}" not in named:
                self._fs.delete(self._path(f"index/{name}"), True)
                gone += 1
        return gone


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def with_paths(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors (chunk_id, model, embedding) as rows of the table embeddings, with the files of their chunks."""
    own = vectors if "source_path" in vectors.columns else vectors.join(chunks.select(F.col("id").alias("chunk_id"), "source_path"), "chunk_id", "left")
    return migrate(own, "embeddings")


def delete_paths(store: Store, paths: DataFrame) -> int:
    """Purge files: their chunks, vectors and state."""
    paths = paths.select("source_path").distinct()
    touched = store.touched(paths)
    return store.commit(touched, **{name: store.part(name, touched).join(paths, "source_path", "left_anti") for name in KEYED})


def replace_files(store: Store, chunks: DataFrame, vectors: DataFrame | None = None) -> int:
    """Replace all chunks of the files that occur in chunks; no rows change nothing."""
    paths, new = chunks.select("source_path").distinct(), migrate(chunks, "chunks")
    touched = store.touched(paths)
    if not touched:
        return store.version
    old, left = (store.part(name, touched).join(paths, "source_path", "left_anti") for name in ("chunks", "embeddings"))
    if vectors is not None:
        left = migrate(left, "embeddings").unionByName(with_paths(vectors, new))
    return store.commit(touched, chunks=old.select(*new.columns).unionByName(new), embeddings=left)


def persist_pending(store: Store, chunks: DataFrame, hashes: DataFrame) -> int:
    """First commit: chunks wait for vectors, their files are partially deferred."""
    new = migrate(chunks.withColumn("status", F.lit(2)), "chunks")
    paths = new.select("source_path").distinct()
    touched = store.touched(paths)
    counted = new.groupBy("source_path").agg(F.count_if(~F.col("is_contextualized")).cast("int").alias("chunks_raw"), F.count_if("is_contextualized").cast("int").alias("chunks_contextualized"), F.count("*").cast("int").alias("chunks_pending"))
    facts = [c for c in ("file_hash", "size", "modified") if c in hashes.columns]
    files = counted.join(hashes.select("source_path", *facts), "source_path").withColumn("status", F.lit(2)).withColumn("indexed_at", F.current_timestamp())
    old, vectors = (store.part(name, touched).join(paths, "source_path", "left_anti") for name in ("chunks", "embeddings"))
    return store.commit(touched, chunks=old.select(*new.columns).unionByName(new), embeddings=vectors, file_index=upsert(store.part("file_index", touched), migrate(files, "file_index"), "source_path"))


def _settled(files: DataFrame, chunks: DataFrame, touched: DataFrame) -> DataFrame:
    """files with the state that their chunks say: ready, degraded if a chunk is raw or failed, failed if all
    are, deferred while some still wait. Only files of touched (source_path) change."""
    state = chunks.join(touched, "source_path", "left_semi").groupBy("source_path").agg(F.count("*").alias("_n"), F.count_if(F.col("status") == 4).alias("_failed"), F.count_if(F.col("status").isin(2, 5)).cast("int").alias("_wait"), F.count_if(~F.col("is_contextualized")).alias("_raw"))
    status = F.when(F.col("_wait") > 0, 2).when(F.col("_failed") == F.col("_n"), 4).when((F.col("_failed") > 0) | (F.col("_raw") > 0), 1).otherwise(0)
    new = files.join(state.withColumn("_status", status), "source_path", "left")
    lost = F.col("_status") == 4
    error = F.when(F.col("_status") == 0, F.lit(None)).when(lost, F.concat(F.lit("all "), F.col("_failed").cast("string"), F.lit(" chunks failed"))).otherwise(F.col("last_error"))
    stage = F.when(F.col("_status") == 0, F.lit(None)).when(lost, F.lit("embed")).otherwise(F.col("last_error_stage"))
    return new.withColumn("status", F.coalesce("_status", "status")).withColumn("chunks_pending", F.coalesce("_wait", "chunks_pending")).withColumn("last_error", error).withColumn("last_error_stage", stage).select(*files.columns)


def promote(store: Store, vectors: DataFrame, failed: DataFrame | None = None) -> int:
    """Second commit: chunks with a vector become indexed, those in failed (chunk_id, error) fail, and their
    files follow. Where both name their files (source_path), no other id is looked at."""
    bad = failed if failed is not None else store.spark.createDataFrame([], "chunk_id string, source_path string, error string")
    if all("source_path" in x.columns for x in (vectors, bad)):
        paths = vectors.select("source_path").union(bad.select("source_path"))
    else:
        paths = store.paths_of(vectors.select("chunk_id").union(bad.select("chunk_id")), "chunk_id")
    touched = store.touched(paths.distinct())
    chunks, files = store.part("chunks", touched), store.part("file_index", touched)
    done = vectors.select(F.col("chunk_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    marked = chunks.join(done, "id", "left").join(bad.select(F.col("chunk_id").alias("id"), F.col("error").alias("_error")).withColumn("_bad", F.lit(True)), "id", "left")
    good, wrong = F.coalesce("_done", F.lit(False)), F.coalesce("_bad", F.lit(False))
    out = marked.withColumn("status", F.when(good, 0).when(wrong, 4).otherwise(F.col("status"))).withColumn("retry_count", F.when(good, 0).otherwise(F.col("retry_count"))).withColumn("last_error", F.when(good, F.lit(None)).when(wrong, F.col("_error")).otherwise(F.col("last_error")))
    changed = marked.where(good | wrong).select("source_path").distinct()
    out = out.select(*chunks.columns)
    old = migrate(store.part("embeddings", touched).join(vectors.select("chunk_id"), "chunk_id", "left_anti"), "embeddings")
    return store.commit(touched, chunks=out, embeddings=old.unionByName(with_paths(vectors, chunks)), file_index=_settled(files, out, changed))


def settle(store: Store, ids: DataFrame | None = None) -> int:
    """Files of the chunks in ids (id) follow their chunks. Without ids all chunks that wait for vectors are
    indexed as they are, as there is nothing that embeds them."""
    if ids is not None:
        paths = store.paths_of(ids)
        touched = store.touched(paths)
        return store.commit(touched, file_index=_settled(store.part("file_index", touched), store.part("chunks", touched), paths))
    paths = store.table("chunks").where("status = 2").select("source_path").distinct()
    touched = store.touched(paths)
    chunks, files = store.part("chunks", touched), store.part("file_index", touched)
    changed = chunks.where("status = 2").select("source_path").distinct()
    new = chunks.withColumn("status", F.when(F.col("status") == 2, 0).otherwise(F.col("status")))
    return store.commit(touched, chunks=new, file_index=_settled(files, new, changed))


def mark_files_failed(store: Store, failed: DataFrame, stage: str, status: int = 3) -> int:
    """Files of failed (source_path, error) get that status; those not in the index change nothing. Returns the
    number of files marked."""
    touched = store.touched(failed)
    files = store.part("file_index", touched)
    hits = files.select("source_path").join(failed, "source_path").groupBy("source_path").agg(F.min("error").alias("_error"))
    n = hits.count()
    if n:
        own = F.col("_error").isNotNull()
        new = files.join(hits, "source_path", "left").withColumn("status", F.when(own, status).otherwise(F.col("status"))).withColumn("last_error", F.coalesce("_error", "last_error")).withColumn("last_error_stage", F.when(own, F.lit(stage)).otherwise(F.col("last_error_stage")))
        store.commit(touched, file_index=new.select(*files.columns))
    return n


def update_chunks(store: Store, ids: DataFrame, status: int, error: str | None = None) -> int:
    """New status for ids (id), which may name their files (source_path); every update counts as one more try."""
    touched = store.touched(ids.select("source_path").distinct() if "source_path" in ids.columns else store.paths_of(ids))
    chunks = store.part("chunks", touched)
    marked = chunks.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return store.commit(touched, chunks=marked.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("last_error", F.when(hit, F.lit(error)).otherwise(F.col("last_error"))).withColumn("retry_count", F.when(hit, F.col("retry_count") + 1).otherwise(F.col("retry_count"))).select(*chunks.columns))


def prepare_partial(store: Store, kind: str) -> int:
    """Before embedding or contextualizing all again: vectors go, chunks and files wait."""
    chunks, files = store.table("chunks"), store.table("file_index")
    again = kind == "contextualization"
    new = chunks.withColumn("status", F.lit(5 if again else 2)).withColumn("retry_count", F.lit(0)).withColumn("last_error", F.lit(None).cast("string"))
    if again:
        new = new.withColumn("enriched", F.col("content")).withColumn("is_contextualized", F.lit(False))
        files = files.withColumn("chunks_raw", F.lit(0)).withColumn("chunks_contextualized", F.lit(0))
    none = store.spark.createDataFrame([], TABLES["embeddings"])
    return store.commit(chunks=new, embeddings=none, file_index=files.withColumn("status", F.lit(2)))


def contextualized(store: Store, done: DataFrame) -> int:
    """Chunks with new enriched text (rows of the table chunks) replace the old ones and wait for vectors; the
    counters of their files are taken again."""
    touched = store.touched(done.select("source_path").distinct())
    chunks, files = store.part("chunks", touched), store.part("file_index", touched)
    counted = done.groupBy("source_path").agg(F.count_if(~F.col("is_contextualized")).cast("int").alias("_raw"), F.count_if("is_contextualized").cast("int").alias("_context"), F.count("*").cast("int").alias("_wait"))
    new = files.join(counted, "source_path", "left").withColumn("chunks_raw", F.coalesce("_raw", "chunks_raw")).withColumn("chunks_contextualized", F.coalesce("_context", "chunks_contextualized")).withColumn("chunks_pending", F.coalesce("_wait", "chunks_pending"))
    return store.commit(touched, chunks=upsert(chunks, done, "id"), file_index=new.select(*files.columns))


def refresh_index(store: Store) -> int:
    """Bring the text index up to the chunks. Only buckets that were written since are compared; chunks that are new
    or changed go into one new segment, together with those of segments that are not much larger, and what no longer
    holds is marked dead in the others."""
    now = {str(b): f for b, f in store.keyed["chunks"].items()}
    seen = store.index["buckets"] if store.index["of"] == store.buckets else {}
    stale = sorted({int(b) for b in now.keys() | seen.keys() if now.get(b) != seen.get(b)}) if seen else None
    width = HASHES // store.buckets
    ranges = None if stale is None else [(b * width, (b + 1) * width - 1) for b in stale]
    read = lambda buckets: store.part("chunks", buckets).select(F.col("id").alias("chunk_id"), path_hash(F.col("source_path")).alias("ph"), F.coalesce("enriched", "content").alias("content"))
    index = T.refreshed(store.spark, store.root, store.index, read(stale), ranges, lambda hashes: read(sorted({h // width for h in hashes})))
    return store.commit(index=index | {"buckets": now, "of": store.buckets})


def index_is_current(store: Store) -> bool:
    now = {str(b): f for b, f in store.keyed["chunks"].items()}
    return bool(store.index["of"]) and store.index["of"] == store.buckets and store.index["buckets"] == now


def set_metadata(store: Store, values: dict[str, str | None]) -> int:
    """Upsert; None deletes a key. The pairs are in the version file, so no table is written."""
    store.metadata = {k: v for k, v in (store.metadata | values).items() if v is not None}
    return store.commit()


def metadata(store: Store) -> dict[str, str]:
    return dict(store.metadata)
