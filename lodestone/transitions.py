"""Registered queries over the store's state transitions. Each makes a store of the conversations, applies one
transition and returns the state of chunks, vectors and files after it; its SQL says the same by set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .plans import store as S
from .plans.store import Store
from .sources.tables import scratch

KINDS = ("contextualization", "embedding")
RAW = "conv_id % 3 = 0"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.col("turn").cast("int").alias("turn")).distinct()
    return rows.select("conv_id", "turn", (F.col("conv_id") * 31 + F.col("turn")).alias("n"), path.alias("source_path"), T.chunk_id(path, F.col("turn")).alias("id"))


def _made(spark: SparkSession, d: str) -> tuple[Store, DataFrame]:
    """A store with every chunk state, and the turns that its chunks stand for."""
    turns, store = _turns(spark, d), Store(spark, scratch(spark, "store"))
    n = F.col("n")
    chunks = turns.select("id", "source_path", F.col("turn").alias("chunk_index"), F.concat(F.lit("text "), F.col("turn").cast("string")).alias("content"), (n % 6).alias("status"), (n % 4).alias("retry_count"), (n % 3 == 0).alias("is_contextualized"))
    vectors = turns.where("n % 6 = 0").select(F.col("id").alias("chunk_id"), F.lit("old").alias("model"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    conv = F.col("conv_id")
    files = turns.select("conv_id", "source_path").distinct().select("source_path", F.lit("h").alias("file_hash"), (conv % 5).alias("status"), (conv % 3).alias("chunks_raw"), (conv % 4).alias("chunks_contextualized"))
    store.commit(chunks=chunks, embeddings=vectors, file_index=files)
    return store, turns


def _state(store: Store) -> DataFrame:
    """(kind, key, status, n, note, m) of all rows."""
    none = F.lit("")
    chunks = store.table("chunks").select(F.lit("chunk").alias("kind"), F.col("id").alias("key"), "status", F.col("retry_count").alias("n"), F.concat(F.coalesce("last_error", none), F.lit("/"), F.coalesce("enriched", none)).alias("note"), F.col("is_contextualized").cast("int").alias("m"))
    vectors = store.table("embeddings").select(F.lit("vector"), "chunk_id", F.lit(0), F.lit(0), "model", F.size("embedding"))
    files = store.table("file_index").select(F.lit("file"), "source_path", "status", "chunks_pending", F.concat(F.coalesce("last_error", none), F.lit("/"), F.coalesce("last_error_stage", none)), (F.col("chunks_raw") * 100 + F.col("chunks_contextualized")).cast("int"))
    return chunks.union(vectors).union(files)


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("chunk_id"), F.lit("new").alias("model"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).cast("array<float>").alias("embedding"))


def _paths(turns: DataFrame, where: str) -> DataFrame:
    return turns.where(where).select("source_path").distinct()


def promoted(s, d):
    store, turns = _made(s, d)
    waiting = turns.where("n % 6 = 2")
    S.promote(store, _vectors(waiting.where("n % 7 <> 0")), waiting.where("n % 7 = 0").select(F.col("id").alias("chunk_id"), F.lit("rejected").alias("error")))
    return _state(store)


def settled_without_embedder(s, d):
    store, _ = _made(s, d)
    S.settle(store)
    return _state(store)


def persisted_pending(s, d):
    store, turns = _made(s, d)
    own = turns.where("conv_id % 3 = 0 and turn < 2")
    new = own.select("id", "source_path", F.col("turn").alias("chunk_index"), F.lit("new").alias("content"), (F.col("turn") == 0).alias("is_contextualized"))
    S.persist_pending(store, new, own.select("source_path").distinct().withColumn("file_hash", F.lit("g")))
    return _state(store)


def purged_paths(s, d):
    store, turns = _made(s, d)
    S.delete_paths(store, _paths(turns, "conv_id % 4 = 0"))
    return _state(store)


def replaced_files(s, d):
    store, turns = _made(s, d)
    new = turns.where("conv_id % 4 = 1 and turn = 0").select(F.concat(F.col("id"), F.lit("r")).alias("id"), "source_path", F.lit(0).alias("chunk_index"), F.lit("new").alias("content"))
    S.replace_files(store, new, _vectors(new))
    return _state(store)


def failed_files(s, d):
    store, turns = _made(s, d)
    lost = _paths(turns, "conv_id % 4 = 2").withColumn("error", F.lit("broken"))
    S.mark_files_failed(store, lost.unionByName(s.createDataFrame([("nowhere", "x")], "source_path string, error string")), "extract")
    return _state(store)


def updated_chunks(s, d):
    store, turns = _made(s, d)
    S.update_chunks(store, turns.where("n % 5 = 0").select("id"), 4, "again")
    return _state(store)


def prepared_context(s, d):
    store, _ = _made(s, d)
    S.prepare_partial(store, KINDS[0])
    return _state(store)


def prepared_embedding(s, d):
    store, _ = _made(s, d)
    S.prepare_partial(store, KINDS[1])
    return _state(store)


def contextualized_chunks(s, d):
    store, turns = _made(s, d)
    ids = turns.where("n % 6 = 5").select("id", "n")
    done = store.table("chunks").join(ids, "id").withColumn("enriched", F.lit("about")).withColumn("is_contextualized", F.col("n") % 4 != 0).withColumn("status", F.lit(2)).drop("n")
    S.contextualized(store, S.migrate(done, "chunks"))
    return _state(store)


QUERIES = {f.__name__: f for f in (promoted, settled_without_embedder, persisted_pending, purged_paths, replaced_files, failed_files, updated_chunks, prepared_context, prepared_embedding, contextualized_chunks)}

_BASE = """t AS (SELECT DISTINCT conv_id, turn::INT AS turn, conv_id * 31 + turn AS n, 'conv/' || conv_id AS p, substr(sha256('conv/' || conv_id), 1, 16) || '_' || turn AS id FROM conversations),
c AS (SELECT id, p, conv_id, turn, n, (n % 6)::INT AS status, (n % 4)::INT AS tries, '' AS err, 'text ' || turn AS enriched, (n % 3 = 0)::INT AS x FROM t),
v AS (SELECT id, 'old' AS model, 2 AS size FROM t WHERE n % 6 = 0),
f AS (SELECT DISTINCT p, conv_id, (conv_id % 5)::INT AS status, 0 AS pending, '/' AS note, ((conv_id % 3) * 100 + conv_id % 4)::INT AS m FROM t)"""


def _after(chunks: str = "c", vectors: str = "v", files: str = "f", more: str = "") -> str:
    """SQL of the state of these tables."""
    return f"""WITH {_BASE}{more}
SELECT 'chunk' AS kind, id AS key, status, tries AS n, err || '/' || enriched AS note, x AS m FROM {chunks}
UNION ALL SELECT 'vector', id, 0, 0, model, size FROM {vectors} UNION ALL SELECT 'file', p, status, pending, note, m FROM {files}"""


def _settled(chunks: str, touched: str) -> str:
    """A CTE g: files after their chunks have changed."""
    return f""", s AS (SELECT p, count(*) AS n, count(*) FILTER (WHERE status = 4) AS bad, (count(*) FILTER (WHERE status IN (2, 5)))::INT AS wait, count(*) FILTER (WHERE x = 0) AS raw FROM {chunks} WHERE p IN ({touched}) GROUP BY p),
u AS (SELECT f.*, s.wait, s.n, s.bad, CASE WHEN wait > 0 THEN 2 WHEN bad = n THEN 4 WHEN bad > 0 OR raw > 0 THEN 1 WHEN s.p IS NOT NULL THEN 0 END AS state FROM f LEFT JOIN s ON s.p = f.p),
g AS (SELECT p, coalesce(state, status)::INT AS status, coalesce(wait, pending)::INT AS pending, CASE WHEN state = 0 THEN '/' WHEN state = 4 THEN 'all ' || bad || ' chunks failed/embed' ELSE note END AS note, m FROM u)"""


_DONE = "n % 6 = 2 AND n % 7 <> 0"
_PROMOTED = f""", c1 AS (SELECT * REPLACE (CASE WHEN {_DONE} THEN 0 WHEN n % 6 = 2 THEN 4 ELSE status END AS status, CASE WHEN {_DONE} THEN 0 ELSE tries END AS tries, CASE WHEN n % 6 = 2 AND n % 7 = 0 THEN 'rejected' ELSE '' END AS err) FROM c),
v1 AS (SELECT * FROM v UNION ALL SELECT id, 'new', 3 FROM t WHERE {_DONE}){_settled("c1", "SELECT p FROM t WHERE n % 6 = 2")}"""
_EMPTY = "(SELECT * FROM v WHERE false)"

ORACLES = {
    "promoted": _after("c1", "v1", "g", _PROMOTED),
    "settled_without_embedder": _after("c1", "v", "g", f", c1 AS (SELECT * REPLACE (CASE WHEN status = 2 THEN 0 ELSE status END AS status) FROM c){_settled('c1', 'SELECT p FROM c WHERE status = 2')}"),
    "persisted_pending": _after("c1", "v1", "f1", f""", own AS (SELECT DISTINCT p FROM t WHERE {RAW} AND turn < 2),
c1 AS (SELECT * FROM c WHERE p NOT IN (SELECT p FROM own) UNION ALL SELECT id, p, conv_id, turn, n, 2, 0, '', 'new', (turn = 0)::INT FROM t WHERE {RAW} AND turn < 2),
v1 AS (SELECT v.* FROM v JOIN t ON t.id = v.id WHERE t.p NOT IN (SELECT p FROM own)),
f1 AS (SELECT * FROM f WHERE p NOT IN (SELECT p FROM own) UNION ALL SELECT p, conv_id, 2, count(*)::INT, '/', (count(*) FILTER (WHERE turn <> 0) * 100 + count(*) FILTER (WHERE turn = 0))::INT FROM t WHERE {RAW} AND turn < 2 GROUP BY p, conv_id)"""),
    "purged_paths": _after("(SELECT * FROM c WHERE conv_id % 4 <> 0)", "(SELECT v.* FROM v JOIN t ON t.id = v.id WHERE conv_id % 4 <> 0)", "(SELECT * FROM f WHERE conv_id % 4 <> 0)"),
    "replaced_files": _after("c1", "v1", "f", """, own AS (SELECT DISTINCT p FROM t WHERE conv_id % 4 = 1 AND turn = 0),
c1 AS (SELECT * FROM c WHERE p NOT IN (SELECT p FROM own) UNION ALL SELECT id || 'r', p, conv_id, turn, n, 0, 0, '', 'new', 1 FROM t WHERE conv_id % 4 = 1 AND turn = 0),
v1 AS (SELECT v.* FROM v JOIN t ON t.id = v.id WHERE t.p NOT IN (SELECT p FROM own) UNION ALL SELECT id || 'r', 'new', 3 FROM t WHERE conv_id % 4 = 1 AND turn = 0)"""),
    "failed_files": _after("c", "v", "(SELECT * REPLACE (CASE WHEN conv_id % 4 = 2 THEN 3 ELSE status END AS status, CASE WHEN conv_id % 4 = 2 THEN 'broken/extract' ELSE note END AS note) FROM f)"),
    "updated_chunks": _after("(SELECT * REPLACE (CASE WHEN n % 5 = 0 THEN 4 ELSE status END AS status, CASE WHEN n % 5 = 0 THEN tries + 1 ELSE tries END AS tries, CASE WHEN n % 5 = 0 THEN 'again' ELSE '' END AS err) FROM c)"),
    "prepared_context": _after("(SELECT * REPLACE (5 AS status, 0 AS tries, 0 AS x) FROM c)", _EMPTY, "(SELECT * REPLACE (2 AS status, 0 AS m) FROM f)"),
    "prepared_embedding": _after("(SELECT * REPLACE (2 AS status, 0 AS tries) FROM c)", _EMPTY, "(SELECT * REPLACE (2 AS status) FROM f)"),
    "contextualized_chunks": _after("c1", "v", "f1", """, c1 AS (SELECT * REPLACE (CASE WHEN n % 6 = 5 THEN 2 ELSE status END AS status, CASE WHEN n % 6 = 5 THEN 'about' ELSE enriched END AS enriched, CASE WHEN n % 6 = 5 THEN (n % 4 <> 0)::INT ELSE x END AS x) FROM c),
k AS (SELECT p, count(*) FILTER (WHERE x = 0) AS raw, count(*) FILTER (WHERE x = 1) AS done, count(*) AS wait FROM c1 WHERE n % 6 = 5 GROUP BY p),
f1 AS (SELECT f.p, status, coalesce(wait, pending)::INT AS pending, note, coalesce(raw * 100 + done, m)::INT AS m FROM f LEFT JOIN k ON k.p = f.p)"""),
}
