"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, and the shards take
turns claiming their next free slot. A row's key is hashed to a slot; the table is broadcast, so placement
takes constant time and needs no shuffle, and few rows move when a shard joins or leaves.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537  # prime; the broadcast table has this many rows whatever the input
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _number(name: str, use: str) -> int:
    return int.from_bytes(blake2b(name.encode(), digest_size=8, person=use.encode()).digest(), "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> np.ndarray:
    """Slot -> index into shards. A shard of weight w takes w turns a round; the order of names in the
    list does not matter. Raises ValueError for repeated names, too few slots or a size that is not prime."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size or not is_prime(size):
        raise ValueError("distinct shards and a prime number of slots, at least one a shard, are needed")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    turns = {i: max(1, (weights or {}).get(shards[i], 1)) for i in order}
    skip = {i: _number(shards[i], "skip") % (size - 1) + 1 if size > 2 else 1 for i in order}
    at = {i: _number(shards[i], "offset") % size for i in order}
    table = [-1] * size
    left = size
    while True:
        for i in order:
            for _ in range(turns[i]):
                slot, step = at[i], skip[i]
                while table[slot] >= 0:
                    slot = (slot + step) % size
                table[slot] = i
                at[i] = (slot + step) % size
                left -= 1
                if not left:
                    return np.array(table)


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 60 bits of md5 over the key as text, modulo the table's size; a null key is like an empty one."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % size).cast("int")


def assign(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """All columns and rows of docs, with slot (int) and shard (string); columns of these names are replaced. A
    null key is placed like an empty one; equal keys and repeated rows go to one
    shard, so a key should be as fine as rows. Texts are not looked at, however long; an empty table gives an
    empty result. Ties cannot arise: every slot has one shard."""
    shards = SHARDS if shards is None else shards
    table = lookup_table(shards, size, weights)
    lookup = docs.sparkSession.createDataFrame([(k, shards[i]) for k, i in enumerate(table.tolist())], "slot int, shard string")
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    return rows.join(F.broadcast(lookup), "slot").select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")], "slot", "shard")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder a shard. Rows of a shard may come from several tasks, so no task holds a whole one."""
    assign(docs, **options).drop("slot").write.partitionBy("shard").parquet(path)
