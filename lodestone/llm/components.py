"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every neighbour is linked with the least of the neighbourhood instead."""
    if large:
        pairs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = pairs.join(least, "a")
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root) for every node of an edge, root the least node that it reaches.
    Self-pairs and repeated pairs are ignored; an empty table gives an empty table. Work is linear in
    the edges for each round, and no group is ever gathered in one task. Rounds go on until nothing changes:
    each brings edges nearer to stars, of which there are finitely many; in practice about the logarithm of
    the longest path."""
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = _sign(edges)
    while True:
        edges = materialise(_star(_star(edges, large=True), large=False), "star")
        now = _sign(edges)
        if now == before:
            break
        before = now
    low = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(low)
