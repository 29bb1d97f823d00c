"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows form blocks. Block j of a source with weight a out of q has the release time
floor(j * q / a) and the deadline ceil((j + 1) * q / a); in every slot the released block with the earliest
deadline goes next. No prefix of the schedule then differs from the target weights by a whole block. As the
schedule repeats after q slots, only its first period is computed, and every block's slot follows from it.
When a source runs out, the others go on in the same order without gaps.

Sources of equal weight take turns, so the period is computed over different weights, however many sources
there are. Rows are numbered in buckets of a hash of their key, and all prefix sums go over buckets, then over
groups of buckets; no task sees all rows, blocks or buckets of a source. Rows are shuffled once.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import gcd, isfinite, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

BLOCK_ROWS = 64
BUCKET_ROWS = 512
HEAVY = 8 * BUCKET_ROWS  # only rows of equal keys fill a bucket beyond this; they are dealt on
GROUP = 1024  # buckets whose sums are taken together
STRETCH = 4096  # slots that are ranked together
STEP, INNER = 1 << 16, 512  # slots of a period computed by one job, and those that one array grows by
PRECISION = 1_000_000  # weights with a larger common denominator are rounded to this share of their sum
#: Target weights of the registered query; sources that are not named weigh DEFAULT_WEIGHT.
WEIGHTS = {"src0": 6, "src1": 4, "src2": 3, "src3": 2}
DEFAULT_WEIGHT = 1
ADDED = ["block", "place_in_block", "release", "deadline", "due", "slot"]

_STATE = "struct<done:array<bigint>,out:array<struct<slot:bigint,place:int,occurrence:bigint>>>"


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in the same proportions; 0 stays 0. Raises ValueError for negative or infinite weights."""
    if any(w < 0 or not isfinite(w) for w in weights):
        raise ValueError("weights must be finite and not negative")
    exact = [Fraction(str(w)) for w in weights]
    unit = lcm(*(x.denominator for x in exact))
    if unit > PRECISION:
        exact, unit = [Fraction(max(1, round(x * PRECISION / sum(exact)))) if x else x for x in exact], 1
    whole = [int(x * unit) for x in exact]
    return [w // max(1, gcd(*whole)) for w in whole]


def _facts(rows: DataFrame, weights: dict[str | None, float], default_weight: float) -> DataFrame:
    """A row for each source: its name, place in alphabetical order, weight and number of rows."""
    *named, default = whole_weights([*weights.values(), default_weight])
    counts = rows.groupBy("_name").agg(F.count("*").alias("_rows"))
    weight = F.lit(default)
    if named:
        wanted = F.array(*[F.struct(_name(F.lit(s)).alias("_name"), F.lit(w).alias("_named")) for s, w in zip(weights, named, strict=True)])
        counts = counts.join(F.broadcast(rows.sparkSession.range(1).select(F.inline(wanted))), "_name", "left")
        weight = F.coalesce("_named", weight)
    place = F.row_number().over(Window.orderBy("_name")) - 1
    facts = counts.select("_name", "_rows", weight.cast("long").alias("_weight")).where("_weight > 0").withColumn("_place", place)
    return materialise(facts.withColumn("_buckets", F.ceil(F.col("_rows") / BUCKET_ROWS)), "facts")


def _name(source: Column) -> Column:
    """A null source has a name that no other can have."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _fold(q: int, lo: int, hi: int, done: list[int]) -> str:
    """SQL over an array g of different weights (weight, m members): the earliest-deadline-first slots from lo
    up to hi, after done blocks of each. Members of a weight take turns, as all have the same windows."""
    waiting = f"transform(g, (x, k) -> named_struct('deadline', ((s.done[k] div x.m + 1) * {q}L + x.weight - 1) div x.weight, 'place', x.members[int(s.done[k] % x.m)], 'k', k, 'round', s.done[k] div x.m, 'release', s.done[k] div x.m * {q}L div x.weight))"
    pick = f"array_min(filter({waiting}, w -> w.release <= t))"
    took = f"cast(named_struct('done', transform(s.done, (d, k) -> if(k = p.k, d + 1L, d)), 'out', concat(s.out, array(named_struct('slot', t, 'place', p.place, 'occurrence', p.round)))) as {_STATE})"
    inner = f"aggregate(sequence(a, least(a + {INNER - 1}L, {hi - 1}L)), cast(named_struct('done', z.done, 'out', array()) as {_STATE}), (s, t) -> aggregate(array({pick}), s, (y, p) -> {took})"
    joined = _STATE.replace("out:array<", "out:array<array<").replace(">>>", ">>>>")
    start = f"cast(named_struct('done', array({', '.join(f'{d}L' for d in done)}), 'out', array()) as {joined})"
    return f"aggregate(sequence({lo}L, {hi - 1}L, {INNER}L), {start}, (z, a) -> {inner}, x -> cast(named_struct('done', x.done, 'out', concat(z.out, array(x.out))) as {joined})), e -> named_struct('done', e.done, 'out', flatten(e.out)))"


def period(facts: DataFrame, q: int) -> DataFrame:
    """(slot, place, occurrence): one period of earliest-deadline-first slots. Only a number for each
    different weight comes to the driver between the stretches of a long period."""
    each = facts.groupBy(F.col("_weight").alias("weight")).agg(F.array_sort(F.collect_list("_place")).alias("members"))
    groups = materialise(each.agg(F.array_sort(F.collect_list(F.struct("weight", F.size("members").cast("long").alias("m"), "members"))).alias("g")), "groups")
    done, parts = [0] * groups.select(F.size("g")).first()[0], []
    for lo in range(0, q, STEP):
        part = materialise(groups.select(F.expr(_fold(q, lo, min(q, lo + STEP), done)).alias("r")).select("r.*"), "slots")
        done = part.select("done").first().done
        parts.append(part.select(F.inline("out")))
    return reduce(DataFrame.union, parts)


def _before(counts: DataFrame, within: list[str], order: list[str], n: str, group: Column) -> DataFrame:
    """counts with _before, the sum of n over all rows that come earlier within the same keys: sums inside of
    groups of consecutive rows, and of the groups before."""
    counts = counts.withColumn("_group", group)
    inner = F.sum(n).over(Window.partitionBy(*within, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    groups = counts.groupBy(*within, "_group").agg(F.sum(n).alias("_n"))
    outer = F.sum("_n").over(Window.partitionBy(*within).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    sums = groups.withColumn("_outer", F.coalesce(outer, F.lit(0))).drop("_n")
    return counts.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(sums, [*within, "_group"]).withColumn("_before", F.col("_inner") + F.col("_outer")).drop("_inner", "_outer", "_group")


def _slots(blocks: DataFrame, slots: DataFrame, q: int) -> DataFrame:
    """(place, block) -> also due and slot, the rank of due among all blocks."""
    due = F.expr(f"block div _weight * {q}L") + F.col("at")
    one = slots.select(F.col("place").alias("_place"), F.col("occurrence").alias("_turn"), F.col("slot").alias("at"))
    dated = blocks.withColumn("_turn", F.expr("block % _weight")).join(small(one), ["_place", "_turn"]).select("_place", "block", due.alias("due"))
    dated = materialise(dated.withColumn("_stretch", F.expr(f"due div {STRETCH}")), "dated")
    counts = _before(dated.groupBy("_stretch").agg(F.count("*").alias("_size")), [], ["_stretch"], "_size", F.expr(f"_stretch div {STRETCH}"))
    rank = F.row_number().over(Window.partitionBy("_stretch").orderBy("due")) - 1
    ranked = dated.withColumn("_rank", rank).join(counts.select("_stretch", "_before"), "_stretch")
    return ranked.select("_place", "block", "due", (F.col("_rank") + F.col("_before")).alias("slot"))


def schedule(docs: DataFrame, weights: dict[str | None, float], default_weight: float = DEFAULT_WEIGHT, block_rows: int = BLOCK_ROWS, source: str = "source", key: str = "doc_id") -> DataFrame:
    """All rows and columns of docs, each once, with block, place_in_block, release, deadline, due (the
    block's slot if no source ran out: release <= due < deadline) and slot (its place among the blocks
    that exist).

    Rows of a source are numbered by md5 of their key, then by key; rows of equal or null key in any order.
    Weights may be fractions; a source of weight 0 takes no part, so its rows are left out; negative weights
    raise ValueError. A null source is a source of its own, named None in weights. Repeated rows are rows like
    others; texts are not looked at; an empty table gives an empty result; columns named like the added ones
    are replaced. Any number of sources and any sum of weights will do; time for the period grows with the sum.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    h = F.coalesce(F.md5(F.col("_row")[key].cast("string").cast("binary")), F.lit(""))
    rows = rows.withColumn("_name", _name(F.col("_row")[source])).withColumn("_h", h)
    facts = _facts(rows.select("_name"), weights, default_weight)
    q = facts.agg(F.sum("_weight")).first()[0]
    if not q:
        return docs.limit(0).select("*", *[F.lit(None).cast("long").alias(c) for c in ADDED])
    share = F.coalesce(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double"), F.lit(0.0)) / float(1 << 32)
    rows = rows.join(small(facts.select("_name", "_place", "_buckets")), "_name")
    rows = rows.withColumn("_bucket", F.floor(share * F.col("_buckets"))).withColumn("_part", F.lit(0)).drop("_name", "_buckets")
    counts = materialise(rows.groupBy("_place", "_bucket", "_part").agg(F.count("*").alias("_size")), "counts")
    order = ["_h", F.col("_row")[key]]
    heavy = counts.where(F.col("_size") > HEAVY).select("_place", "_bucket", F.ceil(F.col("_size") / BUCKET_ROWS).alias("_parts"))
    if not heavy.isEmpty():
        # Rows of equal keys cannot be told apart, so they get numbers, which are written before they are used.
        rows = materialise(rows.withColumn("_number", F.monotonically_increasing_id()), "numbered").join(small(heavy), ["_place", "_bucket"], "left")
        rows = rows.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_number"), "_parts"), F.lit(0))).drop("_parts")
        counts = materialise(rows.groupBy("_place", "_bucket", "_part").agg(F.count("*").alias("_size")), "counts")
        order.append("_number")

    buckets = _before(counts, ["_place"], ["_bucket", "_part"], "_size", F.expr(f"_bucket div {GROUP}"))
    buckets = materialise(buckets.join(small(facts.select("_place", "_weight")), "_place"), "buckets")
    end = F.expr(f"(_before + _size - 1) div {block_rows}")
    first = F.expr(f"_before div {block_rows}")
    # A block belongs to the bucket that its first row is in, and reaches into those after it.
    own = buckets.where(F.expr(f"(_before + {block_rows - 1}) div {block_rows} <= (_before + _size - 1) div {block_rows}"))
    blocks = own.select("_place", "_weight", F.explode(F.sequence(F.expr(f"(_before + {block_rows - 1}) div {block_rows}"), end)).alias("block"))
    placed = _slots(blocks, period(facts, q), q)
    reached = buckets.select("_place", "_bucket", "_part", F.explode(F.sequence(first, end)).alias("block")).join(placed, ["_place", "block"])
    listed = reached.groupBy("_place", "_bucket", "_part").agg(F.array_sort(F.collect_list(F.struct("block", "due", "slot"))).alias("_blocks"))
    facts_of = materialise(buckets.join(listed, ["_place", "_bucket", "_part"]).select("_place", "_bucket", "_part", "_before", "_weight", "_blocks"), "listed")

    inner = F.row_number().over(Window.partitionBy("_place", "_bucket", "_part").orderBy(*order)) - 1
    out = rows.withColumn("_inner", inner).join(facts_of, ["_place", "_bucket", "_part"])
    out = out.withColumn("_at", F.col("_before") + F.col("_inner")).withColumn("block", F.expr(f"_at div {block_rows}"))
    out = out.withColumn("_own", F.expr("_blocks[int(block - _blocks[0].block)]"))
    values = [F.col("block"), F.expr(f"_at % {block_rows}"), F.expr(f"block * {q}L div _weight"), F.expr(f"((block + 1) * {q}L + _weight - 1) div _weight"), F.col("_own.due"), F.col("_own.slot")]
    return out.select("_row.*", *[v.cast("long").alias(c) for v, c in zip(values, ADDED, strict=True)])


def mixed(docs: DataFrame, weights: dict[str | None, float], **options) -> DataFrame:
    """The rows of docs in the order of the schedule, with their own columns only."""
    return schedule(docs, weights, **options).orderBy("slot", "place_in_block").select(*docs.columns)
