"""N-gram Jaccard self-join: a size-aware heavy-light join on 5-word shingle sets.

Two texts link when 100 * |A n B| >= 80 * |A u B|. Light sets (few shingles) enumerate all subsets
of the sizes that a link needs, heavy sets scan inverted lists of the shingles that a link must share;
the boundary between them is the size up to which subsets cost less than lists. Both go through one
shuffle by list key. Frequent shingles come last in the order that picks the scanned ones, so passages
that many texts share make no long lists.

Instead of all pairs of a list, each text is first compared with the head of one of its lists: the text
that has the fewest rarer shingles, so of a group of near copies the one with the fewest changes. Texts
that are then in one component need no further comparison. In lists that still span several components,
texts outside the largest one are held against those of other components, and pairs are built only where
sizes, places and parity bitmaps (a lower bound of the symmetric difference) leave a link possible. Before
whole sets are sent to be compared, every pair must also pass bitmaps as wide as its sets are large. No link
between different texts is lost, and a group of near copies costs about one comparison a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import U64, gathered, materialise, mix, small, text_blocks, text_column, unused
from .components import components
from .shingles import node_of, shingle_sets

NUM, DEN = 4, 5  # the similarity 0.8 as a fraction
BLOCK_BYTES = 1 << 20
COUNT_TOKENS = 2 << 20  # tokens counted together before their repeats are sent on
#: The table of frequent shingles has one for each SHINGLES_EACH of the corpus, within these bounds: it is sent to
#: all tasks, 16 bytes a shingle, so 4 MB to 64 MB.
SHINGLES_EACH, FREQUENT_LEAST, FREQUENT_MOST = 4096, 1 << 18, 1 << 22
MAX_LIGHT = 16
RUN_ROWS = 1 << 14  # list rows looked at together
SHORT = 16  # lists up to this length lose at once the rows that fit no other of the list
WORDS = 8  # longs in the parity bitmap that list rows carry


def needed(a: int, b: int) -> int:
    """Least overlap of linked sets of a and b elements."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def subset_sizes(n: int) -> list[int]:
    """Overlaps that a link of a set of n elements can need, over all partner sizes."""
    return sorted({needed(n, m) for m in range(-(-NUM * n // DEN), DEN * n // NUM + 1)})


def subset_cost(n: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n))


def boundary(list_length: float) -> int:
    """Largest size whose subsets cost no more than sending and scanning its lists."""
    best = 0
    for n in range(1, MAX_LIGHT + 1):
        if subset_cost(n) > prefix_length(n) * (1 + list_length):
            break
        best = n
    return best


_BITMAP = [f"s{k}" for k in range(WORDS)]
_FACTS = ["doc_id", "node", "n", "token", "seen", *_BITMAP, "wide"]


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of elements falls to i: where bitmaps differ, so do the sets. It has
    the first power of two of bits from the set's size and from 64 * WORDS on, so that it stays telling."""
    width = 1 << (max(64 * WORDS, len(tokens)) - 1).bit_length()
    odd = np.bincount((mix(tokens) >> U64(32)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set in fewer longs."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def _id_kind(docs: DataFrame) -> str:
    """long for ids that are whole numbers; ids of any other type are compared as text."""
    return "long" if isinstance(docs.schema["doc_id"].dataType, IntegralType) else "string"


def _facts(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one partition: one for each document (node null without words), and rows (token, seen) for the
    shingles that several different sets of this partition have."""
    id_type = pa.int64() if kind == "long" else pa.string()
    schema = pa.schema([("doc_id", id_type), *((c, pa.int64()) for c in _FACTS[1:-1]), ("wide", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def repeats() -> pa.RecordBatch:
            tokens, seen = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U64), np.zeros(0, np.int64))
            tokens, seen = tokens[seen > 1].view(np.int64), seen[seen > 1]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), id_type), none, none, pa.array(tokens), pa.array(seen), *[none] * WORDS, pa.nulls(len(tokens), pa.binary())], schema=schema)

        for part, data, offsets in text_blocks(batches, "text", BLOCK_BYTES):
            sets = shingle_sets(data, offsets)
            names = [node_of(s) if len(s) else None for s in sets]
            for name, s in zip(names, sets, strict=True):
                if name is not None and name not in nodes:
                    nodes.add(name)
                    held.append(s)
                    size += len(s)
            none = pa.nulls(len(sets), pa.int64())
            wide = [_bitmap(s) for s in sets]
            maps = np.array([_folded(w, WORDS) for w in wide], dtype=np.int64).reshape(len(sets), WORDS)
            ids = part.column(part.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), none, none, *(pa.array(maps[:, k]) for k in range(WORDS)), pa.array([w.tobytes() for w in wide], pa.binary())], schema=schema)
            if size >= COUNT_TOKENS:
                yield repeats()
                held, size = [], 0
        yield repeats()

    return run


class _Order:
    """Order of shingles: those that are not frequent by hash, then the frequent ones, rarest first."""

    def __init__(self, tokens: np.ndarray, seen: np.ndarray):
        rank = np.lexsort((tokens, seen))
        order = np.argsort(tokens[rank], kind="stable")
        self.tokens, self.ranks = tokens[rank][order], order

    def first(self, own: np.ndarray, k: int) -> np.ndarray:
        if not len(self.tokens):
            return own[:k]
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        common = self.tokens[at] == own
        rare = own[~common][:k]
        if len(rare) == k:
            return rare
        late = own[common][np.argsort(self.ranks[at[common]], kind="stable")]
        return np.concatenate([rare, late[: k - len(rare)]])


_LISTED = "key long, node long, n int, pos int"


def _postings(tokens: np.ndarray, seen: np.ndarray, light: int):
    lowest = -(-NUM * (light + 1) // DEN)  # lighter sets link with light ones only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, nodes = _Order(tokens, seen), set()
        for _, data, offsets in text_blocks(batches, "text", BLOCK_BYTES):
            keys, names, sizes, places = [], [], [], []
            for own in shingle_sets(data, offsets):
                n = len(own)
                if not n or (name := node_of(own)) in nodes:
                    continue
                nodes.add(name)
                if n <= light:
                    parts = [(c, s) for c in subset_sizes(n) for s in combinations(own.tolist(), c)]
                    sums = np.array([(sum(s) + c * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for c, s in parts], dtype=U64)
                    keys.append(mix(mix(sums) + U64(1)))
                    places.append(np.zeros(len(parts), np.int32))
                if n >= lowest:
                    scanned = order.first(own, prefix_length(n))
                    keys.append(scanned)
                    places.append(np.arange(len(scanned), dtype=np.int32))
                new = sum(map(len, keys)) - sum(map(len, names))
                names.append(np.full(new, name, np.int64))
                sizes.append(np.full(new, n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (names, sizes, places))], names=["key", "node", "n", "pos"])

    return run


_RUNS = "key long, node long, n int, pos int, pivot long, pivot_n int, pivot_pos int"


def _partnered(rows: list[np.ndarray], carried: bool) -> np.ndarray:
    """Which of the rows sorted by list may link with another of their list. All rows of lists over SHORT, and
    of those that can reach beyond these rows (the last, and if carried the first), count as such."""
    key, _, n, pos = rows
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    whole = sizes > SHORT
    whole[-1] = True
    whole[0] |= carried
    keep = np.repeat(whole, sizes)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    for k in range(1, min(SHORT, len(key))):
        a, b = n[:-k], n[k:]
        fits = (key[:-k] == key[k:]) & (DEN * np.minimum(a, b) >= NUM * np.maximum(a, b))
        fits &= (NUM + DEN) * np.minimum(a - pos[:-k], b - pos[k:]) >= NUM * (a + b)
        keep[:-k] |= fits
        keep[k:] |= fits
    return keep


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, place and node: those of lists of two nodes or more, each beside the first
    of its list, its head. Holds RUN_ROWS and one row, whatever a list's length."""
    last = pivot = None
    told = False
    for batch in gathered(batches, RUN_ROWS):
        if not batch.num_rows:
            continue
        rows = [np.asarray(c) for c in batch.columns]
        if last is not None:
            rows = [np.concatenate([[v], c]) for v, c in zip(last, rows, strict=True)]
        fresh = np.ones(len(rows[0]), dtype=bool)
        fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [c[fresh] for c in rows]
        partnered = _partnered(rows, last is not None)
        rows = [c[partnered] for c in rows]
        key = rows[0]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        firsts = [c[starts] for c in rows[1:]]
        if last is not None:
            for c, v in zip(firsts, pivot, strict=True):
                c[0] = v
        keep = np.repeat(sizes > 1, sizes)
        end_told = bool(keep[-1]) or (len(key) == 1 and told)
        if last is not None and told:
            keep[0] = False
        heads = [np.repeat(c, sizes)[keep] for c in firsts]
        last, pivot, told = [c[-1] for c in rows], [c[-1] for c in firsts], end_told
        kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip([*(c[keep] for c in rows), *heads], kinds, strict=True)], names=["key", "node", "n", "pos", "pivot", "pivot_n", "pivot_pos"])


def _possible(n: Column, pos: Column, m: Column, other: Column) -> Column:
    """Whether sizes and places in the order leave enough for a link."""
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((NUM + DEN) * F.least(n - pos, m - other) >= NUM * (n + m))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in text_blocks(batches, "text", BLOCK_BYTES):
        sets = [s for s in shingle_sets(data, offsets) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n, m, left, right = batch.columns
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, size in enumerate((np.asarray(n) + np.asarray(m)).tolist()):
            x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.int64) for c in (left, right))
            words = min(len(x), len(y))
            apart = int(np.bitwise_count((_folded(x, words) ^ _folded(y, words)).view(U64)).sum())
            keep[i] = (NUM + DEN) * apart <= (DEN - NUM) * size
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = batch.columns
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(c[i].as_buffer(), dtype=U64) for c in (left, right))
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            keep[i] = (NUM + DEN) * int((y[at] == x).sum()) >= NUM * (len(x) + len(y))
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])
        del a, b, left, right, batch
        pa.default_memory_pool().release_unused()


def _beside(pairs: DataFrame, by_node: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The pairs (a, b), with columns of by_node for both nodes under the two names given for each."""
    for side, end in enumerate("ab"):
        own = by_node.select(F.col("node").alias(end), *[F.col(c).alias(names[side]) for c, names in columns.items()])
        pairs = pairs.join(own, end)
    return pairs.select("a", "b", *[names[side] for names in columns.values() for side in range(2)])


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, holders: DataFrame) -> DataFrame:
    """Those of the candidate pairs that link: bitmaps first, then exact intersection of the whole sets."""
    known = materialise(holders.join(small(_nodes(pairs)), "node", "left_semi").select("node", "doc_id", "n", "wide"), "known")
    near = materialise(_beside(pairs, known, {"n": ("n", "m"), "wide": ("left", "right")}).mapInArrow(_near, "a long, b long"), "near")
    wanted = materialise(known.select("node", "doc_id").join(small(_nodes(near)), "node", "left_semi"), "wanted")
    texts = docs.join(small(wanted.where("doc_id is not null").select("doc_id")), "doc_id", "left_semi").select("text")
    unnamed = wanted.where("doc_id is null").select("node")
    if not unnamed.isEmpty():
        # Sets that occur without an id only are found again by their names, among the rows without one.
        named = docs.where("doc_id is null").select("text", _node_column(F.col("text")).alias("node"))
        texts = texts.unionByName(named.join(small(unnamed), "node", "left_semi").select("text"))
    sets = materialise(texts.select("text").mapInArrow(_sets, "node long, tokens binary"), "sets")
    # An id or a set that several rows have brings rows beyond those wanted; any one row of a node will do.
    one = sets.dropDuplicates(["node"]) if sets.count() > wanted.count() else sets
    return _beside(near, one, {"tokens": ("left", "right")}).mapInArrow(_linked, "a long, b long")


def _spread(lists: DataFrame, roots: DataFrame, holders: DataFrame) -> DataFrame:
    """The rows of lists that hold texts of several components, with their roots, bitmaps and the root that
    most texts of the list have.

    most is the largest partner that a row's place leaves possible: x and y can link through a list only if
    neither is larger than the other's most. Of two rows larger than their own most none can be, so such a late
    row counts only beside an early one that fits it: a passage that many texts share, and that is too short
    to link any two of them, leaves no rows.
    """
    most = F.floor((DEN * F.col("n") - (NUM + DEN) * F.col("pos")) / NUM)
    named = lists.select("key", "node", "n", "pos").join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("most", most)
    early = F.col("n") <= F.col("most")
    facts = named.groupBy("key").agg(F.min(F.when(early, F.col("n"))).alias("least"), F.max(F.when(early, F.col("most"))).alias("reach"))
    fits = early | ((F.col("least") <= F.col("most")) & (F.col("reach") >= F.col("n")))
    named = materialise(named.join(facts.where("least is not null"), "key").where(fits).drop("least", "reach"), "named")
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
    return materialise(named.join(main, "key").join(holders.select("node", *_BITMAP), "node"), "spread")


def _left(spread: DataFrame) -> DataFrame:
    """Pairs (a < b) of one list and two components that sizes, places and bitmaps allow to link. Late rows
    meet early ones only, and all meet those of about their size, by what is joined on."""
    step = F.lit(float(np.log(1.3)))  # over DEN / NUM, so that rounding puts no pair two bands apart
    sized = spread.withColumn("early", F.col("n") <= F.col("most")).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step))
    partners = F.when(F.col("early"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    x = sized.where("root <> main").withColumn("wanted", F.explode(partners)).withColumn("beside", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))).alias("x")
    y = sized.alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    fits = (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _BITMAP), F.lit(0))
    near = (NUM + DEN) * apart <= (DEN - NUM) * (F.col("x.n") + F.col("y.n"))
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.wanted") == F.col("y.early")) & (F.col("x.beside") == F.col("y.band"))
    met = x.join(y, same & (F.col("x.root") != F.col("y.root")) & once & fits & near)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _rooted(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, node, n and root, the name of its component; node and root null without words."""
    kind = _id_kind(docs)
    docs = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    facts = materialise(docs.mapInArrow(_facts(kind), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _FACTS[1:-1]) + ", wide binary"), "facts")
    rows = facts.where("doc_id is not null or n is not null").select("doc_id", "node", "n")
    counted = facts.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    frequent = min(max(total // SHINGLES_EACH, FREQUENT_LEAST), FREQUENT_MOST)
    top = counted.orderBy(F.desc("seen"), "token").limit(frequent).toArrow()
    tokens, seen = np.asarray(top["token"]).view(U64), np.asarray(top["seen"])
    light = boundary(1 + float((seen.astype(float) ** 2).sum()) / max(1, total))

    listed = docs.select("text").mapInArrow(_postings(tokens, seen, light), _LISTED)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    lists = materialise(listed.repartition(parts, "key").sortWithinPartitions("key", "pos", "node").mapInArrow(_runs, _RUNS), "lists")

    named = facts.where("node is not null").groupBy("node")
    holders = materialise(named.agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ["n", *_BITMAP, "wide"]]), "holders")
    fits = _possible(F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos"))
    met = lists.where((F.col("node") != F.col("pivot")) & fits).groupBy(F.col("node").alias("b"), F.col("pivot").alias("a")).agg(F.count("*").alias("shared"))
    first = materialise(met.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), "first")
    edges = materialise(_verified(first, docs, holders), "links")
    roots = components(edges)

    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialise(_left(_spread(lists, roots, holders)).join(tried, ["a", "b"], "left_anti"), "pairs")
    if pairs.limit(1).count():
        more = materialise(_verified(pairs, docs, holders), "links")
        roots = components(edges.union(more))

    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> one row per row: doc_id, n_shingles, component_id.

    component_id is the least doc_id reachable over links, the document's own included. Null, empty and
    blank texts have no shingles and link with nothing; exact copies link with each other; texts under
    five words are one shingle; a very long text is one set, held whole by one task. Repeated rows give repeated
    results; further columns, whatever their names, are ignored; an empty table gives an empty result. Rows
    without a doc_id link like others and bear the least id of their component, null if it has none. Ids that are no whole numbers
    are compared as text. Names of sets and shingles are 64-bit hashes (chance of any false merge
    among 10^9 different texts: about 3 in 100).
    """
    rows = _rooted(docs)
    groups = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    # Written first: over an aggregate Spark does not split the tasks of a large component.
    least = materialise(groups.where("size > 1").select("root", "least"), "least")
    return rows.join(small(least), "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _node_column(text: Column) -> Column:
    """The name of a text's set, null without words."""

    def judge(data: np.ndarray, offsets: np.ndarray, _: pa.Array) -> pa.Array:
        return pa.array([node_of(s) if len(s) else None for s in shingle_sets(data, offsets)], pa.int64())

    return text_column(text, "long", lambda: judge, BLOCK_BYTES)


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component the one row with the least (doc_id, set name),
    null ids last. Rows without a set or a link stay, whatever other rows have their doc_id: null, empty and blank
    texts among them. Of rows equal in id and set one stays. Texts are compared whole, however long; an empty table
    gives an empty one; columns keep their names, whatever these are."""
    pair = [unused(c, docs.columns) for c in ("_id", "_set", "_stays", "_size")]
    rows = materialise(_rooted(docs), "rooted").where("root is not null")
    by = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    groups = rows.groupBy("root").agg(F.min(by).alias("first"), F.count("*").alias("size"))
    first = materialise(groups.where("size > 1").select("root", "first"), "first")
    linked = rows.join(small(first), "root").withColumn("stays", F.col("first.node").eqNullSafe(F.col("node")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")))
    pairs = materialise(linked.groupBy(F.col("doc_id").alias(pair[0]), F.col("node").alias(pair[1])).agg(F.first("stays").alias(pair[2]), F.count("*").alias(pair[3])), "pairs")
    name = unused("_node", docs.columns)
    named = materialise(docs.withColumn(name, _node_column(F.col("text"))), "named")
    same = F.col("doc_id").cast(_id_kind(docs)).eqNullSafe(F.col(pair[0])) & (F.col(name) == F.col(pair[1]))
    kept = named.join(small(pairs.where(~F.col(pair[2]))), same, "left_anti")
    twice = pairs.where(F.col(pair[2]) & (F.col(pair[3]) > 1))
    if twice.limit(1).count():
        # Of rows equal in id and set one stays.
        twice = small(twice)
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", name]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
