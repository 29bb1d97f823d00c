"""BPE encoding and decoding by segment trees over adjacent pair ranks.

A text is normalised and cut into words; no merge crosses their edges. The leaf at a place of a word holds the
rank of the pair that begins there, with the place behind it, and every inner node the least of its two
children: the root is the leftmost merge of lowest rank. A merge changes three leaves at most, so it costs
three paths to the root; it goes on until the root says that no pair can be merged. The new short words of a block
have trees of one size, in one array, and take their merges side by side; a long word has a tree of its own.
Ids of words that were seen before are looked up by the word itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import path as public_path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, struct_array, text_column
from .pieces import found

#: Vocabulary file of a public tokenizer, as an example of the parameter.
MODEL = public_path("word_bpe_49k.json")
WORDS_KEPT_BYTES = 96 << 20  # of words remembered by a worker, counted with their ids
STRETCH = 1 << 18  # characters that are cut into words at a time
WIDE = 64  # symbols; longer words have a tree of their own
TREES_BYTES = 8 << 20  # of trees that take their merges together
_WORD_COST = 160  # bytes of a remembered word beside its characters and ids
_NONE = (1 << 62) - 1

# The word pattern and the normalisation that the vocabulary's file names.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# Ranges where the libraries' editions of Unicode agree in letters, digits, cases and compositions.
_SAFE = r"[^\u0000-ԯḀ-⁰　-鿿가-힣]"

# The same pattern for texts of Latin letters, with the classes written out: the plain module is quicker.
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^ \t\n\r\f\v\x85\xa0a-zªµºß-öø-ɏ0-9²³¹¼-¾]+")
_BEYOND_LATIN = re.compile("[^\0-ɏ]")

_WORDS = regex.compile(_PATTERN)
_UNSAFE = regex.compile(_SAFE)
_SPACE = regex.compile(r"[ \t\n]")


def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others
    for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """Ranks and results of the pairs of a vocabulary, and the trees that apply them."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.size = max(vocab.values(), default=0) + 1
        rows = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in rows], np.int64)
        results = np.array([vocab[a + b] for a, b in rows], np.int64)
        self.result = results
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.rank_of = {k: r for r, k in reversed(list(enumerate(keys.tolist())))}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none; a negative symbol pairs with nothing."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        rank = self.ranks_of(left, right)
        return np.where(rank >= 0, rank * width + place, _NONE)

    def merge_many(self, symbols: np.ndarray) -> np.ndarray:
        """Words x width symbols, -1 behind a word's end; width is a power of two. The same after all merges, the
        symbols that are left in order with -1 between them."""
        n, width = symbols.shape
        symbols = symbols.copy()
        if width == 1 or not n or not len(self.keys):
            return symbols
        place = np.arange(width)
        after = np.broadcast_to(place + 1, (n, width)).copy()  # width: the end
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:-1] = self.leaves(symbols[:, :-1], symbols[:, 1:], place[:-1], width)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            rank, at = np.divmod(tree[live, 1], width)
            gone = after[live, at]
            behind = after[live, gone]
            symbols[live, at], symbols[live, gone] = self.result[rank], -1
            after[live, at] = behind
            inner = behind < width
            before[live[inner], behind[inner]] = at[inner]
            next_ = np.where(inner, symbols[live, np.minimum(behind, width - 1)], -1)
            first = before[live, at]
            there = np.maximum(first, 0)
            tree[live, width + gone] = _NONE
            tree[live, width + at] = self.leaves(symbols[live, at], next_, at, width)
            ahead = self.leaves(symbols[live, there], symbols[live, at], there, width)
            tree[live, width + there] = np.where(first >= 0, ahead, tree[live, width + there])
            for leaf in (gone, at, there):
                node = (leaf + width) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < _NONE]
        return symbols

    def merge_one(self, symbols: list[int]) -> list[int]:
        """A word of any length."""
        n = len(symbols)
        width = 1 << max(1, (n - 1).bit_length())
        symbols = symbols + [-1] * (width - n)
        after, before = list(range(1, width + 1)), list(range(-1, width - 1))
        tree = [_NONE] * (2 * width)

        def leaf(at: int) -> int:
            other = after[at]
            rank = self.rank_of.get(symbols[at] * self.size + symbols[other]) if other < n else None
            return _NONE if rank is None else rank * width + at

        tree[width : width + n] = [leaf(k) for k in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < _NONE:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            symbols[at], symbols[gone] = int(self.result[rank]), -1
            after[at] = after[gone]
            if after[gone] < width:
                before[after[gone]] = at
            tree[width + gone], tree[width + at] = _NONE, leaf(at)
            changed = [gone, at]
            if before[at] >= 0:
                tree[width + before[at]] = leaf(before[at])
                changed.append(before[at])
            for k in changed:
                k = (k + width) >> 1
                while k:
                    tree[k] = min(tree[2 * k], tree[2 * k + 1])
                    k >>= 1
        return [s for s in symbols if s >= 0]


class WordBpe:
    """A vocabulary of byte-level BPE with word ends, and the words that were met with their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        model, normal, cut = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        split, level = [*cut.get("pretokenizers", []), {}, {}][:2]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not (plain and [x["type"] for x in normal.get("normalizers", [])] == _NORMALIZERS and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex") and not spec.get("decoder")):
            raise ValueError("this vocabulary needs another normalisation, word pattern or decoder")
        vocab = model["vocab"]
        self.merges = Merges(vocab, model["merges"])
        suffix = model["end_of_word_suffix"] or ""
        self.names = byte_names()
        self.inner = np.array([vocab[c] for c in self.names], np.int64)
        self.last = np.array([vocab[c + suffix] for c in self.names], np.int64)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("this vocabulary has added tokens that look at what is around them")
        self.special = special
        longest = sorted(special, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        n = max([*vocab.values(), *special.values()]) + 1
        names = [""] * n
        for name, i in [*vocab.items(), *special.items()]:
            names[i] = name
        self.texts, self.numbers = Surface([x.encode() for x in names]), Surface([b"%d" % i for i in range(n)])
        self._raw, self._library = raw, None
        self._forget()

    def _forget(self) -> None:
        self.rows = {s: k for k, s in enumerate(self.special)}
        self.ids, self.counts = np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64)
        self.first = np.arange(len(self.special), dtype=np.int64)
        self.bytes = 0

    def words(self, text: str) -> Iterator[list[str]]:
        """The normalised words of a text, in order, by stretches; an added token's own string is one word."""
        start = 0
        while start < len(text):
            space = _SPACE.search(text, start + STRETCH) if len(text) - start > STRETCH else None
            stop = space.start() if space else len(text)
            parts = self.parts.split(text[start:stop]) if self.parts else [text[start:stop]]
            for k, part in enumerate(parts):
                if part:
                    yield [part] if k % 2 else self._cut(part)
            start = stop

    def _cut(self, part: str) -> list[str]:
        if part.isascii():
            return _LATIN_WORDS.findall(part.lower())
        if _UNSAFE.search(part) is None:
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # each letter for itself
            return (_WORDS if _BEYOND_LATIN.search(plain) else _LATIN_WORDS).findall(plain)
        if self._library is None:  # characters that editions of Unicode differ in: words as the tokenizer's own edition has them
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._raw)
            self._byte = {c: b for b, c in enumerate(self.names)}
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part))
        return [bytes(self._byte[c] for c in w).decode() for w, _ in found]

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words that are not known."""
        by_width: dict[int, list[bytes]] = {}
        names: dict[int, list[str]] = {}
        for w in words:
            raw = w.encode()
            width = 1 << (len(raw) - 1).bit_length() if len(raw) <= WIDE else 0
            by_width.setdefault(width, []).append(raw)
            names.setdefault(width, []).append(w)
        all_ids, all_counts = [self.ids], [self.counts]
        for width, raws in by_width.items():
            if not width:
                merged = [np.array(self.merges.merge_one([*self.inner[list(r[:-1])].tolist(), int(self.last[r[-1]])]), np.int32) for r in raws]
                all_ids += merged
                all_counts.append(np.array([len(x) for x in merged], np.int64))
                continue
            step = max(1, TREES_BYTES // (48 * width))
            for k in range(0, len(raws), step):
                some = raws[k : k + step]
                size = np.array([len(r) for r in some])
                data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in some), np.uint8).reshape(-1, width)
                symbols = np.where(np.arange(width) < size[:, None], self.inner[data], -1)
                symbols[np.arange(len(some)), size - 1] = self.last[data[np.arange(len(some)), size - 1]]
                out = self.merges.merge_many(symbols)
                all_ids.append(out[out >= 0].astype(np.int32))
                all_counts.append((out >= 0).sum(axis=1))
        known = len(self.counts)
        for group in names.values():
            self.rows.update(zip(group, range(known, known + len(group)), strict=True))
            known += len(group)
        self.ids, self.counts = np.concatenate(all_ids), np.concatenate(all_counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.bytes += sum(4 * len(w) + _WORD_COST for w in words)

    def ids_of(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of words one after the other, and the n+1 offsets of the lists."""
        new = set().union(*lists).difference(self.rows)
        if new:
            if self.bytes > WORDS_KEPT_BYTES:
                self._forget()
                new = set().union(*lists).difference(self.rows)
            self.learn(new)
        sizes = [len(x) for x in lists]
        row = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(lists)), np.int64, sum(sizes))
        counts = self.counts[row]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(ends[-1]) + np.repeat(self.first[row] - ends[:-1], counts)
        return self.ids[at], ends[np.concatenate([[0], np.cumsum(sizes)])]


class Surface:
    """Strings of all ids, to be joined by one blank."""

    def __init__(self, names: list[bytes]):
        spaced = [x + b" " for x in names]
        self.raw = np.frombuffer(b"".join(spaced), np.uint8)
        self.sizes = np.array([len(x) for x in spaced], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """One string for each stretch of ids, every id with its blank behind it."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.raw[np.arange(ends[-1]) + np.repeat(self.first[ids] - ends[:-1], sizes)].tobytes()
        at = ends[cuts].tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


class _Digest:
    """SHA-256 of strings that come with a blank behind each, without the last blank."""

    def __init__(self):
        self.hash, self.held = sha256(), b""

    def take(self, raw: bytes) -> None:
        if raw:
            self.hash.update(self.held)
            self.hash.update(raw[:-1])
            self.held = b" "

    @property
    def hex(self) -> str:
        return self.hash.hexdigest()


_ENCODED = "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """The columns in keep, then ids (array<int>), n_tokens, ids_sha256 (of the decimal ids joined by one blank)
    and decoded_sha256 (of what the ids decode to, in UTF-8).

    A null text gives null ids and the digests of an empty one; an empty text, or one of white space, has no ids.
    Added tokens of the vocabulary are ids wherever their strings stand in a text. A text is encoded whole,
    however long; words are cut stretch by stretch, and one unbroken word takes some hundred times its bytes.
    Of equal ranks the leftmost pair merges first. Repeated rows give repeated results; an empty table gives an
    empty one; a column in keep named like a new one is replaced, whatever its case. The file is opened on the
    executors, unless pieces.ship has sent it with the job.
    """

    def start():
        bpe = load(found(model))

        def judge(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> pa.Array:
            n = len(texts)
            ids: list[np.ndarray] = []
            counts = np.zeros(n, np.int64)
            numbers, back = [_Digest() for _ in range(n)], [_Digest() for _ in range(n)]
            held: list[list[str]] = []
            owners: list[int] = []

            def flush() -> None:
                if held:
                    some, cuts = bpe.ids_of(held)
                    ids.append(some)
                    np.add.at(counts, owners, np.diff(cuts))
                    for k, a, b in zip(owners, bpe.numbers.joined(some, cuts), bpe.texts.joined(some, cuts), strict=True):
                        numbers[k].take(a)
                        back[k].take(b)
                held.clear()
                owners.clear()

            waiting = 0
            for k, text in enumerate(texts):
                for words in bpe.words(text.as_py() or ""):
                    held.append(words)
                    owners.append(k)
                    waiting += len(words)
                    if waiting > STRETCH // 4:
                        flush()
                        waiting = 0
            flush()
            cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])), mask=pa.array(np.asarray(texts.is_null())))
            return struct_array({"ids": lists, "n_tokens": pa.array(counts), "ids_sha256": pa.array([d.hex for d in numbers], pa.string()), "decoded_sha256": pa.array([d.hex for d in back], pa.string())})

        return judge

    return beside(docs, keep, text_column(F.col("text"), _ENCODED, start, 1 << 19), _ENCODED)


def decode_ids(df: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """The columns in keep, and text: the tokens of the column ids joined by one blank, as the vocabulary has no decoder.

    Null ids stay null, no ids give an empty text; ids outside the vocabulary and null ids of a list are left
    out. A list is decoded whole, however long; repeated rows give repeated texts and an empty table an empty
    one. A column in keep named text is replaced.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = load(found(model)).texts
        for lists in batches:
            out = []
            for x in lists:
                ids = np.array([i for i in x.as_py() if i is not None and 0 <= i < len(names.sizes)], np.int64) if x.is_valid else None
                out.append(None if ids is None else names.joined(ids, np.array([0, len(ids)]))[0][:-1].decode())
            yield pa.array(out, pa.string())

    return beside(df, keep, F.struct(run("ids").alias("text")), "text string")
