"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (runs of blanks with the word after them; no piece crosses their edges)
are joined into one text, whose suffixes are sorted up to the length of the longest piece. A binary
search of every piece then gives the range of suffixes that it begins: all its occurrences. These edges
are sorted by position and relaxed: an edge enters the lattice if the piece that reaches its start and
the edge's own piece stay as they are when byte-pair merging sees them side by side. For merge-based
models exactly one such path reaches each position, and it is the model's own segmentation.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, beside, mix, struct_array, text_column, texts_of

BLANK = "▁"
#: Vocabulary file of a public tokenizer, as an example of the parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENTS_KEPT = 600_000  # segmentations remembered by a worker: about 25 MB
PAIRS_KEPT = 250_000
LONG = 64  # bytes; longer segments are relaxed one by one
BLOCK_BYTES = 1 << 18  # text whose new segments are indexed together; the index takes some hundred times its bytes
_SEP = 0xFF

_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x8CB92BA72F3D8DD7))
_PLACE = mix(np.arange(1, 4097, dtype=U64) * U64(0xAEF17502108EF2D9)) | U64(1)


class Pieces:
    """A merge-based SentencePiece vocabulary with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.byte = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.scores = {self.names[i]: model.get_score(i) for i in range(n) if i not in special}
        self.ids = {self.names[i]: i for i in range(n) if i not in special}
        if model.normalize(" a  ﬁ") != BLANK + BLANK + "a" + BLANK * 2 + "ﬁ" or len(self.byte) != 256 or any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("this model needs other normalisation, has no byte fallback or has pieces across words")
        self.chars = {c for p in self.ids for c in p}
        surface = [b"" if i in special and not model.is_byte(i) else bytes([int(self.names[i][3:5], 16)]) if model.is_byte(i) else self.names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.widths = np.array([len(s) for s in surface])
        self.offsets = np.concatenate([[0], np.cumsum(self.widths)[:-1]])
        # The search runs over UTF-8 with a plain blank for U+2581: shorter, and a text's own U+2581 means the same.
        self.find = sorted((self.names[i].replace(BLANK, " ").encode(), i) for i in self.ids.values())
        self.inside = np.zeros((256, 256), dtype=bool)  # byte pairs that some piece holds
        for b, _ in self.find:
            own = np.frombuffer(b, np.uint8)
            self.inside[own[:-1], own[1:]] = True
        self.inside[:, 0x80:0xC0] = True
        self.byte_ids = np.array([self.byte[b] for b in range(256)], np.int32)
        self.pairs: dict[int, bool] = {}
        self.whole = np.full(n, -1, np.int8)
        short = [(b, i) for b, i in self.find if len(b) <= 8]
        self.short = tuple(np.array(x, t) for x, t in (([int.from_bytes(b.ljust(8, b"\0"), "big") for b, _ in short], U64), ([int.from_bytes(b.ljust(8, b"\xff"), "big") for b, _ in short], U64), ([i for _, i in short], np.int64)))
        self.long = [(b, i) for b, i in self.find if len(b) > 8]
        self.heads = np.array([int.from_bytes(b[:8], "big") for b, _ in self.long], U64)

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair merging of a short string, best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, piece: int) -> bool:
        """Whether merging a piece's own characters gives that piece."""
        if self.whole[piece] < 0:
            name = self.names[piece]
            self.whole[piece] = self.merge(name) == [name]
        return bool(self.whole[piece])

    def beside(self, left: int, right: int) -> bool:
        """Whether both pieces stay as they are when merging sees them side by side."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            a, b = self.names[left], self.names[right]
            found = self.pairs[key] = a + b not in self.scores and self.stands(left) and self.stands(right) and self.merge(a + b) == [a, b]
        return found

    def occurrences(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and ids of every occurrence of every piece in a text."""
        n = len(raw)
        tail = np.concatenate([raw, np.zeros(8, np.uint8)])
        key = np.zeros(n, U64)
        for k in range(8):
            key |= tail[k : k + n].astype(U64) << U64(8 * (7 - k))
        levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # width, sorted keys, suffixes, their ranks

        def deeper() -> None:
            """Sort the suffixes by their first 8 bytes, or by twice the width sorted by so far."""
            width, by = 8, key
            if levels:
                width, _, _, rank = levels[-1]
                by = (rank[:n].astype(U64) << U64(32)) | (rank[np.minimum(np.arange(n) + width, n)] + 1).astype(U64)
                width *= 2
            order = np.argsort(by)
            ordered = by[order]
            rank = np.empty(n + 1, np.int64)
            rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            rank[n] = -1
            levels.append((width, ordered, order, rank))

        def span(piece: bytes, level: int) -> tuple[int, int]:
            """The range of suffixes, in the order of a level, that begin with a piece."""
            while len(levels) <= level:
                deeper()
            _, ordered, _, _ = levels[level]
            if level == 0:
                low, high = (int.from_bytes(piece.ljust(8, fill), "big") for fill in (b"\0", b"\xff"))
            else:
                half, _, before, ranks = levels[level - 1]
                a, b = span(piece[:half], level - 1)
                c, d = span(piece[half:], level - 1) if len(piece) > half else (0, 1)
                if a == b or c == d:
                    return 0, 0
                low, high = int(ranks[before[a]]) << 32, int(ranks[before[b - 1]]) << 32 | 0xFFFFFFFF
                if len(piece) > half:  # then a to b is one rank
                    low, high = low | int(ranks[before[c]]) + 1, low | int(ranks[before[d - 1]]) + 1
            return int(np.searchsorted(ordered, U64(low), "left")), int(np.searchsorted(ordered, U64(high), "right"))

        deeper()
        _, ordered, order, _ = levels[0]
        lows, highs = np.searchsorted(ordered, self.short[0], "left"), np.searchsorted(ordered, self.short[1], "right")
        counts = highs - lows
        index = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lows, counts)
        where, which = [order[index]], [np.repeat(self.short[2], counts)]
        at = np.minimum(np.searchsorted(ordered, self.heads), n - 1)
        for k in np.flatnonzero(ordered[at] == self.heads).tolist():
            piece, i = self.long[k]
            level = (len(piece) - 1).bit_length() - 3
            a, b = span(piece, level)
            if a < b:
                where.append(levels[level][2][a:b])
                which.append(np.full(b - a, i))
        return np.concatenate(where), np.concatenate(which)

    def segment(self, raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after the other, and their number for each. raw holds the segments,
        each with a separator behind it; no piece crosses their edges."""
        n = len(raw)
        starts, ids = self.occurrences(raw)
        lead = (raw & 0xC0) != 0x80
        chars = np.flatnonzero(lead & (raw != _SEP))
        wide = np.diff(np.append(np.flatnonzero(lead), n))[np.searchsorted(np.flatnonzero(lead), chars)]
        size_at = np.zeros(n, np.int64)
        size_at[chars] = wide
        width = self.widths[ids]
        single = np.zeros(n, dtype=bool)
        single[starts[width == size_at[starts]]] = True
        alone = chars[~single[chars]]  # characters outside the vocabulary: bytes, which merge with nothing
        starts, ids, width = np.concatenate([starts, alone]), np.concatenate([ids, np.full(len(alone), -2)]), np.concatenate([width, size_at[alone]])
        base = np.repeat(begin, sizes + 1)
        large = np.repeat(sizes > LONG, sizes + 1)
        came, origin = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int64)
        reached = np.zeros(n + 1, dtype=bool)
        reached[begin] = True
        few = ~large[starts]
        local = (starts - base[starts])[few].astype(np.uint8)
        order = np.argsort(local, kind="stable")
        cut = np.searchsorted(local[order], np.arange(LONG + 1))
        s, p, w = starts[few][order], ids[few][order], width[few][order]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            live = a + np.flatnonzero(reached[s[a:b]])
            if not len(live):
                continue
            self._enter(s[live], p[live], w[live], came, origin, reached)
        long_order = np.flatnonzero(~few)
        long_order = long_order[np.argsort(starts[long_order], kind="stable")]
        edges = zip(starts[long_order].tolist(), ids[long_order].tolist(), width[long_order].tolist(), strict=True)
        for at, piece, size in edges:
            if reached[at] and (piece < 0 or (self.stands(piece) if came[at] < 0 else self.beside(int(came[at]), piece))):
                came[at + size], origin[at + size], reached[at + size] = piece, at, True
        return self._paths(raw, begin, sizes, came, origin)

    def _enter(self, s: np.ndarray, p: np.ndarray, w: np.ndarray, came: np.ndarray, origin: np.ndarray, reached: np.ndarray) -> None:
        before = came[s].astype(np.int64)
        unsure = np.unique(p[(p >= 0) & (self.whole[p] < 0)])
        for piece in unsure.tolist():
            self.stands(piece)
        good = (p < 0) | (self.whole[p] == 1)
        check = np.flatnonzero(good & (p >= 0) & (before >= 0))
        if len(check):
            keys, back = np.unique(before[check] << 32 | p[check], return_inverse=True)
            known = self.pairs.get
            fits = np.array([f if (f := known(k)) is not None else self.beside(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], dtype=bool)
            good[check] = fits[back]
        end = (s + w)[good]
        came[end], origin[end], reached[end] = p[good], s[good], True

    def _paths(self, raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray, came: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow all segments from their ends to their begins, one piece of each at a time."""
        at, which = begin + sizes, np.arange(len(begin))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(begin), np.int64)
        rest = np.zeros(len(begin), np.int64)  # bytes left of a character outside the vocabulary
        while True:
            on = at > begin[which]
            at, which, rest = at[on], which[on], rest[on]
            if not len(at):
                break
            piece, source = came[at], origin[at]
            if (stuck := (rest == 0) & (source < 0)).any():
                raise ValueError(f"no segmentation reaches the end of segment {which[stuck][0]}")
            starting = (rest == 0) & (piece == -2)
            rest = np.where(starting, at - source, rest)
            as_byte = rest > 0
            ids = np.where(as_byte, self.byte_ids[raw[at - 1]], piece)
            at = np.where(as_byte, at - 1, source)
            rest = np.maximum(rest - 1, 0)
            steps.append((which, ids))
            counts[which] += 1
        total = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(total[-1], np.int32)
        last = total[1:].copy()
        for which, ids in steps:
            last[which] -= 1
            out[last[which]] = ids
        return out, counts

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts of id sequences that stand one after the other, without the blank put before each."""
        sizes = self.widths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends[:-1], sizes)
        raw = self.surface[at].tobytes()
        cuts = ends[offsets]
        return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file with the job, where executors have no such path; returns the model's new name."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def found(model: str) -> str:
    return model if os.path.isabs(model) else SparkFiles.get(model)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts, remembering the ids of segments by a 64-bit hash of their bytes. Whether the ids
    decode to the text would show a false match of hashes (for 10^6 segments about 1 in 10^8)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.counts, self.first = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the n+1 offsets of the texts."""
        sizes = np.diff(offsets)
        full = sizes > 0
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lead = np.cumsum(full)  # a blank is put before each text that is not empty
        raw = np.full(len(data) + int(lead[-1]), 32, np.uint8)
        raw[np.arange(len(data)) + np.repeat(lead, sizes)] = data
        begins = (offsets[:-1] + lead - 1)[full]
        fresh = np.empty(len(raw), dtype=bool)
        np.logical_not(self.pieces.inside[raw[:-1], raw[1:]], out=fresh[1:])
        fresh[begins] = True
        starts = np.flatnonzero(fresh)
        lengths = np.diff(np.append(starts, len(raw)))
        index = self._lookup(raw, starts, lengths)
        own = self.counts[index]
        total = np.concatenate([[0], np.cumsum(own)])
        at = np.arange(total[-1]) + np.repeat(self.first[index] - total[:-1], own)
        cuts = np.zeros(len(offsets), np.int64)
        cuts[1:][full] = total[np.searchsorted(starts, np.append(begins[1:], len(raw)))]
        return self.ids[at], np.maximum.accumulate(cuts)

    def _lookup(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Row numbers, in the table of known segments, of the segments of a text."""
        global _PLACE
        if lengths.max() > len(_PLACE):
            _PLACE = mix(np.arange(1, int(lengths.max()) + 1, dtype=U64) * U64(0xAEF17502108EF2D9)) | U64(1)
        value = _BYTE[raw]
        value *= _PLACE[np.arange(len(raw)) - np.repeat(starts, lengths)]
        hashes, one, back = np.unique(np.add.reduceat(value, starts) + lengths.astype(U64), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > SEGMENTS_KEPT:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        there = np.zeros(len(hashes), dtype=bool)
        inner = at < len(self.hashes)
        there[inner] = self.hashes[at[inner]] == hashes[inner]
        rows = np.empty(len(hashes), np.int64)
        rows[there] = self.rows[at[there]]
        new = np.flatnonzero(~there)
        if len(new):
            s, n = starts[one[new]], lengths[one[new]]
            begin = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
            text = np.full(int((n + 1).sum()), _SEP, np.uint8)
            spread = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            text[spread + np.repeat(begin, n)] = raw[spread + np.repeat(s, n)]
            ids, counts = self.pieces.segment(text, begin, n)
            rows[new] = len(self.counts) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            merged = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(merged)
            self.hashes, self.rows = merged[order], np.concatenate([self.rows, rows[new]])[order]
        return rows[back]


_ENCODED = "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_texts(docs: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """The columns in keep, then ids (array<int>), n_tokens, ids_sha256 (of the ids as little-endian
    32-bit numbers), decoded_sha256 and round_trip (the ids decode to the text's own bytes).

    A null text gives null ids, zero tokens and a true round trip; an empty text gives no ids; a text is
    encoded whole, however long. U+2581 in a text means a blank to this kind of model, so it decodes as one
    and round_trip is false. Among pieces of equal score the leftmost merges first. Repeated rows give
    repeated results; an empty table gives an empty one; a column in keep named like a new one is replaced.
    The vocabulary file is opened on the executors unless ship() has sent it with the job.
    """

    def start():
        coder = Encoder(load(found(model)))

        def judge(data: np.ndarray, offsets: np.ndarray, whole: pa.Array) -> pa.Array:
            texts = texts_of(data, offsets)
            blank = BLANK.encode()
            if any(blank in t for t in texts):
                plain = [t.replace(blank, b" ") for t in texts]
                data, offsets = np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in plain])])
            ids, cuts = coder.encode(data, offsets)
            back = coder.pieces.decode(ids, cuts)
            raw = ids.astype("<i4").tobytes()
            digests = [sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids), mask=pa.array(np.asarray(whole.is_null())))
            return struct_array({"ids": lists, "n_tokens": pa.array(np.diff(cuts)), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array([sha256(b).hexdigest() for b in back], pa.string()), "round_trip": pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())})

        return judge

    return beside(docs, keep, text_column(F.col("text"), _ENCODED, start, BLOCK_BYTES), _ENCODED)


def decode_ids(df: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """The columns in keep, and text decoded from the column ids; null stays null. Bytes that are no
    UTF-8 become U+FFFD. A list is decoded whole, however long; repeated rows give repeated texts and an empty table
    an empty one. A column in keep named text is replaced."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = load(found(model))
        for lists in batches:
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            texts = pieces.decode(np.asarray(lists.flatten(), np.int64), cuts)
            yield pa.array([t.decode("utf-8", "replace") if v.is_valid else None for t, v in zip(texts, lists, strict=True)], pa.string())

    return beside(df, keep, F.struct(run("ids").alias("text")), "text string")
