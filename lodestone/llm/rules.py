"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared, by Jensen-Shannon
distance, with references counted for each language over the whole corpus. A document that is far from
every language is turned down; texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, materialise, struct_array, text_blocks, text_column, texts_of

COMMON_WORDS = 64  # words of each language's reference histogram
MIN_WORDS, MIN_CHARS = 50, 200  # shorter texts pass the word test, or the character test
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.48
DIGITS = 9  # of the distances given
FLUSH, FLUSH_BYTES = 200_000, 32 << 20  # words held, or bytes read, until the counts so far are sent on

#: Character classes: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 sentence mark, 5 other ASCII
#: mark, 6 control, 7 first byte of a longer character; the other bytes of longer characters count nowhere.
_CLASS = np.full(256, 6, np.int64)
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 8, 7
CLASSES = 8

_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\v\f\r"


@dataclass
class References:
    """Per language: class histogram and the words with their share; a last share is that of all others."""

    classes: dict[str, np.ndarray]
    words: dict[str, tuple[dict[bytes, int], np.ndarray]]


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x CLASSES."""
    n = len(offsets) - 1
    which = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(which * (CLASSES + 1) + _CLASS[data], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, n) with counts of this partition's words, and with the words 'class 0' and
    so on and 'all' (with a blank before it, which no word can have) for character classes and all words."""
    words: dict[str, Counter] = {}
    read = 0

    def flush() -> pa.RecordBatch:
        rows = [(lang, w.decode("utf-8", "replace"), n) for lang, c in words.items() for w, n in c.items()]
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    for part, data, offsets in text_blocks(batches, "text", 2 << 20):
        langs = part.column(part.schema.get_field_index("lang")).to_pylist()
        for lang, text, counts in zip(langs, texts_of(data, offsets), class_counts(data, offsets).tolist(), strict=True):
            own = words.setdefault(lang, Counter())
            words_ = text.lower().split()
            own.update(words_)
            own[b" all"] += len(words_)
            for k, n in enumerate(counts):
                own[b" class %d" % k] += n
        read += len(data)
        if sum(map(len, words.values())) > FLUSH or read > FLUSH_BYTES:
            yield flush()
            read = 0
    yield flush()


def references(docs: DataFrame, lang: str = "lang") -> References:
    """Counts over all documents with a language, whatever the number of languages. What comes to the driver
    is COMMON_WORDS words and CLASSES + 1 numbers a language. Among words of equal count the first in
    alphabetical order is the more common."""
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).cast("string").alias("lang"), "text")
    counts = materialise(rows.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    got = counts.where(F.col("word").startswith(" ")).groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("sums")).collect()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top: dict[str, list] = {}
    for w in counts.where(~F.col("word").startswith(" ")).withColumn("place", place).where(F.col("place") <= COMMON_WORDS).collect():
        top.setdefault(w.lang, []).append(w)
    out = References({}, {})
    for r in sorted(got, key=lambda r: r.lang):
        sums = {s.word: s.n for s in r.sums}
        total = sums[" all"]
        classes = np.array([sums.get(f" class {k}", 0) for k in range(CLASSES)], float)
        if not total:
            continue
        words = sorted(top[r.lang], key=lambda w: w.place)
        out.classes[r.lang] = classes / classes.sum()
        shares = np.array([w.n for w in words] + [total - sum(w.n for w in words)], float) / total
        out.words[r.lang] = ({w.word.encode(): k for k, w in enumerate(words)}, shares)
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of histograms along the last axis, base 2: 0 for equal ones, 1 for disjoint ones."""
    m = (p + q) / 2
    part = lambda x: (x * np.log2(np.where(x > 0, x, 1) / np.where(x > 0, m, 1))).sum(axis=-1)
    return np.sqrt(np.maximum(0.0, (part(p) + part(q)) / 2))


class Distances:
    """All languages' histograms as matrices, so that a text meets every language at once."""

    def __init__(self, refs: References):
        self.classes = np.array(list(refs.classes.values()))
        self.vocabulary = list(dict.fromkeys(w for index, _ in refs.words.values() for w in index))
        at = {w: k for k, w in enumerate(self.vocabulary)}
        # Languages with fewer words than others are filled up with a word that no text has.
        width = max((len(index) for index, _ in refs.words.values()), default=0)
        self.places = np.full((len(refs.words), width), len(self.vocabulary))
        self.shares = np.zeros((len(refs.words), width + 1))
        for k, (index, shares) in enumerate(refs.words.values()):
            self.places[k, : len(index)] = [at[w] for w in index]
            self.shares[k, : len(index)], self.shares[k, -1] = shares[:-1], shares[-1]

    def by_class(self, counts: np.ndarray) -> float:
        return round(float(distance(counts / counts.sum(), self.classes).min()), DIGITS)

    def by_word(self, counts: Counter, total: int) -> float:
        own = np.array([*(counts.get(w, 0) for w in self.vocabulary), 0], float)[self.places]
        own = np.concatenate([own, total - own.sum(axis=1, keepdims=True)], axis=1) / total
        return round(float(distance(own, self.shares).min()), DIGITS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pair = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    gram = pair[:-1] * len(known) + ids[2:]
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    hit = np.zeros(len(gram) + 2, dtype=bool)
    twice = np.zeros(len(gram), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(docs: DataFrame, refs: References, keep: list[str]) -> DataFrame:
    """The columns in keep, and for the whole text, however long: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the least distances over the languages (null where too short).

    Null is judged like the empty text: no words, so base_failed. Without references only the base rules
    hold. A distance equal to its limit passes. Repeated rows get the same result each; an empty table gives
    an empty result; a column in keep that is named like an added one is replaced.
    """

    def start():
        near = Distances(refs)

        def run(data: np.ndarray, offsets: np.ndarray, _: pa.Array) -> pa.Array:
            out: list[tuple] = []
            for text, classes in zip(texts_of(data, offsets), class_counts(data, offsets), strict=True):
                words = text.split()
                n = len(words)
                solid = np.frombuffer(text.translate(None, _WHITE), np.uint8)
                chars = int(((solid & 0xC0) != 0x80).sum())
                symbols = len(text) - len(text.translate(None, _SYMBOLS))
                lines = [x for x in text.split(b"\n") if x.strip()]
                repeated = repeated_words(words)
                failed = n < MIN_WORDS or 100 * repeated > 50 * n
                by_class = near.by_class(classes) if refs.classes and chars >= MIN_CHARS else None
                by_word = near.by_word(Counter(text.lower().split()), n) if refs.words and n >= MIN_WORDS else None
                far = (by_class is not None and by_class > MAX_CLASS_DISTANCE) or (by_word is not None and by_word > MAX_WORD_DISTANCE)
                out.append((n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, not failed and not far, by_class, by_word))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            return struct_array({f.split()[0]: pa.array([row[k] for row in out], t) for k, (f, t) in enumerate(zip(_OUT.split(", "), types, strict=True))})

        return run

    return beside(docs, keep, text_column(F.col("text"), _OUT, start), _OUT)
