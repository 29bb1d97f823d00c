"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample text. A document is compressed, in blocks,
with each dictionary; the smallest total names the language, and a narrow margin to the next one rejects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, fold_of, materialise, small, struct_array, text_column, texts_of, window_of

#: Bounds of what is learned from: dictionary bytes of a language, its sampled texts, and the characters of
#: the window that a longer text gives. They hold for up to FULL languages; more languages share what
#: FULL have together, LEAST_TEXTS for each at least. All languages are learned, however many.
DICTIONARY_BYTES, SAMPLE_TEXTS, WINDOW_CHARS, FULL, LEAST_TEXTS = 98_304, 256, 1536, 64, 4
BLOCK = 16_384
#: Blanks before each block, a few bytes in any language: zstandard stores a block that gains little as it is,
#: which would make short texts equally long in all languages.
CARRIER = b" " * 64
MIN_MARGIN = 0.005  # relative; narrower rejects
SHARPNESS = 60.0

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    """Lower case; ASCII other than letters becomes one blank between words."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split())


def has_letter(text: bytes) -> bool:
    if text.isascii():
        return bool(text.lower().translate(_LETTERS).strip())
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def fit(docs: DataFrame, lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries learned from text and lang of the rows outside the held-out fold: for each language up to
    SAMPLE_TEXTS different texts, those with the least hash, however many copies the language holds. The
    language with the most different texts comes first."""
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & (fold_of() != 0)).select(F.col(lang).cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    texts = materialise(known.select("lang", "h").distinct(), "texts")
    counts = {r.lang: r["count"] for r in texts.groupBy("lang").count().collect()}
    each = min(SAMPLE_TEXTS, max(LEAST_TEXTS, SAMPLE_TEXTS * FULL // max(1, len(counts))))
    room = min(DICTIONARY_BYTES, max(1024, DICTIONARY_BYTES * FULL // max(1, len(counts))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = materialise(texts.withColumn("_place", place).where(F.col("_place") <= each).drop("_place"), "picked")
    rows = known.join(small(picked), ["lang", "h"]).select("lang", "h", window_of(F.col("text"), WINDOW_CHARS).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    parts: dict[str, list[bytes]] = {}
    for r in rows.orderBy("h", "lang").collect():
        parts.setdefault(r.lang, []).append(normal(r.text.encode()) + b" ")
    return {name: b"".join(parts[name])[-room:] for name in sorted(counts, key=lambda x: (-counts[x], x))}


class Languages:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names = list(dictionaries)
        options = z.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=15, search_log=2, min_match=3, target_length=32, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.coders = []
        for raw in dictionaries.values():
            # a raw dictionary has 8 bytes at least
            content = z.ZstdCompressionDict(raw.ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=options)
            self.coders.append(z.ZstdCompressor(compression_params=options, dict_data=content))

    def sizes(self, text: bytes) -> np.ndarray:
        blocks = [CARRIER + text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [CARRIER]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders], float)

    def judge(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score and whether the margin is narrow; among equal sizes the first language stands."""
        if not self.names or not has_letter(text):
            return "und", 0.0, True
        plain = normal(text)
        sizes = self.sizes(plain)
        best = int(sizes.argmin())
        odds = np.exp(-SHARPNESS * (sizes - sizes[best]) / max(1.0, sizes[best]))
        others = np.delete(sizes, best)
        margin = float((others.min() - sizes[best]) / max(1.0, others.min())) if len(others) else 1.0
        return self.names[best], float(odds[best] / odds.sum()), margin < MIN_MARGIN


_FOUND = "lang_pred string, score double, rejected boolean"


def language_column(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """A struct of lang_pred, score and rejected for whole texts, however long. Null, texts without letters and an empty
    set of dictionaries give und, 0 and rejected; of equal sizes the first language by name is it, and is rejected for
    want of a margin; equal texts give equal values."""

    def start():
        languages = Languages(dictionaries)

        def judge(data: np.ndarray, offsets: np.ndarray, _: pa.Array) -> pa.Array:
            names, scores, rejected = zip(*map(languages.judge, texts_of(data, offsets)), strict=True) if len(offsets) > 1 else ((), (), ())
            return struct_array({"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

        return judge

    return text_column(text, _FOUND, start)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str]) -> DataFrame:
    """The columns in keep, and for the whole text, however long, lang_pred, score (0 to 1) and rejected.

    Null, empty and letterless texts are `und` with score 0 and rejected, as are all without dictionaries.
    Where two languages compress a text equally the first in the dictionaries is named and the margin of 0
    rejects. Equal texts get equal answers, repeated rows one each; an empty table gives an empty result; a
    column in keep that is named like an added one is replaced.
    """
    return beside(docs, keep, language_column(F.col("text"), dictionaries), _FOUND)
