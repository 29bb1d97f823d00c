"""Sentence-aware chunks with overlap. Lengths and offsets count code points."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, MAX_CHARS = 1000, 150, 4000
TAIL_SHARE = 0.3
# The Korean sentence endings, and where a sentence may end.
ENDINGS = "다요죠까군네나지"
BOUNDARY = re.compile(rf"(?<=[{ENDINGS}]\.)\s+|(?<=(?<!\d)\.)\s+(?=[A-Z가-힣])|(?<=。)\s*(?=\S)|\n{{2,}}")

Part = tuple[str, int]


def sentences(text: str, white: str | None = None) -> list[Part]:
    """Trimmed sentences with the offsets where their untrimmed segments start; none ends inside
    parentheses, whose depth is counted once for the whole text. white has the characters that are trimmed, None
    means all white space."""
    deep = None
    if "(" in text:
        deep = list(accumulate(text, lambda d, c: d + 1 if c == "(" else max(0, d - 1) if c == ")" else d, initial=0))
    found, begin = [], 0
    for hit in BOUNDARY.finditer(text):
        body = text[begin : hit.start()].strip(white)
        if body and not (deep and deep[hit.start()]):
            found.append((body, begin))
            begin = hit.end()
    body = text[begin:].strip(white)
    return [*found, (body, begin)] if body else found


def _packed(parts: list[Part], limit: int) -> Iterator[tuple[str, int, Part | None]]:
    """Runs of parts joined by blanks up to a length, each with the part that did not fit."""
    text, offset = "", 0
    for part in parts:
        if not text:
            text, offset = part
        elif len(text) + 1 + len(part[0]) <= limit:
            text = f"{text} {part[0]}"
        else:
            replaced = yield text, offset, part
            text, offset = replaced or part
    if text:
        yield text, offset, None


def _bounded(text: str, offset: int, limit: int, white: str | None) -> Iterator[Part]:
    """A chunk cut to the hard limit: by sentences while there are several, else at the limit."""
    if len(text) <= limit:
        if piece := text.strip(white):
            yield piece, offset
        return
    parts = sentences(text, white)
    if len(parts) > 1:
        for piece, at, _ in _packed(parts, limit):
            yield from _bounded(piece, offset + at, limit, white)
    else:
        for at in range(0, len(text), limit):
            if piece := text[at : at + limit].strip(white):
                yield piece, offset + at


def chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP, max_chars: int = 0, white: str | None = None) -> list[Part]:
    """(content, offset) of each chunk; none for a blank text. The offset of a chunk that begins with an
    overlap is its first sentence's less the overlap's length. Chunks are trimmed of white (None: all white space)
    where they are cut; sentences of the whole text always lose all white space around them."""
    if not text or not text.strip():
        return []
    out: list[Part] = []
    packing = _packed(sentences(text), size)
    step = next(packing, None)
    while step:
        body, offset, rest = step
        if rest is None:
            body = body.strip(white)
            if out and len(body) < int(size * TAIL_SHARE):
                out[-1] = (f"{out[-1][0]} {body}", out[-1][1])
            else:
                out.append((body, offset))
            break
        out.append((body.strip(white), offset))
        if 0 < overlap < len(body):
            kept = body[-overlap:]
            kept = kept[kept.find(" ") + 1 :]
            rest = (f"{kept} {rest[0]}", rest[1] - len(kept))
        try:
            step = packing.send(rest)
        except StopIteration:
            break
    limit = max_chars if max_chars > 0 else MAX_CHARS
    return [p for body, offset in out for p in ([(body, offset)] if len(body) <= limit else _bounded(body, offset, limit, white))]


def chunk_column(text: Column, size: int = SIZE, overlap: int = OVERLAP, max_chars: int = 0, white: str | None = None) -> Column:
    """array<struct<content, char_offset>>, by Arrow batches."""

    @F.pandas_udf("array<struct<content:string,char_offset:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"content": c, "char_offset": o} for c, o in chunks(t, size, overlap, max_chars, white)])

    return run(text)


def sentence_count(text: Column) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(sentences(t)) if t else 0).astype("int32")

    return run(text)


def chunked(docs: DataFrame, text: str = "text", **options: int | str) -> DataFrame:
    """The other columns of docs beside chunk_index, content and char_offset, one row a chunk."""
    rest = [c for c in docs.columns if c != text]
    wide = docs.select(*rest, F.posexplode(chunk_column(F.col(text), **options)).alias("chunk_index", "c"))
    return wide.select(*rest, "chunk_index", "c.content", "c.char_offset")
