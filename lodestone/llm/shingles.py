"""Sets of 5-word shingles as sorted 64-bit hashes, computed for whole Arrow batches at a time."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from .common import U64, WHITE, mix

WIDTH = 5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_PLACE = mix(np.arange(1, 1025, dtype=U64) * U64(0x9FB21C651E98DF25)) | U64(1)
_SLOT = mix(np.arange(1, WIDTH + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)) | U64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) | U64(1)
    return _PLACE


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the number of words of each text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n, np.int64)
    solid = ~WHITE[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    starts = np.flatnonzero(solid & before)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n, np.int64)
    where = np.flatnonzero(solid)
    first = np.searchsorted(where, starts)
    sizes = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, sizes)
    value = _BYTE[_FOLD[data[where]]]
    value *= _places(int(sizes.max()))[place]
    words = mix(np.add.reduceat(value, first) + sizes.astype(U64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return words, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; with fewer words the whole
    sequence is one shingle; without words the set is empty."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    out = []
    if len(words) >= WIDTH:
        m = len(words) - WIDTH + 1
        grams = words[:m] * _SLOT[0]
        for k in range(1, WIDTH):
            grams += words[k : k + m] * _SLOT[k]
        grams = mix(grams)
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= WIDTH:
            own = np.sort(grams[end - count : end - WIDTH + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif count:
            part = words[end - count : end] * _SLOT[:count]
            out.append(mix(np.array([part.sum(dtype=U64) + U64(count)], dtype=U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number; equal sets have equal names."""
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
