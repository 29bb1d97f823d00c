"""Media columns of telephony audio: mu-law, A-law and IMA ADPCM in WAV containers.

Companded samples expand by lookup tables; ADPCM blocks decode side by side, one sample of all blocks at
a time; PCM is resampled by a fixed windowed-sinc filter and stored as 16-bit samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, struct_array, text_column

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE, TARGET_RATE = 8000, 16000
UNIT = 576  # bytes; payloads are padded to a multiple of it
PAD = 255
IMA_BLOCK = 36  # bytes: a head of 4, then 64 samples
SLAB = 8192  # ADPCM blocks decoded side by side
STRETCH = 1 << 16  # resampled samples made at a time
#: The stored form of a text is one of these, by its payload's checksum, so equal texts are stored alike.
CODECS = (("mulaw", MULAW), ("alaw", ALAW), ("ima_adpcm", IMA))


def mulaw_table() -> np.ndarray:
    """The 16-bit value of each mu-law code (ITU-T G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit value of each A-law code (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    part, step = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(step == 0, part + 8, part + 0x108 << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()

# Fixed values of the IMA ADPCM format: step sizes and index changes.
_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks. A block has a first sample, a step index, a zero byte, then nibbles,
    low one first. SLAB blocks advance together; an incomplete last block is ignored."""
    n = len(data) // block
    raw = np.frombuffer(data, np.uint8, n * block).reshape(n, block)
    out = np.empty((n, 1 + 2 * (block - 4)), np.int16)
    for a in range(0, n, SLAB):
        own = raw[a : a + SLAB]
        value = own[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
        index = np.minimum(own[:, 2].astype(np.int32), len(_STEPS) - 1)
        out[a : a + SLAB, 0] = value
        for k in range(2 * (block - 4)):
            code, step = own[:, 4 + k // 2] >> 4 * (k & 1) & 15, _STEPS[index]
            change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + _CHANGES[code], 0, len(_STEPS) - 1)
            out[a : a + SLAB, k + 1] = value
    return out.ravel()


def wav(fmt: int, payload: bytes, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file. Payloads of odd size get the pad byte that RIFF asks for."""
    extra = b"" if fmt == PCM else struct.pack("<H", 0)
    if fmt == IMA:
        extra = struct.pack("<HH", 2, (block - 4) * 2 + 1)
    head = struct.pack("<HHIIHH", fmt, 1, rate, rate * block, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and payload of a mono WAV file. Raises ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1:
                raise ValueError("not mono")
            found = fmt, rate, block
        elif name == b"data" and found:
            return *found, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no audio in the file")


def pcm_of(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a WAV file in any of the four formats."""
    fmt, rate, block, payload = read_wav(media)
    if fmt == MULAW:
        return MULAW_PCM[np.frombuffer(payload, np.uint8)], rate
    if fmt == ALAW:
        return ALAW_PCM[np.frombuffer(payload, np.uint8)], rate
    if fmt == IMA:
        return decode_ima(payload, block), rate
    if fmt == PCM:
        return np.frombuffer(payload[: len(payload) // 2 * 2], "<i2"), rate
    raise ValueError(f"format {fmt} is not known")


def resampled(pcm: np.ndarray, up: int, down: int, taps: int = 8) -> Iterator[np.ndarray]:
    """By up / down, with a Hann-windowed sinc of `taps` samples to each side, in 32-bit integers, so that
    results do not depend on the machine. The length is ceil(n * up / down), given in stretches: whatever the
    signal's length, little more than the signal is held."""
    common = int(np.gcd(up, down))
    up, down = up // common, down // common
    size, cut = -(-len(pcm) * up // down), min(1.0, up / down)
    kernels = []
    for phase in range(up):
        t = np.arange(-taps + 1, taps + 1) - phase / up
        kernel = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / taps, -1, 1)))
        kernels.append([(k, w) for k, w in enumerate(np.round(kernel * 16384).astype(int).tolist()) if w])
    field = np.concatenate([np.zeros(taps, np.int16), pcm.astype(np.int16, copy=False), np.zeros(taps + 1, np.int16)])
    for begin in range(0, size, STRETCH):
        out = np.empty(min(STRETCH, size - begin), np.int16)
        for i in range(min(up, len(out))):  # every up-th sample has the same phase, and stands down samples on
            at = (begin + i) * down
            n = len(range(i, len(out), up))
            total = np.full(n, 8192, np.int32)
            for k, w in kernels[at % up]:
                first = at // up + 1 + k
                total += field[first : first + (n - 1) * down + 1 : down] * np.int32(w)
            out[i::up] = np.clip(total >> 14, -32768, 32767)
        yield out


def resample(pcm: np.ndarray, up: int, down: int, taps: int = 8) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int16), *resampled(pcm, up, down, taps)])


class Signal:
    """What is kept of a resampled signal while it passes: its digest as a WAV file's samples, and its feature."""

    def __init__(self):
        self.n = self.sum = self.peak = self.turns = 0
        self.last = None
        self.digest = sha256()

    def take(self, stretches: Iterable[np.ndarray]) -> Signal:
        for x in stretches:
            self.digest.update(x.astype("<i2", copy=False).tobytes())
            size = np.abs(x.astype(np.int32))
            low = x < 0
            self.n += len(x)
            self.sum += int(size.sum(dtype=np.int64))
            self.peak = max(self.peak, int(size.max(initial=0)))
            self.turns += int((low[1:] != low[:-1]).sum()) + int(self.last is not None and len(low) > 0 and bool(low[0]) != self.last)
            self.last = bool(low[-1]) if len(low) else self.last
        return self

    @property
    def feature(self) -> str:
        """Length, mean size, largest size and sign changes, as text."""
        return f"n={self.n};mean={self.sum // max(1, self.n)};peak={self.peak};turns={self.turns}"


def codec_of(payload: bytes) -> tuple[str, int]:
    return CODECS[zlib.crc32(payload) % len(CODECS)]


_STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm_bytes long, pcm_sha256 string"


def store_texts(docs: DataFrame, keep: list[str], with_media: bool = False, with_pcm: bool = False) -> DataFrame:
    """The columns in keep, and for each whole text stored as telephony audio in one of CODECS: n_bytes,
    payload_bytes, payload_sha256 and tail_crc32 (of what is read back), media_bytes, media_sha256, feature,
    codec, pcm_bytes and pcm_sha256 (of the samples resampled to TARGET_RATE); with_media adds the WAV file
    as media, with_pcm the resampled samples as a WAV file in pcm.

    A null text is stored like an empty one, as one padded unit. A very long text is stored whole; beside its
    bytes its samples at the first rate are held, and those of the second rate only with with_pcm. Equal texts
    give equal values, repeated rows one each; an empty table gives an empty result; a column in keep that is
    named like an added one is replaced.
    """
    more = [("media", "binary")] * with_media + [("pcm", "binary")] * with_pcm
    kind = ", ".join([_STORED, *(" ".join(m) for m in more)])

    def judge(data: np.ndarray, offsets: np.ndarray, _: pa.Array) -> pa.Array:
        sizes = np.diff(offsets).tolist()
        payloads = [data[a : a + n].tobytes() + bytes([PAD]) * (max(1, -(-n // UNIT)) * UNIT - n) for a, n in zip(offsets[:-1].tolist(), sizes, strict=True)]
        codecs = [codec_of(x) for x in payloads]
        files = [wav(fmt, x, block=IMA_BLOCK if fmt == IMA else 1, bits=4 if fmt == IMA else 8) for x, (_, fmt) in zip(payloads, codecs, strict=True)]
        payloads = [read_wav(x)[3] for x in files]
        # The blocks of all texts are decoded together; companded samples expand text by text.
        blocks = decode_ima(b"".join(x for x, (_, fmt) in zip(payloads, codecs, strict=True) if fmt == IMA), IMA_BLOCK)
        rows, at = [], 0
        for n, payload, media, (name, fmt) in zip(sizes, payloads, files, codecs, strict=True):
            if fmt == IMA:
                count = len(payload) // IMA_BLOCK * (1 + 2 * (IMA_BLOCK - 4))
                pcm, at = blocks[at : at + count], at + count
            else:
                pcm = pcm_of(media)[0]
            stretches = resampled(pcm, TARGET_RATE, RATE)
            if with_pcm:
                stretches = list(stretches)
            signal = Signal().take(stretches)
            row = [n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha256(media).hexdigest(), signal.feature, name, 2 * signal.n, signal.digest.hexdigest()]
            rows.append([*row, *[media] * with_media, *[wav(PCM, b"".join(x.astype("<i2").tobytes() for x in stretches), TARGET_RATE, 2, 16) for _ in range(with_pcm)]])
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return struct_array({f.split()[0]: pa.array([r[k] for r in rows], types[f.split()[1]]) for k, f in enumerate(kind.split(", "))})

    return beside(docs, keep, text_column(F.col("text"), kind, lambda: judge), kind)
