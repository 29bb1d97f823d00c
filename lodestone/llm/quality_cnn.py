"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of 16 bytes slide by 4 over the whole document, their rectified
outputs are max-pooled over overlapping chunks of 512 bytes, and mean and maximum over the chunks are
combined into one probability. One more input channel tells whether a byte belongs to a run that
repeats what stood up to 40 bytes before it. The network is trained here, on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, fold_of, small, text_column, window_of

DIM, WIDTH, STEP, FILTERS = 8, 16, 4, 24
HALF = 256  # bytes; chunks are two halves long and start at each half
LAGS = range(2, 41)
SEGMENT = 1 << 20
GROUP_BYTES = 1 << 17
#: Bounds of the training sample: documents of each label, and the characters of the window that a longer
#: document is trained on. The window lies anywhere in the text, by a hash of it.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 700, 16_384
EPOCHS, BATCH, RATE, SEED = 6, 16, 0.006, 7
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH // STEP blocks x (STEP * DIM + 1) x FILTERS
    bias: np.ndarray  # FILTERS
    mean: np.ndarray  # FILTERS, weights of the mean over chunks
    peak: np.ndarray  # FILTERS, weights of the maximum over chunks
    shift: np.ndarray  # 1


def start(seed: int = SEED) -> Network:
    r = np.random.default_rng(seed)
    draw = lambda *s, by=1.0: (r.standard_normal(s) * by).astype(np.float32)
    blocks = WIDTH // STEP
    return Network(draw(256, DIM, by=0.5), draw(blocks, STEP * DIM + 1, FILTERS, by=1 / np.sqrt(WIDTH * DIM)), np.zeros(FILTERS, np.float32), draw(FILTERS, by=0.3), draw(FILTERS, by=0.1), np.zeros(1, np.float32))


def _padded(x: np.ndarray) -> np.ndarray:
    """Zeros behind: whole halves, and room for the last window."""
    size = max(1, -(-len(x) // HALF)) * HALF
    return np.concatenate([x, np.zeros(size - len(x) + WIDTH - STEP, np.uint8)])


def _echo(x: np.ndarray) -> np.ndarray:
    """For each step of 4 bytes 1.0 if its 8-byte block equals the bytes some lag before it."""
    size = -(-len(x) // 8) * 8
    field = np.zeros(size + max(LAGS), np.uint8)
    field[max(LAGS) : max(LAGS) + len(x)] = x
    own = field[max(LAGS) :]
    alive = (own != 0).view(np.uint64) == np.uint64(0x0101010101010101)
    found = np.zeros(size // 8, dtype=bool)
    for lag in LAGS:
        found |= np.equal(own, field[max(LAGS) - lag : max(LAGS) - lag + size]).view(np.uint64) == np.uint64(0x0101010101010101)
    return np.repeat((found & alive).astype(np.float32), 8 // STEP)[: len(x) // STEP]


def _inputs(net: Network, x: np.ndarray, echo: np.ndarray) -> np.ndarray:
    blocks = np.empty((len(x) // STEP, STEP * DIM + 1), np.float32)
    blocks[:, :-1] = net.embed[x].reshape(len(x) // STEP, STEP * DIM)
    blocks[:, -1] = echo
    return blocks


def _windows(net: Network, blocks: np.ndarray) -> np.ndarray:
    n = len(blocks) - len(net.filters) + 1
    out = blocks[:n] @ net.filters[0]
    for k in range(1, len(net.filters)):
        out += blocks[k : k + n] @ net.filters[k]
    return out


def pooled(net: Network, x: np.ndarray) -> np.ndarray:
    """Chunks x FILTERS: the largest rectified output of each filter in each chunk of the document."""
    x = _padded(x)
    echo = _echo(x)
    halves = []
    for a in range(0, len(x) - WIDTH + STEP, SEGMENT):
        part = slice(a, min(len(x), a + SEGMENT + WIDTH - STEP))
        z = _windows(net, _inputs(net, x[part], echo[part.start // STEP : part.stop // STEP]))
        halves.append(z.reshape(-1, HALF // STEP, FILTERS).max(axis=1))
    top = np.concatenate(halves)
    chunks = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top
    return np.maximum(chunks + net.bias, 0)


def _joined(m: np.ndarray, net: Network) -> float:
    z = float(m.mean(axis=0) @ net.mean + m.max(axis=0) @ net.peak + net.shift[0])
    return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6)


def score(net: Network, x: np.ndarray) -> float:
    return _joined(pooled(net, x), net)


def score_many(net: Network, data: np.ndarray, offsets: np.ndarray) -> list[float]:
    """Scores of several texts with one pass of each filter: they stand in one array, each padded to
    whole halves and followed by an empty half, so that no window or lag reaches a neighbour."""
    sizes = np.diff(offsets)
    halves = np.maximum(1, -(-sizes // HALF))
    first = np.concatenate([[0], np.cumsum(halves + 1)]) + 1
    x = np.zeros(int(first[-1]) * HALF + WIDTH - STEP, np.uint8)
    x[np.arange(len(data)) + np.repeat(first[:-1] * HALF - offsets[:-1], sizes)] = data
    z = _windows(net, _inputs(net, x, _echo(x)))
    top = z.reshape(-1, HALF // STEP, FILTERS).max(axis=1)
    out = []
    for a, n in zip(first[:-1].tolist(), halves.tolist(), strict=True):
        own = top[a : a + n]
        chunks = np.maximum(own[:-1], own[1:]) if n > 1 else own
        out.append(_joined(np.maximum(chunks + net.bias, 0), net))
    return out


def _gradient(net: Network, x: np.ndarray, echo: np.ndarray, label: float) -> tuple[list[np.ndarray], float]:
    blocks = _inputs(net, x, echo)
    z = _windows(net, blocks)
    grouped = z.reshape(-1, HALF // STEP, FILTERS)
    at = grouped.argmax(axis=1) + np.arange(len(grouped))[:, None] * (HALF // STEP)
    if len(at) > 1:
        later = np.take_along_axis(z, at[1:], 0) > np.take_along_axis(z, at[:-1], 0)
        at = np.where(later, at[1:], at[:-1])
    m = np.maximum(np.take_along_axis(z, at, 0) + net.bias, 0)
    mean, top = m.mean(axis=0), m.argmax(axis=0)
    peak = m[top, np.arange(FILTERS)]
    p = 1 / (1 + np.exp(-np.clip(float(mean @ net.mean + peak @ net.peak + net.shift[0]), -30, 30)))
    d = np.float32(p - label)
    dm = np.repeat((d * net.mean / len(m))[None], len(m), axis=0)
    dm[top, np.arange(FILTERS)] += d * net.peak
    dm *= m > 0
    rows, cols = np.nonzero(dm)
    g, where = dm[rows, cols].astype(np.float32), at[rows, cols]
    df, de = np.zeros_like(net.filters), np.zeros_like(net.embed)
    spot = np.zeros((len(rows), FILTERS), np.float32)
    spot[np.arange(len(rows)), cols] = g
    for k in range(len(net.filters)):
        df[k] = blocks[where + k].T @ spot
        back = (net.filters[k][:-1].T[cols] * g[:, None]).reshape(-1, DIM)
        bytes_at = ((where + k)[:, None] * STEP + np.arange(STEP)).ravel()
        which = x[bytes_at]
        for c in range(DIM):
            de[:, c] += np.bincount(which, back[:, c], 256).astype(np.float32)
    loss = -np.log(max(1e-7, p if label else 1 - p))
    return [de, df, dm.sum(axis=0), d * mean, d * peak, np.array([d], np.float32)], float(loss)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on logistic loss, both labels with equal weight. The order is drawn from the seed, so equal
    samples give equal networks. Without texts of both labels the network keeps a constant score."""
    net = start(seed)
    if len(set(labels)) < 2:
        net.mean[:] = net.peak[:] = 0
        net.shift[0] = 2.0 if not labels or labels[0] else -2.0
        return net
    y = np.array(labels)
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    ready = [_padded(np.frombuffer(t, np.uint8)) for t in texts]
    echoes = [_echo(x) for x in ready]
    params = [getattr(net, f.name) for f in fields(net)]
    first, second, r, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], np.random.default_rng(seed), 0
    total = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for a in range(0, len(y), BATCH):
            batch = order[a : a + BATCH]
            sums = [np.zeros_like(p) for p in params]
            for i in batch:
                grads, _ = _gradient(net, ready[i], echoes[i], float(y[i]))
                for s, g in zip(sums, grads, strict=True):
                    s += g * np.float32(weight[i] / len(batch))
            t += 1
            rate = RATE * (1 - t / (total + 1))
            for p, s, m, v in zip(params, sums, first, second, strict=True):
                m += 0.1 * (s - m)
                v += 0.01 * (s * s - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return net


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """Up to SAMPLE_PER_LABEL texts of each label from rows outside the held-out fold, those with the least
    hash of their text. Of a text over SAMPLE_CHARS a window is trained on (it is scored whole)."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold_of() != 0)).select("doc_id", F.col("quality").cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, 3.0 * SAMPLE_PER_LABEL / n))).otherwise(share)
    picked = small(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(picked, "doc_id")
    rows = texts.select("label", window_of(F.col("text"), SAMPLE_CHARS).alias("text"), F.xxhash64("text").alias("h")).distinct()
    got = []
    for label in sorted(counts):
        got += rows.where(F.col("label") == label).orderBy("h", "text").limit(SAMPLE_PER_LABEL).select("text", "label").collect()
    return [r.text.encode() for r in got], [r.label for r in got]


def score_column(text: Column, net: Network) -> Column:
    """The score (double, 0 to 1) of whole texts, however long. Null is scored like the empty text, and equal texts get
    equal scores up to the order of float32 sums."""

    def judge(data: np.ndarray, offsets: np.ndarray, _: pa.Array) -> pa.Array:
        whole = len(data) <= SEGMENT
        return pa.array(score_many(net, data, offsets) if whole else [score(net, data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.float64())

    return text_column(text, "double", lambda: judge, GROUP_BYTES)


def score_texts(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """The columns in keep, and score (double, 0 to 1) of the whole text, however long.

    Null and empty texts score alike, as a document of nothing; equal texts score alike, ties need no rule.
    Repeated rows get the same score each; an empty table gives an empty result; a column in keep named
    score is replaced, other columns are left alone.
    """
    return beside(docs, keep, F.struct(score_column(F.col("text"), net).alias("score")), "score double")


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*sample(docs, labels))
