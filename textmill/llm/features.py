"""Hashed word and character n-grams of texts, and a small logistic regression on them."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, texts_of

#: Feature space: words, word pairs, character trigrams (of UTF-8 bytes), and the two
#: pairs "the same word again" at distance 1 and 2, whatever the word.
WORDS, PAIRS, TRIGRAMS, AGAIN = 4096, 4096, 8192, 2
SIZE = WORDS + PAIRS + TRIGRAMS + AGAIN
#: Weight of the last two: they stand for all words, so they are few beside the others.
AGAIN_WEIGHT = 6.0


def count_rows(texts: list[str]) -> np.ndarray:
    """Dense counts, one row per text; whole texts are counted."""
    n = len(texts)
    raws = [t.encode() for t in texts]
    words = [r.split() for r in raws]
    owner = np.repeat(np.arange(n), [len(w) for w in words])
    h = np.fromiter((crc32(x) for w in words for x in w), np.uint32, len(owner)).astype(np.int64)
    places = [owner * SIZE + (h & (WORDS - 1))]
    if len(h) > 1:
        pair = ((h[:-1] * 0x9E3779B1 + h[1:]) * 0x85EBCA6B >> 15) & (PAIRS - 1)
        places.append((owner[:-1] * SIZE + WORDS + pair)[owner[:-1] == owner[1:]])
    for far in (1, 2):
        same = (h[:-far] == h[far:]) & (owner[:-far] == owner[far:])
        places.append(owner[:-far][same] * SIZE + SIZE - AGAIN + far - 1)
    data = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8).astype(np.int64)
    if len(data) > 2:
        tri = ((data[:-2] * 0x1F123BB5 + data[1:-1] * 0x5851F42D + data[2:] * 0x2545F491) >> 13) & (TRIGRAMS - 1)
        inside = (data[:-2] != 0) & (data[1:-1] != 0) & (data[2:] != 0)
        place = np.repeat(np.arange(n), [len(r) + 1 for r in raws])[:-2] * SIZE + WORDS + PAIRS + tri
        places.append(place[inside])
    return np.bincount(np.concatenate(places), minlength=n * SIZE).reshape(n, SIZE)


def unit_rows(texts: list[str], weight: np.ndarray | None = None) -> np.ndarray:
    """log(1 + count), optionally weighted, at length 1 (an empty text: all 0)."""
    x = np.log1p(count_rows(texts), dtype=np.float32)
    x[:, -AGAIN:] *= AGAIN_WEIGHT
    if weight is not None:
        x *= weight
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=x, where=norm > 0)


class Rows:
    """Sparse training rows with 0/1 labels, made of those of :func:`training_rows`."""

    def __init__(self, rows: pa.Table):
        at, n = (rows.column(c).combine_chunks() for c in ("at", "n"))
        self.y = rows.column("y").to_numpy().astype(np.float64)
        self.lens = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.at, self.n = at.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy()
        self.owner = np.repeat(np.arange(len(self.y)), self.lens)

    def __len__(self) -> int:
        return len(self.y)

    def take(self, chosen: np.ndarray) -> Rows:
        new = object.__new__(Rows)
        keep = chosen[self.owner]
        new.y, new.lens = self.y[chosen], self.lens[chosen]
        new.at, new.n = self.at[keep], self.n[keep]
        new.owner = np.repeat(np.arange(len(new.y)), new.lens)
        return new

    def units(self, weight: np.ndarray | None = None) -> np.ndarray:
        """Values of the sparse entries as :func:`unit_rows` gives them."""
        v = np.log1p(self.n) * np.where(self.at >= SIZE - AGAIN, np.float32(AGAIN_WEIGHT), np.float32(1))
        if weight is not None:
            v = v * weight[self.at]
        norm = np.sqrt(np.bincount(self.owner, v * v, len(self)))
        return v / np.maximum(norm, 1e-12)[self.owner]


def training_rows(sample: DataFrame) -> DataFrame:
    """Features of a bounded sample (``order``, ``text``, ``y``), counted from whole texts: ``order``, ``at``, ``n``, ``y``."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts = count_rows(texts_of(part))
        at = [np.flatnonzero(row).astype(np.int32) for row in counts]
        n = [row[k].astype(np.float32) for row, k in zip(counts, at)]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32())), part.column(2)], names=["order", "at", "n", "y"]
        )

    return map_slices(sample.select("order", "text", "y"), run, "order long, at array<int>, n array<float>, y int")


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(rows: Rows, rounds: int = 150, l2: float = 2e-4, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps (Adam) on the mean log-loss, both classes weighing the same."""
    v = rows.units()
    share = np.where(rows.y == 1, max(rows.y.mean(), 1e-9), max(1 - rows.y.mean(), 1e-9))
    pull = 0.5 / share / len(rows)
    w, mean, square = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(rows.owner, v * w[rows.at], len(rows)) + w[-1]
        g = (sigmoid(z) - rows.y) * pull
        grad = np.append(np.bincount(rows.at, v * g[rows.owner], SIZE) + l2 * w[:-1], g.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def fit_platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Newton steps on smoothed targets)."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    middle, spread = float(z.mean()), max(float(z.std()), 1e-6)
    z = (z - middle) / spread
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        d, r = p * (1 - p) + 1e-9, p - target
        h = np.array([[(d * z * z).sum() + 1e-6, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, [(r * z).sum() + 1e-6 * (a - 1), r.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    a = max(float(a), 1e-3) / spread
    return a, float(b) - a * middle
