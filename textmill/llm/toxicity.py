"""Operator 5: toxic spans by a linear-chain conditional random field.

Labels mark whole documents, so tokens are labelled first: in a toxic document, a token
is toxic if one of its forms (the word, its beginnings of 3 to 6 bytes, its ending) occurs
in toxic documents so much more than in clean ones that less than one such form is
expected by chance over all forms; near copies count once. Where no form is beyond chance
(few labels), each token is toxic with the probability that its forms' evidence gives. A
two-state chain with hashed features of the token and of its neighbours is
trained on these tokens by maximum likelihood. Forward-backward marginals give each
token's probability; a document's score is a calibrated function of its greatest
marginal and of its expected number of toxic tokens, and runs of probable tokens are
returned as spans with code-point offsets. Calibration is on documents that the chain
didn't see: each half of the sample is scored by a chain trained on the other half.

Marginals of all tokens of a batch are computed together: the chain is one product of
2 x 2 matrices that starts anew at each document, cut into blocks that advance in step.

Training takes at most ``PER_CLASS`` labelled rows of either class, of at most
``MAX_BYTES`` bytes; every row is scored whole.

Defined results: a text without words, empty or null, has score 0 or next to it; with
labels of one class only, or none, every score is 0; repeated rows and null ids are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, held_out, labelled_sample, map_slices, texts_of
from .features import fit_platt, sigmoid

PER_CLASS = 1500
MAX_BYTES = 20_000
#: Documents of either class whose tokens train a chain.
CHAIN_DOCS = 500
THRESHOLD = 0.7
#: Hash width of the chain's weights, and of the counts that label tokens: there a
#: collision would label a clean word.
BITS, LABEL_BITS = 20, 23
CACHE_WORDS = 200_000
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|_-"
_WORD = re.compile("[^ \t-\r]+")


def forms(word: bytes) -> list[int]:
    """Hashed forms of a lower-case word, at full width: itself, its beginnings, its ending."""
    w = word.strip(_EDGE) or word
    return [crc32(w), crc32(w[:3], 3), crc32(w[:4], 4), crc32(w[:5], 5), crc32(w[:6], 6), crc32(w[-3:], 99)]


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def marginals(s: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Probability of state 1 at every token; with ``pairs`` also the expected moves between states.

    ``s`` is the score of state 1 over state 0 at each token, ``first`` marks tokens that
    begin a document, ``trans`` and ``start`` hold positive weights.
    """
    n = len(s)
    if not n:
        return (np.empty(0), np.zeros((2, 2))) if pairs else np.empty(0)
    depth = max(1, int(np.sqrt(n)) // 2)
    width = -(-n // depth)
    e = np.ones(depth * width)
    e[:n] = np.exp(np.clip(s, -30, 30))
    begin = np.zeros(depth * width, bool)
    begin[:n] = first
    e, begin = e.reshape(width, depth).T.copy(), begin.reshape(width, depth).T
    m = np.empty((2, 2, depth, width))
    for i in range(2):
        m[i, 0] = np.where(begin, start[0], trans[i, 0])
        m[i, 1] = np.where(begin, start[1], trans[i, 1]) * e
    tail = np.arange(width) * depth  # padding after the last token must change nothing
    pad = tail[None, :] + np.arange(depth)[:, None] >= n
    for i in range(2):
        for j in range(2):
            m[i, j][pad] = float(i == j)
    m /= m.sum((0, 1))
    p = m[:, :, 0].copy()
    for t in range(1, depth):
        x = m[:, :, t]
        p = p[:, 0, None] * x[0] + p[:, 1, None] * x[1]
        p /= p.sum((0, 1))
    heads, tails, a, b = np.empty((2, width)), np.empty((2, width)), (0.5, 0.5), (0.5, 0.5)
    p00, p01, p10, p11 = (p[i, j].tolist() for i in range(2) for j in range(2))
    for k in range(width):
        heads[:, k] = a
        u, v = a[0] * p00[k] + a[1] * p10[k], a[0] * p01[k] + a[1] * p11[k]
        a = (u / (u + v), v / (u + v))
    for k in reversed(range(width)):
        tails[:, k] = b
        u, v = p00[k] * b[0] + p01[k] * b[1], p10[k] * b[0] + p11[k] * b[1]
        b = (u / (u + v), v / (u + v))
    alpha, beta = np.empty((2, depth, width)), np.empty((2, depth, width))
    a = heads
    for t in range(depth):
        a = a[0] * m[0, :, t] + a[1] * m[1, :, t]
        a = a / a.sum(0)
        alpha[:, t] = a
    b = tails
    for t in reversed(range(depth)):
        beta[:, t] = b
        b = m[:, 0, t] * b[0] + m[:, 1, t] * b[1]
        b = b / b.sum(0)
    one, zero = alpha[1] * beta[1], alpha[0] * beta[0]
    prob = (one / (one + zero)).T.ravel()[:n]
    if not pairs:
        return prob
    before = np.concatenate([heads[:, None], alpha[:, :-1]], axis=1)
    moves = np.stack([[before[i] * m[i, j] * beta[j] for j in range(2)] for i in range(2)])
    moves /= moves.sum((0, 1))
    return prob, (moves * (~begin & ~pad)).sum((2, 3))


@dataclass
class Model:
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    fitted: bool = True
    slope: tuple = (1.0, 1.0)
    offset: float = 0.0
    known: dict = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": None}

    def _codes(self, words: list[bytes]) -> list[int]:
        """Numbers of words; of new ones the scores (own, what they add to the next and to the one before) are kept."""
        known = self.known
        new = set(words).difference(known)
        if new:
            held = len(known)
            f = np.array([forms(w) for w in new], np.int64) & ((1 << BITS) - 1)
            rows = np.stack([self.own[f].sum(1), self.before[f[:, 0]], self.after[f[:, 0]]], axis=1)
            known.update(zip(new, range(held, held + len(new))))
            if self.table is None or len(self.table) < len(known):
                grown = np.empty((max(1024, 2 * len(known)), 3))
                grown[:held] = 0 if self.table is None else self.table[:held]
                self.table = grown
            self.table[held : len(known)] = rows
        return list(map(known.__getitem__, words))

    def forget(self) -> None:
        self.known, self.table = {}, None

    def probabilities(self, texts: list[str]) -> list[np.ndarray]:
        """Marginal of every word of every text."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        words = [tokens_of(t) for t in texts]
        lens = np.array([len(w) for w in words], np.int64)
        flat = np.array(self._codes(list(chain.from_iterable(words))), np.int64)
        if not len(flat):
            return [np.empty(0)] * len(texts)
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(lens) - lens)[lens > 0]] = True
        prob = marginals(chain_scores(self.table[flat], first), first, self.trans, self.start)
        return np.split(prob, np.cumsum(lens)[:-1])

    def scores(self, probabilities: list[np.ndarray]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(probabilities))
        z = summary(probabilities)
        return sigmoid(z @ np.array(self.slope) + self.offset)


def chain_scores(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own score of each token, with what its neighbours in the same document add."""
    s = scores[:, 0].copy()
    s[1:] += np.where(first[1:], 0, scores[:-1, 1])
    s[:-1] += np.where(first[1:], 0, scores[1:, 2])
    return s


def summary(probabilities: list[np.ndarray]) -> np.ndarray:
    """Greatest marginal as log-odds, and log of the expected number of probable tokens."""
    top = np.array([p.max() if len(p) else 0.0 for p in probabilities]).clip(1e-4, 1 - 1e-4)
    many = np.array([p[p > 0.5].sum() for p in probabilities])
    return np.stack([np.log(top / (1 - top)), np.log1p(many)], axis=1)


def unlike(docs: list[list[bytes]], keys: int = 8, shared: int = 3) -> np.ndarray:
    """Which documents are no near copy of one before: they share less than ``shared`` of
    ``keys`` least hashes of their word triples with each. Copies would make chance words look telling."""
    odd = (np.arange(keys, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))[:, None]
    first: dict[tuple[int, int], int] = {}
    keep = np.ones(len(docs), bool)
    for i, words in enumerate(docs):
        triples = zip(words, words[1:], words[2:]) if len(words) > 2 else [tuple(words)]
        h = np.fromiter((crc32(b" ".join(t)) for t in triples), np.uint64)
        least = ((h * odd * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)).min(1).tolist()
        seen = Counter(first[k] for k in enumerate(least) if k in first)
        if seen and max(seen.values()) >= shared:
            keep[i] = False
            continue
        for k in enumerate(least):
            first.setdefault(k, i)
    return keep


def toxic_forms(docs: list[list[bytes]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forms in order, and how probably each is toxic in a toxic document.

    Forms beyond chance, corrected for the number of forms, are toxic; if there are none,
    all that toxic documents hold more often have the probability of their evidence.
    """
    size = 1 << LABEL_BITS
    in_toxic, in_clean = np.zeros(size, np.int32), np.zeros(size, np.int32)
    cache: dict[bytes, array] = {}
    for words, label in zip(docs, y):
        held: set[int] = set()
        for w in set(words):
            if w not in cache:
                cache[w] = array("i", (x & (size - 1) for x in forms(w)))
            held.update(cache[w])
        (in_toxic if label else in_clean)[list(held)] += 1
    seen = np.flatnonzero(in_toxic)
    chance, share = np.log(max(1, int(((in_toxic + in_clean) > 0).sum()))), y.mean()
    in_toxic, in_clean = in_toxic[seen], in_clean[seen]
    total = in_toxic + in_clean
    rate = (in_toxic / total).clip(1e-9, 1 - 1e-9)
    gain = total * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    sure = (in_toxic >= 3) & (rate >= 0.95) & (gain > chance)
    if sure.any():
        return seen[sure], np.ones(int(sure.sum()))
    more = rate > share
    return seen[more], sigmoid(gain[more] - chance)


def _train_chain(docs: list[list[bytes]], marked: tuple[np.ndarray, np.ndarray], y: np.ndarray, rounds: int = 60, rate: float = 0.15, l2: float = 1e-3) -> Model:
    vocabulary: dict[bytes, int] = {}
    flat = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in docs for w in d], np.int64)
    hashed = np.array([forms(w) for w in vocabulary], np.int64).reshape(-1, 6)
    names, chances = np.append(marked[0], -1), np.append(marked[1], 0.0)
    at = np.searchsorted(marked[0], hashed & ((1 << LABEL_BITS) - 1))
    bad = np.where(names[at] == hashed & ((1 << LABEL_BITS) - 1), chances[at], 0.0).max(1, initial=0.0)
    places, features = np.unique(hashed & ((1 << BITS) - 1), return_inverse=True)  # weights of what training meets
    features = features.reshape(-1, 6)
    lens = np.array([len(d) for d in docs], np.int64)
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(lens) - lens)[lens > 0]] = True
    target = bad[flat] * np.repeat(y == 1, lens)
    inner = ~first[1:]
    a, b = target[:-1][inner], target[1:][inner]
    observed = np.array([[(1 - a) @ (1 - b), (1 - a) @ b], [a @ (1 - b), a @ b]])
    begun = np.array([(1 - target[first]).sum(), target[first].sum()])
    size = len(places)
    w = {"own": np.zeros(size), "before": np.zeros(size), "after": np.zeros(size), "trans": np.zeros((2, 2)), "start": np.zeros(2)}
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    n_words = len(vocabulary)
    for step in range(1, rounds + 1):
        table = np.stack([w["own"][features].sum(1), w["before"][features[:, 0]], w["after"][features[:, 0]]], axis=1)
        s = chain_scores(table[flat], first)
        prob, moves = marginals(s, first, np.exp(w["trans"]), np.exp(w["start"]), pairs=True)
        miss = target - prob
        by_word = np.bincount(flat, miss, n_words)
        before = np.bincount(flat[:-1][inner], miss[1:][inner], n_words)
        after = np.bincount(flat[1:][inner], miss[:-1][inner], n_words)
        grad = {
            "own": np.bincount(features.ravel(), np.repeat(by_word, 6), size),
            "before": np.bincount(features[:, 0], before, size),
            "after": np.bincount(features[:, 0], after, size),
            "trans": observed - moves,
            "start": begun - np.array([(1 - prob[first]).sum(), prob[first].sum()]),
        }
        for k, g in grad.items():
            g = g - l2 * len(docs) * w[k]
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g**2
            w[k] += rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-3)
    trans, start = np.exp(w["trans"]), np.exp(w["start"])
    full = {k: np.zeros(1 << BITS, np.float32) for k in ("own", "before", "after")}
    for k, v in full.items():
        v[places] = w[k]
    return Model(full["own"], full["before"], full["after"], trans, start)


def learn(words: list[list[bytes]], y: np.ndarray, per_class: int = CHAIN_DOCS) -> Model:
    """A chain trained on documents of both classes, not yet calibrated."""
    marked = toxic_forms(words, y)
    picked = np.concatenate([np.flatnonzero(y == label)[:per_class] for label in (0, 1)])
    return _train_chain([words[k] for k in picked], marked, y[picked])


def _summaries(model: Model, texts: list[str]) -> np.ndarray:
    z = summary([p for k in range(0, len(texts), 256) for p in model.probabilities(texts[k : k + 256])]).sum(1)
    model.forget()
    return z


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """The chain and its calibration; a model that scores 0 if the labels don't hold both classes."""
    return fitted(labelled_sample(docs, labels, "toxic", per_class, max_bytes), _train)


def _train(rows: pa.Table) -> Model:
    y, texts = rows.column("y").to_numpy(), rows.column("text").to_pylist()
    shared: dict[bytes, bytes] = {}  # one object for each word
    words = [[shared.setdefault(w, w) for w in tokens_of(t)] for t in texts]
    single = np.flatnonzero(unlike(words))
    y, texts, words = y[single], [texts[k] for k in single], [words[k] for k in single]
    if len(set(y.tolist())) < 2:
        none = np.zeros(1 << BITS, np.float32)
        return Model(none, none, none, np.ones((2, 2)), np.ones(2), fitted=False)
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    z = np.empty(len(y))
    for own in (half, ~half):
        apart = own if len(set(y[~own].tolist())) == 2 else np.zeros(len(y), bool)  # one toxic row: nothing can be left out
        other = learn([words[k] for k in np.flatnonzero(~apart)], y[~apart], CHAIN_DOCS // 2)
        z[own] = _summaries(other, [texts[k] for k in np.flatnonzero(own)])
    model = learn(words, y)
    # one direction for both summaries, and a calibrated slope and offset along it
    a, b = fit_platt(z, y)
    model.slope, model.offset = (a, a), b
    return model


def spans(text: str, prob: np.ndarray, at_least: float = 0.5) -> list[tuple[int, int]]:
    """Code-point offsets of runs of words that are toxic with ``at_least`` that probability."""
    hit = prob >= at_least
    if not hit.any():
        return []
    out: list[tuple[int, int]] = []
    joined = False
    for m, bad in zip(_WORD.finditer(text), hit):
        if bad and joined:
            out[-1] = (out[-1][0], m.end())
        elif bad:
            out.append((m.start(), m.end()))
        joined = bool(bad)
    return out


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``spans`` (start:end, comma-joined) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(part)
        prob = held.value.probabilities(texts)
        found = [",".join(f"{a}:{b}" for a, b in spans(t, p)) for t, p in zip(texts, prob)]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(held.value.scores(prob).astype(float)), pa.array(found, pa.string())], names=["doc_id", "score", "spans"]
        )

    scored = map_slices(docs.select("doc_id", "text"), run, "doc_id long, score double, spans string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all of their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(held.value.scores(held.value.probabilities(texts_of(part))) < threshold))

    return map_slices(docs, run, docs.schema)
