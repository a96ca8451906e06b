"""Operator 3: quality rules with a calibrated n-gram classifier.

Rule counts come from the whole text, words being runs without ASCII white space. A text
fails the base rules if it has fewer than ``MIN_WORDS`` words, or if over half of its
words stand in 3-word windows that the text holds twice or more. What passes is scored
by a logistic regression over hashed word, word-pair and character n-grams, trained on
labelled rows and calibrated (Platt) on a fourth of them that it didn't see, and is kept
at ``THRESHOLD`` or above.

Training takes at most ``PER_CLASS`` labelled rows of either class, of at most
``MAX_BYTES`` bytes; scoring is in Arrow batches and takes all rows whole.

Defined results: a null text has no words and fails; with labels of one class only, or
none, the classifier keeps what passes the base rules; repeated rows and null ids are
kept each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fitted, labelled_sample, map_slices, texts_of
from .features import Rows, fit_logistic, fit_platt, sigmoid, training_rows, unit_rows

MIN_WORDS = 50
REPEAT_PERCENT = 50
THRESHOLD = 0.5
PER_CLASS = 1500
MAX_BYTES = 200_000
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality double"
)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def __call__(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * (unit_rows(texts) @ self.weights + self.bias) + self.offset)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model | None:
    """The classifier for ``labels.quality``; None if there aren't both classes."""
    return fitted(training_rows(labelled_sample(docs, labels, "quality", per_class, max_bytes)), _train)


def _train(table: pa.Table) -> Model | None:
    rows = Rows(table)
    if len(rows) < 8 or len(set(rows.y)) < 2:
        return None
    apart = np.arange(len(rows)) % 4 == 0
    weights, bias = fit_logistic(rows.take(~apart))
    test = rows.take(apart)
    if len(set(test.y)) < 2:
        test = rows
    margins = np.bincount(test.owner, test.units() * weights[test.at], len(test)) + bias
    return Model(weights, bias, *fit_platt(margins, test.y))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in ``words``."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = np.fromiter(map(often.__contains__, windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= hit
    return int(covered.sum())


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeat_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def judge(texts: list[str], model: Model | None) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base failures, verdicts and probabilities of texts."""
    counts = [rule_counts(t) for t in texts]
    failed = np.array([base_failed(c[0], c[4]) for c in counts], bool)
    quality = np.ones(len(texts)) if model is None else model(texts).astype(float)
    return counts, failed, ~failed & (quality >= THRESHOLD), quality


def apply(docs: DataFrame, model: Model | None) -> DataFrame:
    """Counts, base verdict, final verdict and probability of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, failed, kept, quality = judge(texts_of(part), held.value)
        columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(failed), pa.array(kept), pa.array(quality)], names=names)

    return map_slices(docs.select("doc_id", "text"), run, SCHEMA)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The kept rows of ``docs``, with all of their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(judge(texts_of(part), held.value)[2]))

    return map_slices(docs, run, docs.schema)
