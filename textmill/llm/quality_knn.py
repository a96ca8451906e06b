"""Operator 8: nearest-neighbour voting on latent-semantic vectors.

Labelled rows (at most ``PER_CLASS`` of either class, texts of at most ``MAX_BYTES``) are
weighted by inverse document frequency and reduced to ``DIMENSIONS`` by a truncated
singular value decomposition. Their vectors, whose number and width are bounded by these
parameters, are broadcast. Every document is projected, all cosines with the labelled
vectors are computed exactly in blocks, and the ``NEIGHBOURS`` nearest vote for their
label with a weight that grows with similarity.

Defined results: empty and null texts have a zero vector and get the prior 0.5; equal
similarities are taken in the order of the labelled rows; with labels of one class, that
label's score is given, and 0.5 with none; repeated rows and null ids are scored each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, held_out, labelled_sample, map_slices, texts_of
from .features import SIZE, Rows, training_rows, unit_rows

PER_CLASS = 1500
MAX_BYTES = 200_000
DIMENSIONS = 64
NEIGHBOURS = 15
THRESHOLD = 0.5
#: Weight of the prior among the votes, and the power of the similarity.
PRIOR, SHARPNESS = 0.05, 4
_BLOCK = 256


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray

    def project(self, unit: np.ndarray) -> np.ndarray:
        v = unit @ self.basis
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-9)

    def vote(self, v: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(v), 0.5)
        cosines = v @ self.vectors.T
        k = min(NEIGHBOURS, len(self.y))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cosines, near, 1).min(1, keepdims=True)
        tied = np.flatnonzero((cosines >= least).sum(1) > k)  # more rows share the last place: the first of them
        if len(tied):
            near[tied] = np.argsort(-cosines[tied], axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
        return ((weight * self.y[near]).sum(1) + PRIOR * 0.5) / (weight.sum(1) + PRIOR)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.vote(self.project(unit_rows(texts, self.idf)))


def _decompose(rows: Rows, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors of the weighted rows by randomised subspace iteration, in blocks of rows."""
    v, width = rows.units(idf).astype(np.float32), min(DIMENSIONS + 8, max(1, len(rows)))
    starts = np.concatenate([[0], np.cumsum(rows.lens)])

    def block(k: int) -> np.ndarray:
        lo, hi = starts[k], starts[min(k + _BLOCK, len(rows))]
        dense = np.zeros((min(_BLOCK, len(rows) - k), SIZE), np.float32)
        dense[rows.owner[lo:hi] - k, rows.at[lo:hi]] = v[lo:hi]
        return dense

    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((SIZE, width)).astype(np.float32))[0]
    for _ in range(4):
        product = np.zeros_like(basis)
        for k in range(0, len(rows), _BLOCK):
            x = block(k)
            product += x.T @ (x @ basis)
        basis, r = np.linalg.qr(product)
    turn = np.linalg.svd(r)[0]
    return np.ascontiguousarray((basis @ turn)[:, :DIMENSIONS])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """The labelled vectors and what projects other texts onto them."""
    return fitted(training_rows(labelled_sample(docs, labels, "quality", per_class, max_bytes)), _train)


def _train(table: pa.Table) -> Model:
    rows = Rows(table)
    n = max(1, len(rows))
    idf = np.log((1 + n) / (1 + np.bincount(rows.at, minlength=SIZE))).astype(np.float32) + np.float32(0.05)
    if not len(rows):
        return Model(idf, np.zeros((SIZE, 1), np.float32), np.zeros((0, 1), np.float32), rows.y)
    basis = _decompose(rows, idf)
    values = rows.units(idf).astype(np.float32)
    vectors = np.stack([np.bincount(rows.owner, values * column[rows.at], len(rows)) for column in basis.T], axis=1).astype(np.float32)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 1e-9)
    return Model(idf, basis, vectors, rows.y)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value(texts_of(part)).astype(float))], names=["doc_id", "score"])

    scored = map_slices(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
