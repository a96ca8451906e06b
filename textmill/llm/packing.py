"""Operator 1: sum-of-squares online packing of tokenised documents into windows.

Each task packs the documents of its own input split; nothing is shuffled, so a hot
source or a group of copies is no task's burden. A document is tokenised, ended with
``end_id`` and cut into full windows and a rest. The rest goes, as soon as it is read,
to the fill level that minimises the sum over levels of the squared number of open
windows: the level array holds that number for every fill from 1 to ``window - 1``.
What is still open when the split ends is filled up by cutting the emptiest windows'
pieces, so at most one window per split is padded.

Defined results: a null or empty text is the ``end_id`` alone; the string of a special
token in a text is that token, as the library gives it by default; repeated rows are packed
once each; a null id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, texts_of
from .word_bpe import loaded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Packs a stream of documents; ``rows`` collects finished pieces."""

    def __init__(self, window: int = 2048, first_sequence: int = 0):
        self.window, self.next_sequence = window, first_sequence
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[deque] = [deque() for _ in range(window + 1)]
        self.rows: list[tuple] = []

    def _level(self, size: int) -> int:
        """The fill of the window to take (0: a new one): least growth of the sum of squares, then fullest."""
        counts, window = self.levels, self.window
        fills = np.flatnonzero(counts[: window - size + 1])
        best, growth = 0, 2 * counts[size] + 1
        if len(fills):
            after = counts[fills + size]
            cost = np.where(fills + size == window, 1 - 2 * counts[fills], 2 * (after - counts[fills] + 1))
            k = len(cost) - 1 - int(cost[::-1].argmin())
            if cost[k] <= growth:
                best = int(fills[k])
        return best

    def _emit(self, pieces: list[tuple], sequence: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), _crc(ids), total, sequence, offset))
            offset += len(ids)

    def _sequence(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, start, window = len(ids), 0, self.window
        while total - start >= window:
            self._emit([(doc, start, ids[start : start + window], total)], self._sequence())
            start += window
        size = total - start
        if not size:
            return
        fill = self._level(size)
        if fill:
            pieces, sequence = self.open[fill].popleft()
            self.levels[fill] -= 1
        else:
            pieces, sequence = [], self._sequence()
        pieces.append((doc, start, ids[start:].copy(), total))
        if fill + size == window:
            self._emit(pieces, sequence)
        else:
            self.open[fill + size].append((pieces, sequence))
            self.levels[fill + size] += 1

    def finish(self) -> None:
        """Fill the fullest open windows with what the emptiest hold, cutting where needed."""
        left = deque((fill, *entry) for fill in range(self.window) for entry in self.open[fill])
        while left:
            fill, pieces, sequence = left.pop()
            while fill < self.window and left:
                low, given, other = left.popleft()
                gap = self.window - fill
                doc, start, ids, total = given.pop()
                part = min(gap, len(ids))
                pieces.append((doc, start, ids[:part], total))
                if part < len(ids):
                    given.append((doc, start + part, ids[part:], total))
                fill += part
                if given:
                    left.appendleft((low - part, given, other))
            self._emit(pieces, sequence)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of ``docs`` (``doc_id``, ``text``): where its ids stand in which window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        for part in slices(batches, "text"):
            ids = encoder.encode(texts_of(part), end_id)
            for doc, tokens in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), ids):
                packer.add(doc, tokens)
            yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
