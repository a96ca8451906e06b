"""Operator 2: separator scan over flat, unindexed token files.

A token file is nothing but little-endian 16-bit ids with an end-of-document id after
each document; it is stored as consecutive blocks ``(file_id, block, tokens)``, and a
document may run over any number of them. Counting needs no index:

1. every block is searched for separators at once (one vectorised comparison), which
   gives the places of its separators and its length;
2. a prefix scan over blocks, in two levels so that no task sees all blocks of a file,
   turns these into the number of tokens and documents before each block, and into the
   place of the last separator before it;
3. each separator then closes one document whose length is the distance to the previous.

Defined results: an empty document has length 0; tokens after the last separator form
no document (``unclosed`` reports them); an empty file gives no row; null blocks count
as empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts_of, written
from .word_bpe import loaded

#: Blocks whose sums form one entry of the upper level of the prefix scan.
FAN = 1024


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, block_tokens: int = 1 << 20) -> DataFrame:
    """Tokenise ``docs`` into flat files in the shared folder, one per input split.

    The string of a special token in a text is ordinary text here, so that no text holds
    a separator.

    Columns: ``file_id``, ``block``, ``tokens`` (binary), and ``doc_ids``: the ids of the
    file's documents in order, in portions that have nothing to do with block bounds
    (a document's portion is the block being filled when it was begun).
    """
    schema = "file_id long, block long, tokens binary, first_doc long, doc_ids array<long>"
    arrow = pa.schema([("file_id", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file_id = loaded(tokenizer_path, special=False), TaskContext.get().partitionId()
        held, size, docs_held, first, block = [], 0, [], 0, 0

        def out(tokens: bytes) -> pa.RecordBatch:
            nonlocal docs_held, first, block
            row = [[file_id], [block], [tokens], [first], [docs_held]]
            first, block, docs_held = first + len(docs_held), block + 1, []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(row, arrow)], schema=arrow)

        for part in slices(batches, "text"):
            ids = encoder.encode(texts_of(part), end_id)
            for doc, tokens in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), ids):
                docs_held.append(doc)
                held.append(tokens)
                size += len(tokens)
                while size >= block_tokens:
                    flat = np.concatenate(held)
                    yield out(flat[:block_tokens].astype("<u2").tobytes())
                    held, size = [flat[block_tokens:]], len(flat) - block_tokens
        if size or docs_held:
            yield out(np.concatenate(held).astype("<u2").tobytes())

    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "tokens")


def scan_blocks(blocks: DataFrame, end_id: int) -> DataFrame:
    """Step 1: places of the separators of each block; the ids themselves go no further."""
    schema = "file_id long, block long, n_tokens long, ends array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes, ends = [], []
            for raw in part.column(2):
                ids = np.frombuffer(raw.as_py() or b"", "<u2")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ends])))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), lists], names=["file_id", "block", "n_tokens", "ends"])

    return blocks.select("file_id", "block", "tokens").mapInArrow(run, schema)


def _before(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """Exclusive prefix sums of ``t``, ``d`` and running maximum of ``last`` within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.coalesce(F.sum("t").over(w), F.lit(0))
    return df.select(
        "*",
        tokens.alias("t0"),
        F.coalesce(F.sum("d").over(w), F.lit(0)).alias("d0"),
    )


def stitch(scanned: DataFrame) -> DataFrame:
    """Steps 2 and 3: one row ``(file_id, ordinal, start, n_tokens)`` per closed document."""
    blocks = scanned.withColumns({"t": F.col("n_tokens"), "d": F.size("ends").cast("long"), "chunk": F.floor(F.col("block") / FAN)})
    low = _before(blocks, "block", "file_id", "chunk")
    # where the chunk's last separator stands, counted from the start of the chunk
    last_end = F.when(F.col("d") > 0, F.col("t0") + F.element_at("ends", -1))
    high = low.groupBy("file_id", "chunk").agg(F.sum("t").alias("t"), F.sum("d").alias("d"), F.max(last_end).alias("last"))
    high = _before(high, "chunk", "file_id")
    w = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    high = high.select("file_id", "chunk", F.col("t0").alias("file_tokens"), F.col("d0").alias("file_docs"), F.max(F.col("t0") + F.col("last")).over(w).alias("file_last"))
    w = Window.partitionBy("file_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    low = low.withColumn("chunk_last", F.max(last_end).over(w)).join(high, ["file_id", "chunk"])
    base = F.col("file_tokens") + F.col("t0")
    previous = F.coalesce(F.col("file_tokens") + F.col("chunk_last"), F.col("file_last"), F.lit(-1))
    ends = low.select(
        "file_id", base.alias("base"), (F.col("file_docs") + F.col("d0")).alias("docs_before"), previous.alias("previous"),
        F.posexplode("ends").alias("k", "end"), "ends",
    )
    start = F.when(F.col("k") == 0, F.col("previous")).otherwise(F.col("base") + F.try_element_at("ends", F.col("k"))) + 1
    return ends.select(
        "file_id",
        (F.col("docs_before") + F.col("k")).alias("ordinal"),
        start.alias("start"),
        (F.col("base") + F.col("end") - start).alias("n_tokens"),
    )


def count_tokens(blocks: DataFrame, end_id: int) -> DataFrame:
    """Token counts of all documents in token files given as ``(file_id, block, tokens)``."""
    return stitch(scan_blocks(blocks, end_id))


def unclosed(blocks: DataFrame, end_id: int) -> DataFrame:
    """Tokens after the last separator of each file."""
    counted = count_tokens(blocks, end_id).groupBy("file_id").agg(F.max(F.col("start") + F.col("n_tokens") + 1).alias("used"))
    sizes = scan_blocks(blocks, end_id).groupBy("file_id").agg(F.sum("n_tokens").alias("size"))
    return sizes.join(counted, "file_id", "left").select("file_id", (F.col("size") - F.coalesce("used", F.lit(0))).alias("n_tokens"))


def document_token_counts(docs: DataFrame, tokenizer_path: str, end_id: int, block_tokens: int = 1 << 20) -> DataFrame:
    """Write token files for ``docs``, scan them, and give each count its ``doc_id``."""
    files = write_token_files(docs, tokenizer_path, end_id, block_tokens)
    names = files.select("file_id", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id")).select(
        "file_id", (F.col("first_doc") + F.col("k")).alias("ordinal"), "doc_id"
    )
    return names.join(count_tokens(files, end_id), ["file_id", "ordinal"]).select("doc_id", "file_id", "ordinal", "start", "n_tokens")
