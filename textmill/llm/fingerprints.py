"""Operator 7: canonical exact digests of documents.

A text is brought into canonical form (NFKC, case folding, NFKC again, runs of white
space to one space, trimmed) and digested with 128-bit xxhash. Equal digests are a
bucket; inside a bucket the canonical bytes are compared with those of one member, and
members that differ get their own digest's suffix, so equal fingerprints mean equal
canonical texts.

``edited_fingerprints`` compares each document with an edited copy and with its
neighbour in descending order of ids: the rows are range-partitioned and sorted once,
each task streams over its range, and the two rows at the ends of a range meet those of
the next range through a small written table.

Defined results: a null text is empty; an empty text has the digest of no bytes; texts
of 0 or 1 code points are their own edited text; rows with equal ids are ordered by
text, descending; rows with a null id come last; a single row is its own neighbour; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, map_slices, slices, texts_of, written

#: Size of the bitmap that tells which texts to compare byte by byte (4 MB).
FILTER_BITS = 1 << 25


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(canonical_text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical_text.encode())


def _row(doc, text: str, following: str) -> tuple:
    """One result row, given the text of the next document."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half] if half else text
    own, other, near = canonical(text), canonical(edited), canonical(following)
    return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own), digest(other), float(own == other), float(own == near))


_DIGESTS = [pa.int64(), pa.string(), pa.string()]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = "part long, at_end boolean, text string"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.string()]
_NAMES = [f.split()[0] for f in f"{_RESULT}, {_EDGE}".split(", ")]


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` and ``canonical`` of every text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        forms = [canonical(t) for t in texts_of(part)]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([digest(f) for f in forms], pa.string()), pa.array(forms, pa.string())], names=["doc_id", "digest", "canonical"]
        )

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, digest string, canonical string")


def _shared_digests(digested: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits, whatever the input: set for each digest that more than one row has.

    It is only a filter that spares texts the shuffle: a bit set by another digest lets
    some more rows through.
    """
    shared = digested.groupBy("fingerprint").count().where("count > 1")
    place = F.xxhash64("fingerprint").bitwiseAND(FILTER_BITS - 1)
    parts = shared.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(0x7FFF).alias("bit"))
    bitmap = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for part, bits in parts.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        bitmap[part] = np.frombuffer(bits, np.uint8)
    return bitmap.ravel()


def collisions(docs: DataFrame, digested: DataFrame) -> DataFrame:
    """Byte comparison inside equal buckets: rows of buckets whose canonical texts are not all the same bytes.

    A bucket's texts are all equal if the least and the greatest are; both are found by
    partial aggregation, so a hot bucket sends one row from each task.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(_shared_digests(digested))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(part.column(0).to_pylist(), texts_of(part)):
            form = canonical(text)
            key = digest(form)
            place = xxhash.xxh64_intdigest(key, 42) & (FILTER_BITS - 1)
            if bitmap.value[place >> 3] >> (place & 7) & 1:
                rows.append((doc, key, form))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, _DIGESTS)], names=["doc_id", "digest", "canonical"])

    members = map_slices(docs.select("doc_id", "text"), run, "doc_id long, digest string, canonical string")
    mixed = members.groupBy("digest").agg(F.min("canonical").alias("least"), F.max("canonical").alias("most")).where("least <> most")
    mixed = written(mixed.select("digest", "least"), "mixed")
    if mixed.isEmpty():
        return mixed.select(F.lit(None).cast("long").alias("doc_id"), "digest", F.lit("").alias("own"))
    return (
        members.join(mixed, "digest").where(F.col("canonical") != F.col("least"))
        .select("doc_id", "digest", F.concat("digest", F.lit("-"), F.sha2("canonical", 256)).alias("own"))
        .distinct()
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``group_id``: the smallest id with the same canonical text."""
    marked = written(digests(docs).select("doc_id", F.col("digest").alias("fingerprint")), "digests")
    marked = _resolved(docs, marked)
    groups = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    return join_hot(marked, groups, "fingerprint", marked.count()).select("doc_id", "fingerprint", "group_id")


def _resolved(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``marked`` with the suffix of rows that share a digest but not its bytes."""
    apart = written(collisions(docs, marked), "collisions")
    if apart.isEmpty():
        return marked
    apart = apart.select(F.col("doc_id").alias("of"), "digest", "own")
    joined = marked.join(apart, marked["doc_id"].eqNullSafe(apart["of"]) & (marked["fingerprint"] == apart["digest"]), "left")
    return joined.select(*(F.coalesce("own", "fingerprint").alias(c) if c == "fingerprint" else marked[c] for c in marked.columns))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = TaskContext.get().partitionId(), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        nothing = (None,) * 7
        for part in slices(batches, "text"):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), texts_of(part)):
                if held is None:
                    rows.append((*nothing, place, False, text))
                else:
                    rows.append((*_row(*held, text), None, None, None))
                held = (doc, text)
            if rows:
                yield out(rows)
        if held is not None:
            yield out([(held[0], *nothing[1:], place, True, held[1])])

    by = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(by[0]).sortWithinPartitions(*by)
    parts = written(ordered.mapInArrow(run, f"{_RESULT}, {_EDGE}"), "edited")
    done = parts.where(F.col("part").isNull()).select(*_NAMES[:7])
    heads = parts.where(~F.col("at_end")).select("part", F.col("text").alias("following"))
    ring = Window.orderBy("part")  # one short row for each range, at most as many as tasks
    after = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)))
    last = parts.where("at_end").select("part", "doc_id", "text").join(after, "part").join(heads.withColumnRenamed("part", "next"), "next")

    def close(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_row(*x) for x in zip(part.column(0).to_pylist(), texts_of(part), texts_of(part, "following"))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, _TYPES)], names=_NAMES[:7])

    done = done.unionByName(map_slices(last.select("doc_id", "text", "following"), close, _RESULT))
    return _resolved(docs, done)
