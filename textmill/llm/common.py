"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts handled together inside one Python worker: bounds its memory, not the result.
SLICE_ROWS = 256
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset in a session without other machines (tests) a folder of our own is set.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textmill-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, what: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors lose nothing.

    The table's path is appended to ``paths``, so that its maker can remove it.
    """
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    _WRITTEN.append(out)
    if paths is not None:
        paths.append(out)
    return spark.read.schema(df.schema).parquet(out)


#: Tables that this process has written and not yet removed.
_WRITTEN: list[str] = []


def remove_written(spark: SparkSession, *paths: str) -> None:
    """Remove tables of :func:`written`, all that are left if none is named.

    Results are lazy and read them, so call it without paths once results have been
    written or counted.
    """
    for path in paths or tuple(_WRITTEN):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


#: A key is hot if it holds more than one in so many of all rows, so at most that many are,
#: and more rows than are a burden to any task. A hot key's rows are dealt to ``SALTS`` tasks.
HOT, LEAST, SALTS = 4096, 20_000, 64


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, no task taking more than a small share of ``left``.

    ``right`` holds each key once, with ``n``, its number of rows in ``left``, which has
    ``total`` rows. The rows of hot keys are salted by their other columns, and what
    ``right`` has for them is there once for each salt. The list of hot keys (at most
    ``HOT``) is all that comes to the driver: the plan is a merge at every size.
    """
    least = max(total // HOT, LEAST)
    hot = [r[0] for r in right.where(F.col("n") > least).select(key).collect()] if total > least else []
    right = right.drop("n")
    if not hot:
        return left.join(right.hint("merge"), key, how)
    other = [F.xxhash64(*(c for c in left.columns if c != key))]
    mine = F.col(key).isin(hot)
    salted = left.withColumn("salt_", F.when(mine, F.pmod(other[0], F.lit(SALTS))).otherwise(0))
    salts = F.when(mine, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(right.withColumn("salt_", F.explode(salts)).hint("merge"), [key, "salt_"], how).drop("salt_")


def fitted(sample: DataFrame, train: Callable[[pa.Table], object], order: str = "order"):
    """What ``train`` makes of a bounded ``sample``, in the order of its column ``order``.

    Training runs in one task, so the driver holds no more than the model.
    """
    schema = to_arrow_schema(sample.schema)

    def whole(batches: Iterable[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema)
        return rows.sort_by(order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pickle.dumps(train(whole(batches)))
        for k in range(0, len(raw), 1 << 24):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([raw[k : k + (1 << 24)]], pa.binary())], names=["k", "raw"])

    parts = sample.repartition(1).mapInArrow(run, "k long, raw binary").collect()
    return pickle.loads(b"".join(bytes(r["raw"]) for r in sorted(parts))) if parts else train(whole([]))


def slices(batches: Iterator[pa.RecordBatch], text_at: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice has few rows and few bytes; a long text stays whole."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text_at))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and (size + n > SLICE_CHARS or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; a null text is the empty text."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text_at: str = "text") -> DataFrame:
    """Apply ``fn`` to bounded slices of ``df``; no shuffle."""

    def run(batches):
        for part in slices(batches, text_at):
            yield fn(part)

    return df.mapInArrow(run, schema)


def may_learn(doc_id: Column) -> Column:
    """Rows whose label may be learnt: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> DataFrame:
    """A bounded, deterministic sample of labelled texts: columns ``order``, ``text``, ``y``.

    ``per_class`` labels of either value are taken in the order of a hash of their
    id, so at most ``2 * per_class`` ids are broadcast and as many rows return, one for
    each id. Rows with a null id, a label outside 0 and 1, or a text beyond ``max_bytes``
    are not learnt from (they are scored all the same).
    """
    picked = None
    clean = labels.where(labels[label].isin(0, 1) & may_learn(labels["doc_id"])).select(labels["doc_id"].alias("_id"), labels[label].cast("int").alias("y"))
    for value in (0, 1):
        one = clean.where(F.col("y") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    picked = picked.groupBy("_id").agg(F.max("y").alias("y"))
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    joined = texts.join(F.broadcast(picked), "_id").groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
    return joined.select(F.xxhash64("_id").alias("order"), F.col("t.text").alias("text"), "y")
