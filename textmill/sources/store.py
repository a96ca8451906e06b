"""Content-addressed restore store: a Parquet table keyed by the SHA-256 of the original.

Columns: ``sha256``, ``hash`` (its first characters, which markers show), ``original, compressed, content_type, original_chars, compressed_chars,
original_lines, compressed_lines, compression_pct, compressed_at``, in folders by the
first two characters of the hash, so a lookup reads only the folders of its keys. Originals
that share the short hash are all kept, and a lookup by it gives them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content_key, percent_saved

SCHEMA = (
    "sha256 string, hash string, original string, compressed string, content_type string, original_chars int, compressed_chars int, original_lines int, "
    "compressed_lines int, compression_pct double, compressed_at timestamp"
)
COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]


def entries(results: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Store rows of ``doc_id, text, compressed, content_type[, compressed_at]``, one for each text (the smallest id's)."""
    lines = lambda c: F.size(F.split(c, "\n", -1))
    at = F.col("compressed_at") if "compressed_at" in results.columns else F.current_timestamp()
    rows = results.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256)).withColumn("compressed_at", at)
    # by partial aggregation: a text that a third of all rows share is one row from each task
    kept = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text", "compressed", "content_type", "compressed_at")).alias("e")
    first = rows.groupBy("sha256").agg(kept).select("sha256", "e.*")
    return first.select(
        "sha256", content_key(F.col("text"), cfg.hash_length).alias("hash"), F.col("text").alias("original"), "compressed", "content_type", F.length("text").alias("original_chars"), F.length("compressed").alias("compressed_chars"),
        lines("text").alias("original_lines"), lines("compressed").alias("compressed_lines"), percent_saved(F.length("text"), F.length("compressed")).alias("compression_pct"),
        "compressed_at",
    )


def fresh(new: DataFrame, store: DataFrame) -> DataFrame:
    """Entries that the store doesn't hold yet."""
    return new.join(store.select("sha256"), "sha256", "left_anti")


def retained(store: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The newest entries up to the limit, by time of writing, then hash."""
    return store.orderBy(F.desc("compressed_at"), "hash").limit(cfg.store_max_entries)


def lookup(keys: DataFrame, store: DataFrame, column: str = "original") -> DataFrame:
    """``keys`` (``hash``) with the stored text, null where there is none."""
    return keys.join(store.select("hash", column), "hash", "left")


def stats(store: DataFrame, cfg: Config = Config()) -> DataFrame:
    return store.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.octet_length("original") + F.octet_length("compressed")), F.lit(0)).alias("total_bytes"),
        F.lit(cfg.store_max_entries).alias("max_entries"),
    )


class Store:
    """The store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, cfg: Config = Config()):
        self.spark, self.path, self.cfg = spark, path, cfg

    def _path(self, suffix: str = ""):
        """The file system and the path beside the store with that suffix."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path.rstrip("/") + suffix)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def read(self) -> DataFrame:
        (fs, now), (_, old) = self._path(), self._path(".old")
        if not fs.exists(now) and fs.exists(old):  # an eviction was cut off
            fs.rename(old, now)
        if not fs.exists(now):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(f"{SCHEMA}, shard string").option("ignoreCorruptFiles", "true").parquet(self.path)

    def put(self, results: DataFrame) -> None:
        """Append what is new; one write for a whole batch."""
        new = fresh(entries(results, self.cfg), self.read())
        new.withColumn("shard", F.substring("hash", 1, 2)).write.mode("append").partitionBy("shard").parquet(self.path)

    def get(self, keys: DataFrame, column: str = "original") -> DataFrame:
        sharded = keys.withColumn("shard", F.substring("hash", 1, 2))
        return sharded.join(self.read().select("shard", "hash", column), ["shard", "hash"], "left").drop("shard")

    def evict(self) -> None:
        """Rewrite the store with the entries that stay; at every moment the old or the new one is whole."""
        kept = retained(self.read().select(*COLUMNS), self.cfg).withColumn("shard", F.substring("hash", 1, 2))
        (fs, now), (_, fresh_path), (_, old) = self._path(), self._path(".next"), self._path(".old")
        kept.write.mode("overwrite").partitionBy("shard").parquet(fresh_path.toString())
        if fs.exists(now):
            fs.delete(old, True)
            fs.rename(now, old)
        fs.rename(fresh_path, now)
        fs.delete(old, True)

    def clear(self) -> None:
        for suffix in ("", ".old", ".next"):
            fs, path = self._path(suffix)
            fs.delete(path, True)
