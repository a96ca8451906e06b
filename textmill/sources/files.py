"""Texts from files and request rows, companion files, and the metrics log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = (
    "request_id long, stream boolean, tools array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>, "
    "messages array<struct<role:string,content:string,items:array<struct<type:string,text:string,content:string>>>>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path``, ``text``, and ``doc_id`` from the path's hash."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.withColumn("doc_id", F.xxhash64("path"))


def write_companions(results: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Reduced texts beside their originals' paths; with ``dry_run`` only the frame."""
    out = results.where("was_compressed")
    if not dry_run:
        out.write.mode("overwrite").parquet(path)
    return out


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Request rows, and the rows that are no valid JSON."""
    parsed = F.from_json("value", f"{REQUEST}, bad string", {"columnNameOfCorruptRecord": "bad"})
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", parsed.alias("r"))
    return rows.where("r.bad IS NULL").select("r.*").drop("bad"), rows.where("r.bad IS NOT NULL").select(F.col("value").alias("bad"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def metrics_summary(log: DataFrame) -> DataFrame:
    """Counters over the metrics log."""
    return log.agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("compressed") > 0, 1).otherwise(0)).alias("requests_compressed"),
        F.coalesce(F.sum("compressed"), F.lit(0)).alias("compressions"), F.coalesce(F.sum("chars_saved"), F.lit(0)).alias("chars_saved"),
    )
