"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
#: Bytes of a row group, which a reader holds at once, and rows until its size is looked at, which a writer holds.
_ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only in a session without executors elsewhere."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textmill-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, what: str, *partitions: str) -> DataFrame:
    """``df`` written once and read back, in folders by ``partitions``; a few large texts fill a row group."""
    out = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).options(**_ROW_GROUPS).parquet(out)
    _WRITTEN.append(out)
    # the shuffle files behind the table go as soon as the driver has collected what refers to them
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables; results that read them must have been used by then."""
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
