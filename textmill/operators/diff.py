"""Unified diffs: changes stay, context is trimmed, files and hunks are capped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import PIECE, join_lines, text_lines

FILE = r"^diff --git a/.+ b/.+\z"
NO_NEWLINE = r"^\\ No newline at end of file\z"


def marked_lines(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Every line with its ``role``, file number ``f``, hunk number ``h``, and whether it is kept."""
    hunk = r"^@@ -\d+,?\d* \+\d+,?\d* @@" + (".*" if cfg.bare_hunks else ".+") + r"\z"
    line, doc = F.col("line"), Window.partitionBy("doc_id").orderBy("pos")
    rows = text_lines(df, dealt=True).withColumns({"is_file": line.rlike(FILE), "is_hunk": line.rlike(hunk)})
    count = lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    rows = rows.withColumn("f", count(F.col("is_file")).over(doc))
    rows = rows.withColumn("h", count(F.col("is_hunk")).over(Window.partitionBy("doc_id", "f").orderBy("pos")))
    skipped, inside, capped = F.col("f") > cfg.diff_max_files, F.col("h") > 0, F.col("h") > cfg.diff_max_hunks
    role = (
        F.when(F.col("is_file"), "file").when(skipped, "skipped").when(F.col("is_hunk"), "hunk").when(line.rlike(NO_NEWLINE), "no_newline")
        .when(~inside, "outside").when(line.startswith("+"), "add").when(line.startswith("-"), "delete").when(line.startswith(" "), "context").otherwise("other")
    )
    rows = rows.withColumn("role", role)
    change = F.col("role").isin("hunk", "add", "delete")
    rows = rows.withColumn("c", count(change).over(Window.partitionBy("doc_id", "f").orderBy("pos")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "f", "c", "role").orderBy("pos")))
    kept = (
        F.when(F.col("role") == "file", True).when(F.col("role") == "skipped", False).when(F.col("role") == "outside", True).when(capped, False)
        .when(F.col("role") == "context", F.col("k") <= cfg.diff_max_context).otherwise(True)
    )
    return rows.select("doc_id", "pos", "line", "role", "f", "h", kept.alias("kept"))


def stats(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Files, additions, deletions, hunks kept; lines of capped hunks count."""
    rows = marked_lines(df, cfg)
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return rows.groupBy("doc_id").agg(
        F.least(F.max("f"), F.lit(cfg.diff_max_files)).alias("files_affected"), n(F.col("role") == "add").alias("additions"),
        n(F.col("role") == "delete").alias("deletions"), n((F.col("role") == "hunk") & F.col("kept")).alias("hunks_kept"),
    )


def reduce_diff(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``doc_id, compressed``."""
    rows = marked_lines(df, cfg).where("kept").withColumns({"out": F.col("line"), "piece": F.floor(F.col("pos") / PIECE)})
    pieces = rows.groupBy("doc_id", "piece").agg(join_lines(["pos"]).alias("out"))
    return pieces.groupBy("doc_id").agg(join_lines(["piece"]).alias("compressed"))
