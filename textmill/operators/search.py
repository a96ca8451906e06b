"""Search results: the best matches of the best files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import is_blank, join_lines, strip, text_lines

#: Line forms and signal words. Scores are in tenths, so that sums are exact.
MATCH, CONTEXT, OTHER = r"^([^:]+):(\d+):(.+)\z", r"^([^:]+)-(\d+)-(.+)\z", r"^([^:]+):\s*(.+)\z"
HIGH = r"(?i)(error|exception|fail|traceback|crash|fatal|timeout)"
MEDIUM = r"(?i)(warning|deprecated|TODO|FIXME|HACK|BUG|WORKAROUND)"
LOW = r"(?i)(info|debug|log|print|console|note)"


def signal(text: Column) -> Column:
    return F.when(text.rlike(HIGH), 100).when(text.rlike(MEDIUM), 50).when(text.rlike(LOW), 10).otherwise(20)


def parsed(df: DataFrame) -> DataFrame:
    """``doc_id, pos, file, lnum, match, score``; a continuation line is part of the match before it."""
    line = F.col("line")
    form = (
        F.when(line.rlike(MATCH), 1).when(line.rlike(CONTEXT), 2)
        .when(line.rlike(OTHER) & ~F.regexp_extract(line, OTHER, 1).endswith(".") & (F.length(F.regexp_extract(line, OTHER, 1)) > 2), 3).otherwise(0)
    )
    rows = text_lines(df, dealt=True).where(strip(line) != "--").withColumn("form", form)
    pick = lambda k: F.when(F.col("form") == 1, F.regexp_extract(line, MATCH, k)).when(F.col("form") == 2, F.regexp_extract(line, CONTEXT, k))
    rows = rows.select(
        "doc_id", "pos", "line", "form",
        pick(1).otherwise(F.regexp_extract(line, OTHER, 1)).alias("file"),
        F.coalesce(pick(2).try_cast("int"), F.lit(0)).alias("lnum"),
        pick(3).otherwise(F.regexp_extract(line, OTHER, 2)).alias("match"),
    )
    follows = (F.col("form") == 0) & ((~is_blank(line) & line.startswith("   ")) | line.startswith("\t"))
    rows = rows.where((F.col("form") > 0) | follows)
    rows = rows.withColumn("g", F.sum(F.when(F.col("form") > 0, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("pos"))).where("g > 0")
    text = F.when(F.col("form") > 0, F.col("match")).otherwise(strip(line))
    first = F.min_by(F.struct("file", "lnum", "match", "form", "pos"), "pos").alias("f")
    out = rows.withColumn("out", text).groupBy("doc_id", "g").agg(first, join_lines(["pos"]).alias("match"))
    score = signal(F.col("f.match"))
    score = F.when(F.col("f.form") == 2, (score * 3 / 10).cast("int")).otherwise(score)
    return out.select("doc_id", F.col("f.pos").alias("pos"), F.col("f.file").alias("file"), F.col("f.lnum").alias("lnum"), "match", score.alias("score"))


def ranked_files(matches: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The files of a text by total score, first seen first on ties: ``rank`` up to the limit."""
    files = matches.groupBy("doc_id", "file").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("total"), "first_pos")
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.search_max_files)


def picked(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The shown matches, with their file's rank; files stop after the one that reaches the total.

    Lines are cut and parsed once; everything after is a window within the text.
    """
    limit, file, doc = cfg.search_max_per_file, Window.partitionBy("doc_id", "file"), Window.partitionBy("doc_id")
    rows = parsed(df).withColumns({"total": F.sum("score").over(file), "n": F.count(F.lit(1)).over(file), "first_pos": F.min("pos").over(file)})
    rows = rows.withColumn("rank", F.dense_rank().over(doc.orderBy(F.desc("total"), "first_pos"))).where(F.col("rank") <= cfg.search_max_files)
    rows = rows.withColumn("rn", F.row_number().over(file.orderBy(F.desc("score"), "lnum", "pos")))
    rows = rows.where((F.col("n") <= limit) | (F.col("rn") <= limit - 2) | (F.col("rn") == F.col("n")))
    same = F.row_number().over(Window.partitionBy("doc_id", "file", "lnum", "match", "score").orderBy("rn"))
    rows = rows.withColumn("same", same).where((F.col("n") <= limit) | (F.col("rn") <= limit - 2) | (F.col("same") == 1))
    rows = rows.withColumns({"k": F.count(F.lit(1)).over(file), "once": F.row_number().over(file.orderBy("rn")) == 1})
    earlier = doc.orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"before": F.coalesce(F.sum(F.when(F.col("once"), F.col("k"))).over(earlier), F.lit(0)), "n_top": F.max("rank").over(doc)})
    rows = rows.where(F.col("before") < cfg.search_max_total)
    return rows.select("doc_id", "file", "rank", "n", "k", F.col("n_top").cast("long").alias("n_top"), "lnum", "match", "rn")


def reduce_search(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``doc_id, compressed, compressed_files, compressed_matches``."""
    rows = picked(df, cfg).withColumn("out", F.concat(F.lit("  "), F.col("lnum"), F.lit(":"), F.col("match")))
    files = rows.groupBy("doc_id", "file", "rank", "n", "k", "n_top").agg(join_lines(["lnum", "rn"]).alias("body"))
    title = F.concat(F.lit("# "), F.col("file"), F.lit(" ("), F.col("k"), F.lit("/"), F.col("n"), F.lit(" matches)\n"), F.col("body"))
    texts = files.withColumn("out", title).groupBy("doc_id").agg(
        join_lines(["rank"]).alias("shown"), F.count(F.lit(1)).alias("shown_files"), F.max("n_top").alias("compressed_files"), F.sum("k").alias("compressed_matches")
    )
    left = F.col("compressed_files") - F.col("shown_files")
    more = F.when(left > 0, F.concat(F.lit("\n... "), left, F.lit(" more files with matches ..."))).otherwise("")
    return texts.select("doc_id", F.concat("shown", more).alias("compressed"), "compressed_files", "compressed_matches")
