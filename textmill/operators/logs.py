"""Logs and build output: repeated line patterns become one line and a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import is_blank, join_lines, strip, text_lines

#: What a line is known by.
STACK = r'^\s*(File ".*?", line \d+|Traceback|  File |^  \w+|During handling|^    \w+\.\w+)'
ERROR = r"(?i)(ERROR|FATAL|CRITICAL|FAILED|Error:|FATAL:)"
WARN = r"(?i)(WARN|WARNING)"
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]?\d{2}:\d{2}(:\d{2}([.,]\d+)?)?"
PATH = r"/[\w./-]+(?:\s|:|\z)"


def normalized(line: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(line, TIMESTAMP, "<TS>"), PATH, "<PATH>"))


def line_score(line: Column) -> Column:
    """Importance: error 10, stack trace 8, warning 3, FAIL 5."""
    return (
        F.when(line.rlike(ERROR), 10).otherwise(0)
        + F.when(line.rlike(STACK), 8).otherwise(0)
        + F.when(line.rlike(WARN), 3).otherwise(0)
        + F.when(F.contains(line, F.lit("FAIL")), 5).otherwise(0)
    )


def classified(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``doc_id, pos, line, blank, norm, score, is_error, is_stack`` of every line."""
    line, blank = F.col("line"), is_blank(F.col("line"))
    return text_lines(df, dealt=dealt).select(
        "doc_id", "pos", "line", blank.alias("blank"),
        F.when(blank, "").otherwise(normalized(line)).alias("norm"), F.when(blank, 0).otherwise(line_score(line)).alias("score"),
        (~blank & line.rlike(ERROR)).alias("is_error"), (~blank & line.rlike(STACK)).alias("is_stack"),
    )


def patterns(df: DataFrame) -> DataFrame:
    """Occurrences of each pattern of a text."""
    return classified(df).where(~F.col("blank") & (F.col("norm") != "")).groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def kept_lines(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Output lines ``doc_id, pos, sub, out``, in order of pos and sub, with the headline and the cap.

    Pieces of texts are dealt out by id once, before they are cut into lines; all windows keep to that.
    """
    group = Window.partitionBy("doc_id", "norm", "blank")
    order = group.orderBy("pos")
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole, doc = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("pos")
    rows = classified(df, dealt=True).withColumns({
        "n": F.count(F.lit(1)).over(group),
        "new": F.row_number().over(order) == 1,
        "rn": F.row_number().over(Window.partitionBy("doc_id", "norm", "blank", "is_stack").orderBy("pos")),
        "first": F.first("line").over(full),
        "last": F.last("line").over(full),
    })
    rows = rows.withColumns({
        "n_lines": F.count(F.lit(1)).over(whole),
        "n_unique": F.count(F.when(F.col("new") & ~F.col("blank") & (F.col("norm") != ""), 1)).over(whole),
    })
    rows = rows.where(F.col("blank") | F.col("is_stack") | (F.col("rn") == 1))
    many = (F.col("n") >= cfg.log_min_repetitions) & ~F.col("is_stack")
    counted = F.concat(F.lit("[x"), F.col("n"), F.lit("] "), F.col("first"))
    twice = many & (F.col("last") != F.col("first")) & F.lit(cfg.log_keep_first_last)
    out = F.when(F.col("blank"), F.array(F.lit(""))).when(twice, F.array(counted, F.concat(F.lit("[last]  "), F.col("last")))).when(many, F.array(counted))
    # a text's first line is always among the rows: the headline stands before it
    headed = (F.col("pos") == 0) & (F.col("n_lines") > 20)
    headline = F.array(F.format_string("# %d lines, %d unique patterns", "n_lines", "n_unique"))
    before = F.when(headed, F.lit(False)).otherwise(F.lag("blank").over(doc))
    rows = rows.select("doc_id", "pos", "blank", out.otherwise(F.array("line")).alias("outs"), headed.alias("headed"), headline.alias("headline"), before.alias("before"))
    rows = rows.where(~F.col("blank") | (F.col("before") == F.lit(False)))
    lines = rows.select("doc_id", "pos", F.posexplode(F.when(F.col("headed"), F.concat("headline", "outs")).otherwise(F.col("outs"))).alias("sub", "out"))
    cap, half = cfg.log_max_lines_total, cfg.log_max_lines_total // 2
    lines = lines.withColumns({"r": F.row_number().over(whole.orderBy("pos", "sub")), "c": F.count(F.lit(1)).over(whole)})
    lines = lines.where((F.col("c") <= cap) | (F.col("r") <= half) | (F.col("r") > F.col("c") - half))
    cut = F.concat(F.lit("... "), F.col("c") - cap, F.lit(" more lines truncated ..."))
    both = F.when((F.col("c") > cap) & (F.col("r") == half), F.array(F.col("out"), cut)).otherwise(F.array("out"))
    return lines.select("doc_id", F.col("r").alias("pos"), F.posexplode(both).alias("sub", "out"))


def reduce_logs(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``doc_id, compressed, compressed_lines``."""
    return kept_lines(df, cfg).groupBy("doc_id").agg(join_lines(["pos", "sub"]).alias("compressed"), F.count(F.lit(1)).alias("compressed_lines"))


def repetitions_saved(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Lines that counts stand for, beyond the first of each pattern."""
    rows = classified(df).where(~F.col("blank")).groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("is_stack").alias("only_stack"))
    hit = (F.col("n") >= cfg.log_min_repetitions) & ~F.col("only_stack")
    return rows.groupBy("doc_id").agg(F.sum(F.when(hit, F.col("n") - 1).otherwise(0)).alias("repetitions_saved"))


def collapse_blocks(df: DataFrame, least: int = 3) -> DataFrame:
    """Opt-in: runs of equal blank-separated blocks become the first block and a count.

    A block is a run of lines without a blank; adjacent blocks whose normalized lines are
    equal form an island; islands of ``least`` or more are shortened.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    rows = classified(df).withColumn("block", F.sum(F.when(F.col("blank"), 1).otherwise(0)).over(doc)).where(~F.col("blank"))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm", "line"))), lambda x: F.struct(x["norm"], x["line"]))
    blocks = rows.groupBy("doc_id", "block").agg(shape.alias("lines"), F.min("pos").alias("pos"))
    blocks = blocks.withColumn("key", F.transform("lines", lambda x: x["norm"]))
    order = Window.partitionBy("doc_id").orderBy("block")
    change = F.when(F.col("key") == F.lag("key").over(order), 0).otherwise(1)
    blocks = blocks.withColumn("change", change).withColumn("island", F.sum("change").over(order))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "island"))
    place = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("block"))
    blocks = blocks.withColumns({"n": size, "k": place}).where((F.col("n") < least) | (F.col("k") == 1))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    out = F.when(F.col("n") >= least, F.concat(F.lit("[x"), F.col("n"), F.lit("] "), text)).otherwise(text)
    return blocks.select("doc_id", "pos", out.alias("out")).groupBy("doc_id").agg(join_lines(["pos"]).alias("compressed"))
