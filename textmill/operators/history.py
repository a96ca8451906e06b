"""Conversation history: old, large user turns give way to a marker that names their key.

Turns are rows ``conv_id, turn, role, text``, with ``items`` (typed parts: ``type, text,
content``) where a turn has a list instead of a text. Only user turns outside the most
recent ones are candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .pipeline import reduce_all


def turn_chars(turns: DataFrame) -> Column:
    """Size of a turn: its text, or the contents (not the texts) of its items."""
    size = F.coalesce(F.length("text"), F.lit(0))
    if "items" not in turns.columns:
        return size
    return size + F.coalesce(F.aggregate("items", F.lit(0), lambda acc, i: acc + F.coalesce(F.length(i["content"]), F.lit(0))), F.lit(0))


def candidate_text(turns: DataFrame, cfg: Config = Config()) -> Column:
    """What of a turn may be reduced: a text that isn't short, else the first such tool result or text item."""
    big = lambda c: F.when(F.length(c) >= cfg.history_candidate_chars, c)
    text = big(F.col("text"))
    if "items" not in turns.columns:
        return text
    parts = F.transform("items", lambda i: F.when(i["type"] == "tool_result", big(i["content"])).when(i["type"] == "text", big(i["text"])))
    return F.coalesce(text, F.when(F.col("text").isNull(), F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0))))


def sized(turns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``turns`` with the conversation's ``total_chars`` and whether that triggers reduction."""
    total = F.sum(turn_chars(turns)).over(Window.partitionBy("conv_id"))
    return turns.withColumn("total_chars", total).withColumn("triggered", F.col("total_chars") > cfg.history_threshold_chars)


def conversation_sizes(turns: DataFrame, cfg: Config = Config()) -> DataFrame:
    sizes = turns.groupBy("conv_id").agg(F.sum(turn_chars(turns)).alias("total_chars"))
    return sizes.withColumn("triggered", F.col("total_chars") > cfg.history_threshold_chars)


def candidates(turns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``turns`` with ``candidate``: triggered, an old user turn, and not short."""
    said = F.col("role").isin("user", "assistant")
    recent = F.row_number().over(Window.partitionBy("conv_id", said).orderBy(F.desc("turn")))
    old = said & (recent > cfg.history_keep_recent)
    big = candidate_text(turns, cfg).isNotNull()
    return sized(turns, cfg).withColumn("candidate", F.coalesce(F.col("triggered") & old & (F.col("role") == "user") & big, F.lit(False)))


def reduced_turns(turns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The common result of every accepted candidate, with ``conv_id``, ``turn`` and its ``text``."""
    rows = candidates(turns, cfg).where("candidate").select(F.lit(None).cast("long").alias("doc_id"), "conv_id", "turn", candidate_text(turns, cfg).alias("text"))
    return reduce_all(rows, cfg, keep=("conv_id", "turn", "text")).where("was_compressed").drop("doc_id")


def marker() -> Column:
    return F.format_string("[Reduced: text of turn %d (%d%% saved), restore=%s]", "turn", F.bround("compression_pct", 0).cast("int"), "hash")


def rewrite(turns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``conv_id, turn, role, text[, items], hash``: markers in place of accepted candidates."""
    done = reduced_turns(turns, cfg).select("conv_id", "turn", "hash", marker().alias("marker"), F.col("text").alias("old"))
    joined = turns.join(done, ["conv_id", "turn"], "left")
    text = F.when(F.col("text") == F.col("old"), F.col("marker")).otherwise(F.col("text")).alias("text")
    if "items" not in turns.columns:
        return joined.select("conv_id", "turn", "role", text, "hash")

    def swap(i: Column) -> Column:
        new = lambda kind, c: F.when((i["type"] == kind) & (i[c] == F.col("old")), F.col("marker")).otherwise(i[c])
        return i.withField("content", new("tool_result", "content")).withField("text", new("text", "text"))

    items = F.when(F.col("hash").isNotNull(), F.transform("items", swap)).otherwise(F.col("items"))
    return joined.select("conv_id", "turn", "role", text, items.alias("items"), "hash")


def stats(turns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per conversation: size, trigger, reductions, what they save, and an entry for each in order."""
    entry = F.struct("turn", "hash", F.col("original_chars").alias("original_size"), F.length(marker()).alias("compressed_size"), F.col("compression_pct").alias("savings_pct"))
    done = reduced_turns(turns, cfg).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("compressed_count"), F.sum("chars_saved").alias("chars_saved"), F.sum("est_token_savings").alias("tokens_saved_estimate"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    zero = {"compressed_count": 0, "chars_saved": 0, "tokens_saved_estimate": 0}
    return conversation_sizes(turns, cfg).join(done, "conv_id", "left").na.fill(zero)
