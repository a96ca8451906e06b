"""Long prose: head and tail, cut at natural boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config


def cuts(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``df`` with ``head_end`` and ``tail_start``, 0-based, for texts over the limit.

    The head ends after the first paragraph break (else line end) within the look-ahead;
    the tail begins after the last one within the look-back.
    """
    head, look = cfg.text_head_chars, cfg.boundary_chars
    at = F.length("text") - cfg.text_tail_chars
    begin = F.greatest(F.lit(0), at - look)
    ahead = F.substring("text", head + 1, look)
    back = F.reverse(F.substr("text", begin + 1, at - begin))
    run = F.length(F.regexp_extract(back, "^(?s)(.*?\\n\\n+)", 1))
    gap, line = F.instr(ahead, "\n\n"), F.instr(ahead, "\n")
    size = at - begin
    return df.withColumns({
        "head_end": F.when(gap > 0, head + gap).when(line > 0, head + line).otherwise(head + F.length(ahead)),
        "tail_start": F.when(run > 0, begin + size - run + 1).when(F.instr(back, "\n") > 0, begin + size - F.instr(back, "\n") + 1).otherwise(at),
    })


def reduce_text(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``df`` with ``compressed`` and ``mode``; short texts are unchanged."""
    cut = cuts(df, cfg)
    dropped = F.greatest(F.lit(0), F.col("tail_start") - F.col("head_end"))
    marker = F.format_string("\n... [middle left out: ~%,d chars / ~%,d words] ...\n", dropped.cast("long"), F.floor(dropped / 5).cast("long"))
    tail = F.substr("text", F.greatest(F.col("tail_start"), F.col("head_end")) + 1, F.length("text"))
    short = F.concat(F.substr("text", F.lit(1), F.col("head_end")), marker, tail)
    new = F.when(F.length("text") > cfg.text_max_chars, short).otherwise(F.col("text"))
    return cut.withColumns({"compressed": new, "mode": F.lit("text_summary")}).drop("head_end", "tail_start")
