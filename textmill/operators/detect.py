"""Gate, classification of texts, and savings columns.

Only the first 20 lines are looked at. A wholly valid JSON object or array wins outright;
else the kind with most hits, ties in the order of ``KINDS``; a short text, or one without
hits, is prose.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content_key, is_whole_json, percent_saved

#: The kinds in the order that decides ties, and their patterns.
PATTERNS = {
    "file_listing": [r"^total \d+|^[dlrwxs-]{10}\s+\d+\s+\S+\s+\S+\s+"],
    "diff": [r"^(diff --git |diff --combined |diff --cc |--- a/|@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@)"],
    "code_python": [r"^\s*(def |class |import |from |async def |@\w+)"],
    "code_javascript": [r"^\s*(function |const |let |var |import |export |=>)"],
    "code_typescript": [r"^\s*(interface |type |enum |namespace )", r":\s*(string|number|boolean|any)\b"],
    "code_go": [r"^\s*(func |type |package |import )"],
    "code_rust": [r"^\s*(fn |struct |enum |impl |mod |use |pub )", r"^\s*#\["],
    "search_results": [r"^[^\s:]+:(\d+:|\s)|^[^\s:]+-\d+-"],
    "logs": [r"\[INFO\]|\[ERROR\]|\[WARN\]|\[DEBUG\]|\[TRACE\]|\[FATAL\]|\[CRITICAL\]|\d{4}-\d{2}-\d{2}T|\d{2}:\d{2}:\d{2}"],
    "build_output": [r"(?i)(error:|warning:|FAILED|passed|failed|✓|✘|×)"],
}
LOOKED_AT = {"file_listing": 3, "diff": 10, "search_results": 20, "logs": 20, "build_output": 20}
AT_LEAST_3 = {"search_results", "logs", "build_output"}
DATED = r"^(\[?[A-Z]+\]?:? )?\[?\d{4}-\d{2}-\d{2}"
KINDS = ["json", *PATTERNS, "code_generic", "text"]
REDUCERS = {
    "json": "json_crusher", "logs": "log_deduper", "build_output": "log_deduper", "code_python": "code_python", "code_javascript": "code_generic",
    "code_typescript": "code_generic", "code_go": "code_generic", "code_rust": "code_generic", "file_listing": "file_listing",
    "search_results": "search", "diff": "diff", "text": "text",
}


def is_json(text: Column) -> Column:
    """Valid JSON as a whole, and an object or array."""
    return F.coalesce(text.rlike(r"^\s*[\[{]") & is_whole_json(text), F.lit(False))


def _hits(text: Column, kind: str, cfg: Config) -> Column:
    """Lines that match, counted in the text: functions on arrays would copy the whole row, text included."""
    part = F.substring_index(text, "\n", LOOKED_AT.get(kind, 15))
    unless = f"(?!{DATED})" if kind == "search_results" and cfg.date_prefix_is_log else ""

    def matching(pattern: str) -> Column:
        inside = re.sub(r"\[\^\\s|\\s", lambda m: m[0] if m[0] != r"\s" else r"[^\S\n]", pattern)
        return F.regexp_count(part, F.lit(rf"(?dm)^{unless}[^\n]*?(?:{inside})"))

    hits = sum((matching(p) for p in PATTERNS[kind][1:]), matching(PATTERNS[kind][0]))
    return F.when(hits >= 3, hits).otherwise(0) if kind in AT_LEAST_3 else hits


def scores(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``df`` with one hit count per kind, ``hits_<kind>``."""
    return df.select(*df.columns, *(_hits(F.substring_index(df["text"], "\n", 20), k, cfg).alias(f"hits_{k}") for k in PATTERNS))


def detect(df: DataFrame, cfg: Config = Config(), hint: str | None = None) -> DataFrame:
    """``df`` with ``content_type``; a valid value of the column ``hint`` overrides detection."""
    given = df[hint] if hint else F.lit(None).cast("string")
    known = F.when(given.isin(KINDS), given)
    head = F.substring_index(df["text"], "\n", 20)
    best = F.array_max(F.array(*(F.struct(_hits(head, k, cfg).alias("hits"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(PATTERNS))))
    own = [c for c in df.columns if c != "content_type"]
    scored = df.select(*own, known.alias("known_kind"), F.when(known.isNull(), best).alias("best_kind"))
    found = (
        F.when(F.col("known_kind").isNotNull(), F.col("known_kind"))
        .when(F.coalesce(F.length("text"), F.lit(0)) < 16, "text")
        .when(is_json(F.col("text")), "json")
        .when(F.col("best_kind.hits") > 0, F.col("best_kind.kind"))
        .otherwise("text")
    )
    return scored.select(*own, found.alias("content_type"))


def large_enough(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Texts worth reducing; the length column, where there is one, lets the scan prune."""
    size = F.col("n_chars") if "n_chars" in df.columns else F.length("text")
    return df.where(size > cfg.min_compress_chars)


def accounted(reduced: DataFrame, cfg: Config = Config(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The common result: accept a reduction that is strictly shorter, and state what it saves.

    Takes ``doc_id, content_type, compressor, mode, text, compressed`` and what to ``keep``;
    ``original_chars`` and ``hash`` in place of ``text``, where they are known.
    """
    known = "original_chars" in reduced.columns
    before, after = F.col("original_chars") if known else F.length("text"), F.length("compressed")
    key = F.col("hash") if known else content_key(F.col("text"), cfg.hash_length)
    ok = F.col("compressor").isNotNull() & (after < before)
    saved = before - after
    return reduced.select(
        "doc_id", *keep, "content_type", "compressor", "mode", before.alias("original_chars"), after.alias("compressed_chars"), ok.alias("was_compressed"),
        F.when(ok, saved).alias("chars_saved"), F.when(ok, F.floor(saved / 4).cast("int")).alias("est_token_savings"),
        F.when(ok, percent_saved(before, after)).alias("compression_pct"), F.when(ok, key).alias("hash"), "compressed",
    )


def summary_line(result: DataFrame) -> DataFrame:
    """One line of text about each accepted reduction."""
    line = F.format_string(
        "[compress %s: %,d→%,d chars (%+.1f%%), saved ~%d tokens | restore: %s]",
        "content_type", "original_chars", "compressed_chars", "compression_pct", "est_token_savings", "hash",
    )
    return result.select("doc_id", F.when(F.col("was_compressed"), line).otherwise("").alias("summary"))
