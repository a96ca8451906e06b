"""Dispatch: each kind of text goes through its own reducer, then all are accounted alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content_key, text_pieces
from ..sources.scratch import written
from .code import strip_c_like, strip_python
from .detect import REDUCERS, accounted, detect, large_enough
from .diff import reduce_diff
from .json import reduce_json
from .listing import short_listing
from .logs import reduce_logs
from .search import reduce_search
from .text import reduce_text


def _joined(reduce: Callable[[DataFrame, Config], DataFrame], mode: str):
    """A line-level reducer gives texts by id: they return to their rows (of a text in pieces, the first) by a join on the id."""

    def run(df: DataFrame, cfg: Config) -> DataFrame:
        rows = df.where("text_piece = 0") if "text_piece" in df.columns else df
        return rows.join(reduce(df, cfg).select("doc_id", "compressed"), "doc_id", "left").withColumn("mode", F.lit(mode))

    return run


#: Reducers that cut texts into lines by ``text_lines``: they get them in pieces.
BY_LINES: dict[str, Callable[[DataFrame, Config], DataFrame]] = {
    "log_deduper": _joined(reduce_logs, "logs"),
    "search": _joined(reduce_search, "search"),
    "diff": _joined(reduce_diff, "diff"),
}
#: Those and reducers of whole groups of lines, each a branch of its own. Register another
#: one here and name its kinds in ``detect.REDUCERS``.
RUNNERS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"json_crusher": reduce_json, **BY_LINES}
_COLUMNS = ["content_type", "compressor", "mode", "original_chars", "hash", "compressed"]


def _in_place(df: DataFrame, cfg: Config) -> DataFrame:
    """Code, listings, prose, and kinds without a reducer: one projection, no shuffle."""
    prose = reduce_text(df, cfg)
    is_ = lambda name: F.col("compressor") == name
    new = (
        F.when(is_("code_python"), strip_python(F.col("text"))).when(is_("code_generic"), strip_c_like(F.col("text")))
        .when(is_("file_listing"), short_listing(F.col("text"), cfg)).when(is_("text"), F.col("compressed")).otherwise(F.col("text"))
    )
    mode = (
        F.when(is_("code_python"), "strip_python").when(is_("code_generic"), "strip_generic").when(is_("file_listing"), "file_listing")
        .when(is_("text"), "text_summary").otherwise("unchanged")
    )
    return prose.withColumns({"mode": mode, "compressed": new})


def reduce_all(df: DataFrame, cfg: Config = Config(), hint: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The common result of every text of ``df`` (``doc_id``, ``text``) above the size gate, with the columns ``keep``.

    ``df`` is read once: what passes the gate is classified and written in folders by
    reducer, and each branch reads its own. Rows get a key of their own there, so null and
    repeated ids are reduced like any other. Unless the texts are kept, those that are reduced
    line by line are written in pieces, so that no later row holds a very long text.
    """
    named = F.create_map(*(F.lit(x) for pair in REDUCERS.items() for x in pair))
    branch = F.when(F.col("compressor").isin(list(RUNNERS)), F.col("compressor")).otherwise("in_place")
    rows = large_enough(df, cfg) if "n_chars" in df.columns else df
    # rows are numbered first: what comes after can't be moved into the source's plan, where each step would copy the texts
    rows = large_enough(rows.select("*", F.monotonically_increasing_id().alias("row")), cfg)
    kinds = detect(rows, cfg, hint).withColumn("compressor", named[F.col("content_type")])
    facts = {"branch": branch, "original_chars": F.length("text"), "hash": content_key(F.col("text"), cfg.hash_length)}
    kept = ["row", "doc_id", *keep, "content_type", "compressor", *facts]
    kinds = kinds.withColumns(facts).select(*kept, *([] if "text" in keep else ["text"]))
    if "text" not in keep:
        pieces = F.when(F.col("branch").isin(list(BY_LINES)), text_pieces(F.col("text"))).otherwise(F.array("text"))
        kinds = kinds.select(*kept, F.posexplode(pieces).alias("text_piece", "text"))
    kinds = written(kinds, "classified", "branch").withColumnsRenamed({"doc_id": "id", "row": "doc_id"})
    columns = ["id", *keep, *_COLUMNS]
    out = _in_place(kinds.where("branch = 'in_place'"), cfg).select(columns)
    for name, run in RUNNERS.items():
        out = out.unionByName(run(kinds.where(F.col("branch") == name), cfg).select(columns))
    return accounted(out.withColumnRenamed("id", "doc_id"), cfg, keep)
