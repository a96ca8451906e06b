"""Directory listings: readable sizes, without permissions and owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

#: The forms of a row and of the total.
ROW = r"^([dlrwxs-]{10})\s+\d+\s+(\S+)\s+(\S+)\s+(\d+)\s+(\w+\s+\d+\s+\d+:\d+|\w+\s+\d+\s+\d{4})\s+(.+)\z"
TOTAL = r"^total (\d+)"


def human_size(size: Column) -> Column:
    mega = F.format_string("%.1fM", F.bround(size / 1048576, 1))
    kilo = F.concat(F.bround(size / 1024, 0).cast("bigint").cast("string"), F.lit("K"))
    return F.when(size >= 1048576, mega).when(size >= 1024, kilo).otherwise(size.cast("string"))


def short_line(line: Column, cfg: Config = Config()) -> Column:
    part = lambda k: F.regexp_extract(line, ROW, k)
    size = human_size(part(4).try_cast("bigint"))
    size = F.lpad(size, F.greatest(F.lit(6), F.length(size)), F.lit(" "))
    mark = F.when(part(1).startswith("d"), "/").when(part(1).startswith("l"), "@").otherwise("")
    front = F.lit(" ") if cfg.ls_strip_perms and cfg.ls_strip_owner else part(1)
    row = F.concat(front, F.lit(" "), size, F.lit(" "), part(5), F.lit(" "), part(6), mark)
    total = F.concat(F.lit("[total: "), F.regexp_extract(line, TOTAL, 1), F.lit(" blocks]"))
    return F.when(line.rlike(TOTAL), total).when(line.rlike(ROW), row).otherwise(line)


def short_listing(text: Column, cfg: Config = Config()) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: short_line(x, cfg)), "\n")


def reduce_listing(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``df`` with ``compressed`` and ``mode``; rows of another form stay. No shuffle."""
    return df.withColumns({"compressed": short_listing(F.col("text"), cfg), "mode": F.lit("file_listing")})
