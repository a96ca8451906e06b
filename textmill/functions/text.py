"""Text functions that the built-ins don't give as needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t\\r\\n\\f\\x0B]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def is_blank(c: Column) -> Column:
    return c.rlike(f"^{SPACE}*\\z")


#: Lines of a text that are handled as one value.
PIECE = 4096


def text_pieces(text: Column) -> Column:
    """A text as an array of pieces of ``PIECE`` lines, each with its line end."""
    return F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(rf"(?:[^\n]*+\n){{1,{PIECE}}}+"), F.lit(0))


def text_lines(df: DataFrame, *keep: str, dealt: bool = False) -> DataFrame:
    """One row per line: ``doc_id``, what ``keep`` names, ``pos`` from 0, ``line``.

    Texts are cut into pieces first (or come as such, numbered by ``text_piece``), so that no
    array has a value for each line of a very long text; if ``dealt``, it is the pieces that
    are dealt out by id.
    """
    whole = F.posexplode(text_pieces(F.col("text"))).alias("piece", "part")
    cut = df.select("doc_id", *keep, *((F.col("text_piece").alias("piece"), F.col("text").alias("part")) if "text_piece" in df.columns else (whole,)))
    cut = cut.repartition("doc_id") if dealt else cut
    lines = F.split(F.substr("part", F.lit(1), F.length("part") - 1), "\n", -1)
    rows = cut.select("doc_id", *keep, "piece", F.posexplode(lines).alias("at", "line"))
    return rows.select("doc_id", *keep, (F.col("piece") * PIECE + F.col("at")).alias("pos"), "line")


def join_lines(order: list[str], line: str = "out") -> Column:
    """Aggregate: lines joined in the order of columns."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line)))
    return F.array_join(F.transform(rows, lambda x: x[line]), "\n")


def content_key(c: Column, length: int = 12) -> Column:
    """Key of a text in the restore store."""
    return F.substring(F.sha2(c, 256), 1, length)


def is_whole_json(text: Column) -> Column:
    """Whether all of a text is one JSON value.

    Spark's parsers stop after the first value; within brackets a second value makes the
    array longer, and as an object's only value an early closing bracket breaks the object.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    whole = F.size(F.json_object_keys(F.concat(F.lit('{"a":'), text, F.lit("}")))) == 1
    return F.coalesce(alone & whole, F.lit(False))


def short_number(v: Column) -> Column:
    """Two significant digits, as C's %.2g writes them."""
    size = F.abs(v)
    e = F.floor(F.log10(size)).cast("int")
    m = F.bround(size / F.pow(F.lit(10.0), e), 1)
    e = F.when(m >= 10, e + 1).otherwise(e)
    m = F.when(m >= 10, m / 10).otherwise(m)
    digits = F.regexp_replace(F.format_string("%.1f", m), "\\.0$", "")
    power = F.concat(digits, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    plain = F.regexp_replace(F.format_string("%.6f", F.when(e == 1, F.bround(size, 0)).otherwise(m * F.pow(F.lit(10.0), e))), "\\.?0+$", "")
    text = F.when((e >= 2) | (e < -4), power).otherwise(F.when(e == 1, F.bround(size, 0).cast("int").cast("string")).otherwise(plain))
    return F.when(v == 0, "0").otherwise(F.concat(F.when(v < 0, "-").otherwise(""), text))


def percent_saved(original: Column, reduced: Column) -> Column:
    """Percentage saved, one decimal, halves to even."""
    return F.bround((1 - reduced / F.greatest(original, F.lit(1))) * 100, 1)
