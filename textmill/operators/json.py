"""JSON payloads: canonical text, a table for uniform arrays, head and tail of long ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content_key, is_whole_json, short_number

_ROWS = "array<map<string,string>>"
#: A string token, with the colon if it is a key.
_STRING = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?+'


def canonical(text: Column) -> Column:
    """Keys sorted, no white space; what isn't JSON stays as it is."""
    return F.coalesce(F.when(is_whole_json(text), F.to_json(F.try_parse_json(text))), text)


def as_rows(df: DataFrame) -> DataFrame:
    """``df`` with ``rows`` (objects of an array, null otherwise) and ``items`` (their number)."""
    array = F.col("text").rlike(r"^\s*\[")
    return df.withColumns({
        "rows": F.when(array, F.from_json("text", _ROWS)),
        "items": F.when(array, F.json_array_length("text")),
    })


def shared_keys(rows: Column) -> Column:
    """The sorted keys that all objects have; null if they differ or an element is no object."""
    keys = F.transform(rows, lambda r: F.array_sort(F.map_keys(r)))
    same = (F.size(F.array_distinct(keys)) == 1) & ~F.exists(rows, lambda r: r.isNull())
    return F.when(F.coalesce(same, F.lit(False)), F.element_at(keys, 1))


def columnar(rows: Column, keys: Column) -> Column:
    """A header and one comma-separated line for each object, columns in the order of keys."""

    def cell(v: Column) -> Column:
        return F.when(v.isNull(), "").when(F.contains(v, F.lit(",")), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)

    lines = F.transform(rows, lambda r: F.array_join(F.transform(keys, lambda k: cell(r[k])), ","))
    return F.concat(F.lit("COLUMNS\n# "), F.array_join(keys, ", "), F.lit("\n"), F.array_join(lines, "\n"))


def large_strings_out(text: Column, cfg: Config = Config()) -> Column:
    """Canonical JSON whose strings of the limit or more, at any depth, are ``[stored:<key>]``.

    String tokens are found in the text itself: a split at them and the tokens align.
    """
    tokens = F.regexp_extract_all(text, F.lit(_STRING), F.lit(0))
    between = F.split(text, _STRING, -1)

    def swap(x: Column) -> Column:
        value = F.element_at(F.from_json(F.concat(F.lit("["), x["t"], F.lit("]")), "array<string>"), 1)
        marker = F.concat(F.lit('"[stored:'), content_key(value, cfg.hash_length), F.lit(']"'))
        new = F.when((F.length(x["t"]) < cfg.large_string_chars) | x["t"].endswith(":"), x["t"]).when(F.length(value) >= cfg.large_string_chars, marker).otherwise(x["t"])
        return F.concat(x["b"], new)

    pairs = F.arrays_zip(F.slice(between, 1, F.size(tokens)).alias("b"), tokens.alias("t"))
    return F.concat(F.array_join(F.transform(pairs, swap), ""), F.element_at(between, -1))


def stored_strings(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The strings that :func:`large_strings_out` replaces, for the restore store."""
    tokens = F.regexp_extract_all(canonical(F.col("text")), F.lit(_STRING), F.lit(0))
    long = df.where(F.length("text") >= cfg.large_string_chars).select("doc_id", F.explode(tokens).alias("t")).where((F.length("t") >= cfg.large_string_chars) & ~F.col("t").endswith(":"))
    value = F.element_at(F.from_json(F.concat(F.lit("["), F.col("t"), F.lit("]")), "array<string>"), 1)
    return long.select("doc_id", value.alias("original")).where(F.length("original") >= cfg.large_string_chars).withColumn("hash", content_key(F.col("original"), cfg.hash_length))


def numeric_ranges(rows: DataFrame) -> DataFrame:
    """``doc_id, place, key, low, high`` over all numbers of the first object's first five keys."""
    first = F.slice(F.map_keys(F.element_at("rows", 1)), 1, 5)
    keyed = rows.where(F.size("rows") > 0).select("doc_id", F.posexplode(first).alias("place", "key"), "rows")
    values = keyed.select("doc_id", "place", "key", F.explode("rows").alias("r")).select("doc_id", "place", "key", F.col("r")[F.col("key")].try_cast("double").alias("v"))
    return values.where("v IS NOT NULL").groupBy("doc_id", "place", "key").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def row_drop(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``doc_id, compressed``: the first and last rows, how many are left out, and number ranges."""
    rows = as_rows(df)
    ranges = numeric_ranges(rows)
    part = F.concat("key", F.lit(": ["), short_number(F.col("low")), F.lit(".."), short_number(F.col("high")), F.lit("]"))
    found = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))).alias("parts"))
    found = found.select("doc_id", F.array_join(F.transform("parts", lambda x: x["part"]), " | ").alias("summary"))
    items = rows.withColumn("elements", F.try_parse_json("text").cast("array<variant>")).join(found, "doc_id", "left")
    head, tail = F.slice("elements", 1, cfg.json_drop_head), F.slice("elements", -cfg.json_drop_tail, cfg.json_drop_tail)
    write = lambda part: F.concat(F.lit("["), F.array_join(F.transform(part, lambda x: F.to_json(x)), ","), F.lit("]"))
    dropped = F.col("items") - cfg.json_drop_head - cfg.json_drop_tail
    text = F.concat(
        F.format_string(f"[SHOWING {cfg.json_drop_head} first + {cfg.json_drop_tail} last of %d items]\n", "items"), write(head),
        F.format_string("\n... %d rows left out, restore=%s\n", dropped, content_key(F.col("text"), cfg.hash_length)),
        F.coalesce(F.concat(F.lit("// Ranges of all rows: "), F.col("summary"), F.lit("\n")), F.lit("")), write(tail), F.lit("\n[/SHOWING]"),
    )
    return items.select("doc_id", text.alias("compressed"))


def reduce_json(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``df`` with ``mode`` and ``compressed``: object, uniform array, short array, long array, scalar."""
    own = [c for c in df.columns if c not in ("mode", "compressed")]
    rows = as_rows(df.select(F.struct(*(df[c] for c in own)).alias("row"), df["doc_id"].alias("doc_id"), df["text"].alias("text")))
    rows = rows.withColumn("keys", shared_keys(F.col("rows")))
    uniform = F.lit(cfg.json_auto_columnar) & (F.col("items") >= cfg.json_columnar_min_rows) & F.col("keys").isNotNull()
    mode = (
        F.when(~is_whole_json(F.col("text")) | F.try_parse_json("text").isNull(), "passthrough").when(F.col("text").rlike(r"^\s*\{"), "compact_object")
        .when(F.col("items").isNull(), "compact_scalar").when(F.coalesce(uniform, F.lit(False)), "columnar")
        .when(F.col("items") <= cfg.json_max_rows_before_drop, "compact_array").otherwise("row_drop")
    )
    rows = rows.withColumn("mode", mode)
    new = (
        F.when(F.col("mode") == "columnar", columnar(F.col("rows"), F.col("keys")))
        .when(F.col("mode") == "compact_object", large_strings_out(canonical(F.col("text")), cfg))
        .when(F.col("mode") == "row_drop", F.lit(None)).otherwise(canonical(F.col("text")))
    )
    rows = rows.select("row", "doc_id", "text", "mode", new.alias("short"))
    long = row_drop(rows.where("mode = 'row_drop'").select("doc_id", "text"), cfg)
    joined = rows.join(long, "doc_id", "left")
    return joined.select(*(F.col("row").getField(c).alias(c) for c in own), "mode", F.coalesce("short", "compressed").alias("compressed"))
