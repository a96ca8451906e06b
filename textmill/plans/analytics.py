"""Analyses of service logs and reports on savings; every result is a small grouped frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, profile_rows
from ..functions.text import strip, text_lines

#: What the log lines hold.
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
STATUS = r'"\w+ /[^"]*" (\d{3})'
STAMP = r"\d{2}/[A-Z][a-z]{2}/\d{4}:(\d{2}):\d{2}:\d{2}"
DURATION = r"(\d+(?:\.\d+)?)ms"
LEVEL = r" (INFO|WARN|ERROR|DEBUG) "
ERROR_MESSAGE = r"ERROR\s+\[(.+?)\]\s+(.+)\z"
PATH = r'"(GET|POST|PUT|DELETE) (/[^" ]*)'


def log_lines(logs: DataFrame) -> DataFrame:
    return text_lines(logs).withColumn("line", strip(F.col("line"))).where("line <> ''")


def totals(logs: DataFrame) -> DataFrame:
    return logs.select("doc_id", F.size(F.split("text", "\n", -1)).alias("total_lines"), F.length("text").alias("total_chars"))


def ip_counts(logs: DataFrame) -> DataFrame:
    return log_lines(logs).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(IP), F.lit(0))).alias("ip")).groupBy("doc_id", "ip").agg(F.count(F.lit(1)).alias("n"))


def _first(logs: DataFrame, pattern: str, *names: str) -> DataFrame:
    rows = log_lines(logs).where(F.col("line").rlike(pattern))
    return rows.select("doc_id", "pos", *(F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(names)))


def status_classes(logs: DataFrame) -> DataFrame:
    code = F.col("code").cast("int")
    return _first(logs, STATUS, "code").groupBy("doc_id").agg(
        F.count(F.when(code.between(200, 299), 1)).alias("n_2xx"), F.count(F.when(code.between(400, 499), 1)).alias("n_4xx"), F.count(F.when(code >= 500, 1)).alias("n_5xx")
    )


def status_counts(logs: DataFrame) -> DataFrame:
    return _first(logs, STATUS, "code").groupBy("doc_id", F.col("code").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def path_counts(logs: DataFrame) -> DataFrame:
    return _first(logs, PATH, "method", "path").groupBy("doc_id", F.concat_ws(" ", "method", "path").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def level_counts(logs: DataFrame) -> DataFrame:
    return _first(logs, LEVEL, "level").groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))


def error_messages(logs: DataFrame) -> DataFrame:
    """Module and message of every line at level ERROR."""
    rows = log_lines(logs).where((F.regexp_extract("line", LEVEL, 1) == "ERROR") & F.col("line").rlike(ERROR_MESSAGE))
    return rows.select("doc_id", "pos", F.regexp_extract("line", ERROR_MESSAGE, 1).alias("module"), F.regexp_extract("line", ERROR_MESSAGE, 2).alias("message"))


def hour_counts(logs: DataFrame) -> DataFrame:
    return _first(logs, STAMP, "hour").groupBy("doc_id", "hour").agg(F.count(F.lit(1)).alias("n"))


def durations(logs: DataFrame) -> DataFrame:
    found = log_lines(logs).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(DURATION), F.lit(1))).alias("ms"))
    return found.select("doc_id", F.col("ms").cast("double").alias("ms"))


def duration_bucket(ms: Column) -> Column:
    return F.when(ms < 10, "<10ms").when(ms < 100, "10-100ms").when(ms < 500, "100-500ms").otherwise(">500ms")


def duration_histogram(logs: DataFrame) -> DataFrame:
    ms = F.col("ms")
    return durations(logs).groupBy("doc_id", duration_bucket(ms).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ms > 100, 1)).alias("slow"))


def slow_durations(logs: DataFrame, above: float = 100) -> DataFrame:
    """The durations that count as slow, one row each."""
    return durations(logs).where(F.col("ms") > above)


def peak_hour_ips(logs: DataFrame) -> DataFrame:
    """The busiest hour of each log (the earlier on ties) and its distinct addresses."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "hour"))
    peak = hour_counts(logs).withColumn("rank", rank).where("rank = 1").select("doc_id", F.col("hour").alias("peak_hour"))
    at = log_lines(logs).select("doc_id", "line", F.regexp_extract("line", STAMP, 1).alias("hour")).join(peak, "doc_id").where("hour = peak_hour")
    ips = at.select("doc_id", "peak_hour", F.explode(F.regexp_extract_all("line", F.lit(IP), F.lit(0))).alias("ip"))
    return ips.groupBy("doc_id", "peak_hour").agg(F.count_distinct("ip").alias("n_ips"))


def report(logs: DataFrame) -> DataFrame:
    """Per log: the most frequent address and path with their counts, sums of status classes, and totals."""

    def top(counts: DataFrame, key: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), key))
        return counts.withColumn("rank", rank).where("rank = 1").select("doc_id", F.col(key).alias(f"top_{key}"), F.col("n").alias(f"top_{key}_n"))

    tops = top(ip_counts(logs), "ip").join(top(path_counts(logs), "path"), "doc_id", "full")
    return totals(logs).join(tops, "doc_id", "left").join(status_classes(logs), "doc_id", "left").na.fill(0, ["n_2xx", "n_4xx", "n_5xx"])


def all_counts(lines: DataFrame) -> DataFrame:
    """Everything that is counted about the lines of logs (:func:`log_lines`), in one pass: ``doc_id, field, key, n``."""
    line = F.col("line")
    first = lambda pattern, i=1: F.regexp_extract(line, pattern, i)
    each = lambda field, keys: F.transform(keys, lambda k: F.struct(F.lit(field).alias("field"), k.alias("key")))
    one = lambda field, pattern, key: each(field, F.when(line.rlike(pattern), F.array(key)).otherwise(F.array().cast("array<string>")))
    found = F.concat(
        each("ip", F.regexp_extract_all(line, F.lit(IP), F.lit(0))), one("status", STATUS, first(STATUS).cast("int").cast("string")),
        one("path", PATH, F.concat_ws(" ", first(PATH), first(PATH, 2))), one("level", LEVEL, first(LEVEL)), one("hour", STAMP, first(STAMP)),
        each("duration", F.transform(F.regexp_extract_all(line, F.lit(DURATION), F.lit(1)), lambda ms: duration_bucket(ms.cast("double")))),
    )
    return lines.select("doc_id", F.explode(found).alias("x")).groupBy("doc_id", "x.field", "x.key").agg(F.count(F.lit(1)).alias("n"))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (``keys``, ``n``) that two analyses disagree on; null where one lacks the key."""
    a, b = left.withColumnRenamed("n", "n_left"), right.withColumnRenamed("n", "n_right")
    return a.join(b, keys, "full").where(~F.col("n_left").eqNullSafe(F.col("n_right")))


def merged_by_time(*sources: DataFrame) -> DataFrame:
    """Records (``source, ts, seq, line``) of all sources in order of time."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy("ts", "source", "seq")


def savings_rollup(results: DataFrame) -> DataFrame:
    """Counts and sizes by kind, with the grand total under a null kind."""
    return results.rollup("content_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("original_chars").alias("original"),
        F.sum(F.when(F.col("was_compressed"), F.col("compressed_chars")).otherwise(F.col("original_chars"))).alias("reduced"),
        F.max("compression_pct").alias("best_pct"), F.min("compression_pct").alias("worst_pct"),
        F.bool_and(~F.col("was_compressed") | F.col("hash").isNotNull()).alias("all_reversible"),
    )


def cost_projection(results: DataFrame, per_million: float = 2.0, runs_a_day: int = 100) -> DataFrame:
    """Tokens saved, and what that saves per run, day and year."""
    tokens = F.sum(F.coalesce("est_token_savings", F.lit(0)))
    cost = F.col("tokens") / 1e6 * per_million
    return results.agg(tokens.alias("tokens")).select(
        "tokens", cost.alias("per_run"), (cost * runs_a_day).alias("per_day"), (cost * runs_a_day * 365).alias("per_year")
    )


def latency_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("kind").agg(F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.percentile("ms", 0.5).alias("p50_ms"))


def recent(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Newest row of each name, letter case aside, newest first, up to ``limit``."""
    rank = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.desc("ts"), "seq"))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank").orderBy(F.desc("ts"), "seq").limit(limit)


def field_fidelity(rows: DataFrame, fields: list[str]) -> DataFrame:
    """How many texts (``text``, ``restored``) have each JSON field equal before and after."""
    same = [F.get_json_object("text", f"$.{f}").eqNullSafe(F.get_json_object("restored", f"$.{f}")).cast("int").alias(f) for f in fields]
    return rows.select(*same).agg(*(F.sum(f).alias(f) for f in fields), F.count(F.lit(1)).alias("n"))


def profile_matches(config: DataFrame) -> DataFrame:
    """Profiles by the number of keys on which ``config`` (``key, value``) agrees, in their order."""
    spark = config.sparkSession
    rows = [(i, *row) for i, row in enumerate(profile_rows())]
    known = spark.createDataFrame(rows, "place int, profile string, key string, value string")
    return known.join(F.broadcast(config), ["key", "value"]).groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))


def detect_profile(config: DataFrame) -> DataFrame:
    """The profile with most equal keys; the earlier one on ties, balanced if none agrees."""
    best = profile_matches(config).orderBy(F.desc("n"), F.floor(F.col("place") / len(profile_rows()) * 3)).limit(1)
    return best.agg(F.coalesce(F.max("profile"), F.lit("balanced")).alias("profile"))


def config_rows(cfg: Config):
    from dataclasses import asdict

    from ..config import PROFILE_KEYS

    return [(k, str(asdict(cfg)[k]).lower()) for k in PROFILE_KEYS]
