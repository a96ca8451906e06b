"""The registered queries: one for each operator, over whole tables or fixtures made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content_key, text_lines
from ..operators import code, detect, diff, history, json, listing, logs, requests, search
from ..operators import text as prose
from ..operators.pipeline import reduce_all
from ..sources import store
from ..sources.fixtures import fixture
from ..streaming.texts import stream_text_reduce
from . import analytics

CFG = Config()
#: Conversations of the test tables are short: a lower trigger makes their history reduce.
HISTORY = Config(history_threshold_chars=5000, history_keep_recent=2)
#: Fixtures that go through the whole pipeline, and the offsets that keep their ids apart.
ALL_KINDS = ["logs_mixed", "json_uniform", "search_multi", "diff_git", "listing", "code_py", "code_c", "text_blank"]
#: Those, and the fixtures that only detection tells apart.
DETECTED = [*ALL_KINDS, "build_log", "code_js", "code_ts", "code_rust"]
OFFSET = 1_000_000_000
FIXED_TIME = "2024-01-01 00:00:00"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def all_fixtures(spark: SparkSession, sf_dir: str, names: list[str] = DETECTED) -> DataFrame:
    out = None
    for k, name in enumerate(names):
        part = fixture(spark, sf_dir, name).select((F.col("doc_id") + k * OFFSET).alias("doc_id"), "kind", "text")
        out = part if out is None else out.unionByName(part)
    return out


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose user turns are logs."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tool = fixture(spark, sf_dir, "logs_iso").select(F.col("doc_id").alias("tool"), F.col("text").alias("tool_text"))
    talk = spark.sql("SELECT *, (conv_id * 7 + turn) % ((SELECT max(tool) FROM {tool}) + 1) AS tool FROM {talk}", tool=tool, talk=talk)
    joined = talk.join(tool, "tool", "left")
    return joined.select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.coalesce("tool_text", "text")).otherwise(F.col("text")).alias("text"))


def item_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations; in every second one user turns are lists of a short text and a tool result."""
    listed = (F.col("conv_id") % 2 == 0) & (F.col("role") == "user")
    none = F.lit(None).cast("string")
    items = F.array(
        F.struct(F.lit("text").alias("type"), F.lit("see below").alias("text"), none.alias("content")), F.struct(F.lit("tool_result").alias("type"), none.alias("text"), F.col("text").alias("content"))
    )
    return histories(spark, sf_dir).select("conv_id", "turn", "role", F.when(~listed, F.col("text")).alias("text"), F.when(listed, items).alias("items"))


def history_items(spark, sf_dir):
    done = history.rewrite(item_histories(spark, sf_dir), HISTORY)
    return done.select("conv_id", "turn", "role", F.coalesce("text", F.col("items")[1]["content"]).alias("text"), "hash")


def history_stats(spark, sf_dir):
    entries = F.transform("entries", lambda e: F.concat_ws(":", e["turn"], e["hash"], e["original_size"], e["compressed_size"]))
    return history.stats(histories(spark, sf_dir), HISTORY).withColumn("entries", F.coalesce(F.array_join(entries, ","), F.lit("")))


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested requests; every second user turn is a tool result."""
    rows = histories(spark, sf_dir)
    tool = (F.col("role") == "user") & (F.col("turn") % 2 == 0)
    item = F.array(F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.col("text").alias("content")))
    message = F.struct(
        "role", F.when(~tool, F.col("text")).alias("content"), F.when(tool, item).alias("items")
    )
    grouped = rows.select("conv_id", F.struct("turn", message.alias("m")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    tools = F.when(F.col("conv_id") % 4 == 0, F.array(requests.tool_definition())).otherwise(F.array().cast(f"array<{requests._TOOL_TYPE}>"))
    return grouped.select(
        F.col("conv_id").alias("request_id"), (F.col("conv_id") % 5 == 0).alias("stream"), tools.alias("tools"), F.transform("xs", lambda x: x["m"]).alias("messages")
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixture(spark, sf_dir, "logs_iso")
    reduced = logs.reduce_logs(texts).join(texts, "doc_id").withColumn("content_type", F.col("kind"))
    return store.entries(reduced.withColumn("compressed_at", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))))


def _fx(name: str, make: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: make(fixture(spark, sf_dir, name))


def _access(make: Callable[[DataFrame], DataFrame]):
    return _fx("access_log", make)


def size_gate(spark, sf_dir):
    return detect.large_enough(_docs(spark, sf_dir)).select("doc_id", "n_chars", F.floor(F.col("n_chars") / 4).alias("est_tokens"))


def text_reduce(spark, sf_dir):
    rows = _docs(spark, sf_dir).where(F.col("n_chars") > CFG.text_max_chars).select("doc_id", "text")
    rows = rows.withColumns({"content_type": F.lit("text"), "compressor": F.lit("text")})
    return detect.accounted(prose.reduce_text(rows))


def detect_kind(spark, sf_dir):
    return detect.detect(all_fixtures(spark, sf_dir)).select("doc_id", "content_type")


def detect_scores(spark, sf_dir):
    return detect.scores(all_fixtures(spark, sf_dir)).drop("kind", "text")


def hint_override(spark, sf_dir):
    rows = all_fixtures(spark, sf_dir).withColumn("hint", F.when(F.col("doc_id") % 2 == 0, F.lit("logs")).otherwise(F.lit("nonsense")))
    return detect.detect(rows, hint="hint").select("doc_id", "content_type")


def reduced_kinds(spark, sf_dir):
    return reduce_all(all_fixtures(spark, sf_dir, ALL_KINDS), hint="kind")


def pipeline_all(spark, sf_dir):
    return reduced_kinds(spark, sf_dir).select(
        "doc_id", "content_type", "original_chars", "compressed_chars", "was_compressed", F.coalesce("est_token_savings", F.lit(0)).alias("est_token_savings"),
        F.coalesce("compression_pct", F.lit(0.0)).alias("compression_pct"), F.coalesce("hash", F.lit("")).alias("hash"),
    )


def summary_lines(spark, sf_dir):
    return detect.summary_line(reduced_kinds(spark, sf_dir))


def round_trip(spark, sf_dir):
    """Every text of every kind comes back from the store as it was."""
    texts = all_fixtures(spark, sf_dir)
    kept = store.entries(texts.withColumns({"compressed": F.lit(""), "content_type": F.col("kind"), "compressed_at": F.lit(FIXED_TIME).cast("timestamp")}))
    back = store.lookup(texts.withColumn("hash", content_key(F.col("text"))), kept)
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("original") == F.col("text"), 1).otherwise(0)).alias("restored"))


def store_put(spark, sf_dir):
    """Two batches by key that overlap and hold every text together: what the store has after both, and which put it."""
    texts = fixture(spark, sf_dir, "logs_iso").withColumns({"compressed": F.lit(""), "content_type": F.lit("logs"), "compressed_at": F.lit(FIXED_TIME).cast("timestamp")})
    key = content_key(F.col("text"))
    first, second = store.entries(texts.where(key < "b")), store.entries(texts.where(key >= "5"))
    held = first.withColumn("batch", F.lit(1)).unionByName(store.fresh(second, first).withColumn("batch", F.lit(2)))
    return held.select("hash", "original_chars", "original_lines", "batch")


def store_get(spark, sf_dir):
    """The keys of all texts, and three that the store doesn't hold."""
    keys = fixture(spark, sf_dir, "logs_iso").select(content_key(F.col("text")).alias("hash"))
    return store.lookup(keys.unionByName(spark.range(3).select(F.concat(F.lit("none"), F.col("id")).alias("hash"))), stored(spark, sf_dir)).select("hash", "original")


def resolve_calls(spark, sf_dir):
    kept = stored(spark, sf_dir)
    known = F.when(F.col("doc_id") % 3 == 0, content_key(F.col("text"))).otherwise(F.lit("unknown"))
    calls = fixture(spark, sf_dir, "logs_iso").select(
        F.col("doc_id").alias("call_id"), F.when(F.col("doc_id") % 4 == 0, "other").otherwise(requests.TOOL).alias("name"), F.to_json(F.struct(known.alias("hash"))).alias("arguments")
    )
    return requests.resolve_calls(calls, kept).select("call_id", "hash", F.coalesce(F.length("original"), F.lit(0)).alias("original_chars"))


def request_transform(spark, sf_dir):
    done = requests.transform_requests(chat_requests(spark, sf_dir))
    size = F.aggregate("messages", F.lit(0), lambda acc, m: acc + F.coalesce(F.length(m["content"]), F.length(m["items"][0]["content"]), F.lit(0)))
    return done.select("request_id", "compressed", "total_saved", F.size("tools").alias("n_tools"), size.alias("chars"))


def tool_inject(spark, sf_dir):
    rows = chat_requests(spark, sf_dir).select("request_id", requests.with_tool(F.col("tools")).alias("tools"))
    return rows.select("request_id", F.size("tools").alias("n_tools"), F.element_at("tools", -1)["function"]["name"].alias("last_tool"))


def profile_detect(spark, sf_dir):
    from ..config import PROFILES, profile

    out = None
    for name in PROFILES:
        one = analytics.detect_profile(spark.createDataFrame(analytics.config_rows(profile(name)), "key string, value string"))
        one = one.select(F.lit(name).alias("given"), F.col("profile").alias("detected"))
        out = one if out is None else out.unionByName(one)
    return out


def analysis_diff(spark, sf_dir):
    """Addresses of all lines against those of lines outside the first ten."""
    whole = fixture(spark, sf_dir, "access_log")
    later = text_lines(whole).where("pos >= 10").groupBy("doc_id").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    found = analytics.difference(analytics.ip_counts(whole), analytics.ip_counts(later), ["doc_id", "ip"])
    return found.na.fill(0, ["n_left", "n_right"])


def analysis_diff_all(spark, sf_dir):
    """Every field of the analysis of all lines against that of lines outside the first ten."""
    lines = analytics.log_lines(fixture(spark, sf_dir, "access_log"))
    later = lines.where("pos >= 10")
    return analytics.difference(analytics.all_counts(lines), analytics.all_counts(later), ["doc_id", "field", "key"]).na.fill(0, ["n_left", "n_right"])


def merge_by_time(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = [events.where(f"event_id % 3 = {k}").select(F.lit(f"s{k}").alias("source"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("line")) for k in range(3)]
    return analytics.merged_by_time(*parts)


def latency_summary(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = analytics.latency_summary(events.select(F.col("event_type").alias("kind"), F.floor(F.col("value")).alias("ms")))
    return out.withColumn("avg_ms", F.round("avg_ms", 3))


def recent_list(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return analytics.recent(events.select(name.alias("name"), "ts", F.col("event_id").alias("seq")))


def field_fidelity(spark, sf_dir):
    texts = fixture(spark, sf_dir, "json_object").select("text", json.canonical(F.col("text")).alias("restored"))
    return analytics.field_fidelity(texts, ["id", "meta", "body"])


def cost_projection(spark, sf_dir):
    done = analytics.cost_projection(reduced_kinds(spark, sf_dir))
    return done.select("tokens", F.round("per_run", 6).alias("per_run"), F.round("per_day", 4).alias("per_day"), F.round("per_year", 2).alias("per_year"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "size_gate": size_gate,
    "text_reduce": text_reduce,
    "text_cuts": _fx("text_blank", lambda d: prose.cuts(d).select("doc_id", "head_end", "tail_start")),
    "detect_scores": detect_scores,
    "detect_kind": detect_kind,
    "hint_override": hint_override,
    "summary_lines": summary_lines,
    "log_normalize": _fx("logs_mixed", lambda d: logs.classified(d).select("doc_id", "pos", "norm", "is_error", "is_stack")),
    "log_score": _fx("logs_mixed", lambda d: logs.classified(d).select("doc_id", "pos", "score")),
    "log_patterns": _fx("logs_mixed", logs.patterns),
    "log_dedup_lines": _fx("logs_mixed", lambda d: logs.kept_lines(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))),
    "log_dedup": _fx("logs_mixed", logs.reduce_logs),
    "log_repetitions": _fx("logs_iso", logs.repetitions_saved),
    "log_blocks": _fx("logs_mixed", logs.collapse_blocks),
    "search_parse": _fx("search_multi", search.parsed),
    "search_file_rank": _fx("search_multi", lambda d: search.ranked_files(search.parsed(d))),
    "search_pick": _fx("search_multi", lambda d: search.picked(d).select("doc_id", "file", "rank", "lnum", "match")),
    "search_reduce": _fx("search_multi", search.reduce_search),
    "json_valid": lambda s, d: all_fixtures(s, d).select("doc_id", detect.is_json(F.col("text")).alias("valid")),
    "json_shared_keys": _fx("json_uniform", lambda d: json.as_rows(d).select("doc_id", F.array_join(json.shared_keys(F.col("rows")), ",").alias("keys"))),
    "json_columnar": _fx("json_uniform", lambda d: json.reduce_json(d).select("doc_id", "mode", "compressed")),
    "json_compact": _fx("json_uniform", lambda d: d.select("doc_id", json.canonical(F.col("text")).alias("compressed"))),
    "json_row_drop": _fx("json_mixed", lambda d: json.reduce_json(d, Config(json_max_rows_before_drop=20)).select("doc_id", "mode", "compressed")),
    "json_ranges": _fx("json_mixed", lambda d: json.numeric_ranges(json.as_rows(d))),
    "json_large_strings": _fx("json_object", lambda d: json.reduce_json(d).select("doc_id", "mode", "compressed")),
    "json_stored_strings": _fx("json_object", lambda d: json.stored_strings(d)),
    "json_modes": _fx("json_values", lambda d: json.reduce_json(d).select("doc_id", "mode", "compressed")),
    "diff_lines": _fx("diff_git", lambda d: diff.marked_lines(d).groupBy("doc_id", "role", "kept").agg(F.count(F.lit(1)).alias("n"))),
    "diff_stats": _fx("diff_git", diff.stats),
    "diff_reduce": _fx("diff_git", diff.reduce_diff),
    "listing_reduce": _fx("listing", lambda d: listing.reduce_listing(d).select("doc_id", "compressed")),
    "py_strip": _fx("code_py", lambda d: code.reduce_code(d, "python").select("doc_id", "compressed")),
    "c_strip": _fx("code_c", lambda d: code.reduce_code(d, "generic").select("doc_id", "compressed")),
    "pipeline_all": pipeline_all,
    "store_put": store_put,
    "store_get": store_get,
    "store_retention": lambda s, d: store.retained(stored(s, d), Config(store_max_entries=50)).select("hash"),
    "store_stats": lambda s, d: store.stats(stored(s, d)),
    "round_trip": round_trip,
    "history_trigger": lambda s, d: history.conversation_sizes(histories(s, d), HISTORY),
    "history_candidates": lambda s, d: history.candidates(histories(s, d), HISTORY).where("candidate").select("conv_id", "turn"),
    "history_rewrite": lambda s, d: history.rewrite(histories(s, d), HISTORY),
    "history_stats": history_stats,
    "history_items": history_items,
    "request_walk": lambda s, d: requests.walk(chat_requests(s, d)).select("request_id", "msg", "item", "original_chars", "compressed_chars"),
    "request_transform": request_transform,
    "tool_inject": tool_inject,
    "resolve_calls": resolve_calls,
    "profile_detect": profile_detect,
    "log_totals": _access(analytics.totals),
    "log_ip_counts": _access(analytics.ip_counts),
    "log_status_classes": _access(analytics.status_classes),
    "log_status_counts": _access(analytics.status_counts),
    "log_paths": _access(analytics.path_counts),
    "log_levels": _access(analytics.level_counts),
    "log_errors": _access(analytics.error_messages),
    "log_hours": _access(analytics.hour_counts),
    "log_duration_hist": _access(analytics.duration_histogram),
    "log_slow": _access(analytics.slow_durations),
    "log_peak_ips": _access(analytics.peak_hour_ips),
    "log_report": _access(analytics.report),
    "analysis_diff": analysis_diff,
    "analysis_diff_all": analysis_diff_all,
    "merge_by_time": merge_by_time,
    "savings_rollup": lambda s, d: analytics.savings_rollup(reduced_kinds(s, d)),
    "cost_projection": cost_projection,
    "latency_summary": latency_summary,
    "recent_list": recent_list,
    "field_fidelity": field_fidelity,
    "stream_text_reduce": lambda s, d: stream_text_reduce(fixture(s, d, "text_blank")).select("doc_id", "compressed_chars", "hash"),
}
