"""Chat requests: reduce large texts in nested messages, offer and resolve the retrieval tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .pipeline import reduce_all

TOOL = "retrieve_original"
_TOOL_TYPE = "struct<type:string,function:struct<name:string,description:string,parameters:string>>"
_PARAMETERS = '{"type":"object","properties":{"hash":{"type":"string"},"query":{"type":"string"}},"required":["hash"]}'


def tool_definition() -> Column:
    function = F.struct(
        F.lit(TOOL).alias("name"), F.lit("Returns the original of a reduced text, by the key in its marker.").alias("description"), F.lit(_PARAMETERS).alias("parameters")
    )
    return F.struct(F.lit("function").alias("type"), function.alias("function")).cast(_TOOL_TYPE)


def with_tool(tools: Column) -> Column:
    """``tools`` with the retrieval tool, added once."""
    held = F.coalesce(tools, F.array().cast(f"array<{_TOOL_TYPE}>"))
    there = F.exists(held, lambda t: F.coalesce(t["function"]["name"] == TOOL, F.lit(False)))
    return F.when(there, held).otherwise(F.array_append(held, tool_definition()))


def large_texts(requests: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``request_id, msg, item, text``: tool results, and plain user texts (item -1), of requests that don't stream."""
    messages = requests.where(~F.coalesce(F.col("stream"), F.lit(False))).select("request_id", F.posexplode("messages").alias("msg", "m"))
    items = messages.select("request_id", "msg", F.posexplode("m.items").alias("item", "i")).where("i.type = 'tool_result'")
    plain = messages.where("m.role = 'user' AND m.items IS NULL").select("request_id", "msg", F.lit(-1).alias("item"), F.col("m.content").alias("text"))
    rows = items.select("request_id", "msg", "item", F.col("i.content").alias("text")).unionByName(plain)
    return rows.where(F.length("text") >= cfg.min_compress_chars)


def walk(requests: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The common result of every accepted text, with its place ``request_id, msg, item``."""
    rows = large_texts(requests, cfg).withColumn("doc_id", F.lit(None).cast("long"))
    return reduce_all(rows, cfg, keep=("request_id", "msg", "item")).where("was_compressed").drop("doc_id")


def transform_requests(requests: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Requests with reduced texts in place, the tool where any text was reduced, and counts."""
    done = walk(requests, cfg)
    per = done.groupBy("request_id").agg(
        F.collect_list(F.struct("msg", "item", "compressed")).alias("new"), F.count(F.lit(1)).alias("compressed"), F.sum("chars_saved").alias("total_saved")
    )

    def swap(m: Column, i: Column) -> Column:
        mine = F.filter("new", lambda x: x["msg"] == i)
        own = F.filter(mine, lambda x: x["item"] == -1)
        items = F.transform(
            m["items"],
            lambda it, k: it.withField("content", F.coalesce(F.try_element_at(F.filter(mine, lambda x: x["item"] == k), F.lit(1))["compressed"], it["content"])),
        )
        content = F.coalesce(F.try_element_at(own, F.lit(1))["compressed"], m["content"])
        return F.struct(m["role"].alias("role"), content.alias("content"), items.alias("items"))

    joined = requests.join(per, "request_id", "left").withColumn("new", F.coalesce("new", F.array().cast("array<struct<msg:int,item:int,compressed:string>>")))
    return joined.withColumns({
        "messages": F.transform("messages", swap),
        "tools": F.when(F.col("compressed") > 0, with_tool(F.col("tools"))).otherwise(F.col("tools")),
        "compressed": F.coalesce("compressed", F.lit(0)),
        "total_saved": F.coalesce("total_saved", F.lit(0)),
    }).drop("new")


def resolve_calls(calls: DataFrame, store: DataFrame) -> DataFrame:
    """Tool calls (``call_id, name, arguments``) with the original that their key names."""
    keyed = calls.withColumn("hash", F.when(F.col("name") == TOOL, F.get_json_object("arguments", "$.hash")))
    return keyed.join(store.select("hash", "original"), "hash", "left").select("call_id", "name", "hash", "original")


def transform_response(responses: DataFrame) -> DataFrame:
    """Responses go back as they came: a hook for what a backend's answers need."""
    return responses


def strip_fields(requests: DataFrame, names: list[str]) -> DataFrame:
    """Requests without fields that a backend refuses."""
    return requests.drop(*names)
