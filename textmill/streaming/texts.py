"""Streams of texts.

Reducers that look at one text at a time run unchanged on a stream. Those that explode
lines into windows run on each micro-batch; the restore store takes each batch as one
append, and equal texts within the watermark are dropped before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..functions.text import content_key
from ..operators.detect import accounted, detect, large_enough
from ..operators.pipeline import reduce_all
from ..operators.text import reduce_text
from ..sources.scratch import clear
from ..sources.store import Store


def stream_text_reduce(texts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Head and tail of long prose, on a stream or a batch."""
    rows = detect(large_enough(texts, cfg), cfg).where("content_type = 'text'").select("doc_id", "text", "content_type", F.lit("text").alias("compressor"))
    return accounted(reduce_text(rows, cfg), cfg)


def distinct_texts(texts: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Texts without those whose key came before within the watermark."""
    keyed = texts.withWatermark(event_time, delay).withColumn("hash", content_key(F.col("text")))
    return keyed.dropDuplicatesWithinWatermark(["hash"])


def reduce_stream(texts: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, cfg: Config = Config(), store: Store | None = None) -> StreamingQuery:
    """All reducers on every micro-batch; ``sink`` gets the batch's common result."""

    def batch(df: DataFrame, epoch: int) -> None:
        result = reduce_all(df, cfg, keep=("text",))
        sink(result.drop("text"))
        if store is not None:
            store.put(result.where("was_compressed"))
        clear(df.sparkSession)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
