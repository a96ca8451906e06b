"""Corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Each stage takes all rows that the one before kept, and its decisions take effect: toxic
documents and documents that fail the quality rules go, one document of each group of
near-duplicates stays, personal data gives way to placeholders, and what remains is
packed. All stages but the last return the columns of ``documents``. Classifiers learn
from ``labels`` on the rows that reach their stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import packing, pii, quality_rules, simhash, toxicity
from textmill.llm.common import table, written
from textmill.llm.queries import WORD_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORD_BPE, window=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SQL can't express the trained stages, the bit-sliced groups or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
