"""Queries that leave no row of their table out."""

from conftest import SF_DIR
from pyspark.sql import functions as F

from textmill.plans.queries import QUERIES
from textmill.sources.fixtures import fixture


def test_store_queries_reach_every_text(spark):
    texts = fixture(spark, SF_DIR, "logs_iso").cache()
    got = QUERIES["store_get"](spark, SF_DIR)
    assert got.where("original IS NOT NULL").count() == texts.count() and got.where("original IS NULL").count() == 3
    put = QUERIES["store_put"](spark, SF_DIR).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["batch"] for r in put} == {1, 2} and sum(r["n"] for r in put) == texts.select("text").distinct().count()


def test_json_queries_reach_every_document(spark):
    """Strings on both sides of the limit of 1,000 characters."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    made = QUERIES["json_large_strings"](spark, SF_DIR).cache()
    assert made.count() == docs.count() == QUERIES["field_fidelity"](spark, SF_DIR).first()["body"]
    stored = docs.where("n_chars >= 1000").count()
    assert 0 < stored < docs.count() and made.where("compressed LIKE '%\"[stored:%'").count() == stored
    assert QUERIES["json_stored_strings"](spark, SF_DIR).count() == 2 * stored
