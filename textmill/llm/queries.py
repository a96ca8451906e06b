"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, html_text, packing, pii, quality_knn, quality_rules, simhash, token_counts, toxicity
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, window=2048, end_id=1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's own end token, 49407, separates the documents."""
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), WORD_BPE, end_id=49407)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"), html_text.fit())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def packing_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: whether the pieces of a document hold each of its ids once, and those of windows are gapless."""
    pieces = op1_packing(spark, sf_dir)
    fits = F.max(F.col("offset") + F.col("length")) <= 2048
    return pieces.groupBy("doc_id").agg(((F.sum("length") == F.max("doc_tokens")) & (F.min("start") == 0) & fits).alias("whole"))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: the counts and the base verdict."""
    counted = quality_rules.apply(table(spark, sf_dir, "documents"), None)
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: how many base spans of each kind a document holds."""
    return pii.find(table(spark, sf_dir, "documents"), pii.Model(-35.0, {}, {})).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: sizes, and digests of the edited texts."""
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality_knn": op8_quality_knn,
    "op9_html_extraction": op9_html_extraction,
    "op10_simhash": op10_simhash,
    "packing_whole": packing_whole,
    "rules_base": rules_base,
    "personal_base": personal_base,
    "edited_texts": edited_texts,
}

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT)
        ELSE 2 * CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) - 9 * (CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) > 4)::INT END)) % 10 = 0"""

#: DuckDB SQL where it can express the result: the trained verdicts, packed places, merged
#: ids and groups of the ten queries it can't, so these have what of them it can.
ORACLE_SQL: dict[str, str] = {
    "packing_whole": "SELECT doc_id, true AS whole FROM documents",
    "rules_base": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            t AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS tri FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM w)),
            o AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM t) WHERE n > 1),
            r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM o) GROUP BY doc_id),
            l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
            FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))""",
    "personal_base": rf"""
        SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
            CAST(len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda y: CAST(y AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
            CAST(len(list_filter(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
            CAST(len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "edited_texts": """
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(following, 1, n // 2)) AS edited_sha256 FROM (
            SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS following
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WINDOW o AS (ORDER BY doc_id DESC))""",
}
