"""Texts of very many lines: joined and cut piece by piece, so that no task holds an array of all lines."""

import re

import pytest
from conftest import SF_DIR

from textmill.functions import text as functions
from textmill.plans.queries import QUERIES
from textmill.sources import fixtures


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(functions, "PIECE", 3)
    texts = ["", "\n", "a", "a\n", "a\nb\nc", "a\nb\nc\n", "\n\n\n\n\n\n\n", "é\r\n\n日本\n d\ne\nf\ng h", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for dealt in (False, True):
        found = sorted((r["doc_id"], r["pos"], r["line"]) for r in functions.text_lines(df, dealt=dealt).collect())
        assert found == [(i, k, line) for i, t in enumerate(texts) if t is not None for k, line in enumerate(t.split("\n"))]


def test_long_line_groups_keep_the_stack(spark):
    text = "\n".join(str(i) for i in range(3 * functions.PIECE + 1))
    rows = functions.text_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["pos"], r["line"]) for r in rows] == [(i, str(i)) for i in range(3 * functions.PIECE + 1)]


@pytest.mark.parametrize("name", sorted(k for k, sql in fixtures.FIXTURES.items() if "@agg" in sql))
def test_fixtures_of_pieces(spark, duck, monkeypatch, name):
    monkeypatch.setattr(fixtures, "PIECE", 5)
    made = fixtures.fixture(spark, SF_DIR, name)
    assert "row_number()" in plan(made)
    ours = sorted((r["doc_id"], r["kind"], r["text"]) for r in made.collect())
    assert ours == sorted(duck.execute(f"SELECT doc_id, kind, text FROM ({fixtures.oracle(name)})").fetchall())


def test_analysis_diff_all_reads_lines_once_for_either_side(spark):
    assert len(re.findall(r"Relation \[event_id", plan(QUERIES["analysis_diff_all"](spark, SF_DIR)))) == 2


def test_dispatch_writes_long_texts_in_pieces(spark):
    """No later row holds a very long text whole; results are those of short ones."""
    from textmill.functions.text import PIECE
    from textmill.operators import pipeline

    seen, keep = [], pipeline.written
    pipeline.written = lambda df, *a: seen.append(keep(df, *a)) or seen[-1]
    try:
        text = "diff --git a/x b/x\n@@ -1,2 +1,2 @@\n" + "\n".join("+ -"[i % 3] + str(i) for i in range(2 * PIECE)) + "\n"
        row = pipeline.reduce_all(spark.createDataFrame([(1, text, "diff")], "doc_id long, text string, kind string"), hint="kind").first()
    finally:
        pipeline.written = keep
    pieces = [r["text"] for r in seen[0].orderBy("text_piece").collect()]
    assert len(pieces) == 3 and max(p.count("\n") for p in pieces) == PIECE and "".join(pieces) == text + "\n"
    assert row["original_chars"] == len(text) and row["was_compressed"] is False and row["compressed"] == text


def test_union_of_sources_is_not_copied_step_by_step(spark, monkeypatch):
    """Filter, detection and cutting stand above the union: below it, each would write every text anew."""
    from textmill.operators import pipeline
    from textmill.plans.queries import all_fixtures

    plans = []
    monkeypatch.setattr(pipeline, "written", lambda df, *a: plans.append(plan(df)) or df)
    pipeline.reduce_all(all_fixtures(spark, SF_DIR, ["code_py", "logs_mixed"]), hint="kind")
    top, below = plans[0].split("Union", 1)
    assert "regexp_extract_all" in top and "Filter" in top and "regexp_extract_all" not in below and "lambda" not in top


def test_hits_in_the_text_are_hits_of_lines(spark):
    from textmill.operators import detect

    lines = ["def f():", "", "   ", " class A", "a:1:x", "b:", "b: ", "c.py-3-x", "[INFO] 10:00:00", "2024-01-01 x.py:1:y", "\tfrom x\r", "error: failed", "type A", "x: string", "#[test]", "total 5", "\x0bimport y"]
    texts = ["\n".join(lines[k:] + lines[:k]) for k in range(len(lines))] + ["", "\n", "\n\ndef f()", "a:\n\nb:\n\nc:\n\n", "a:\r\nb:\r\nc:\r\n"]
    rows = detect.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        for kind, patterns in detect.PATTERNS.items():
            part = r["text"].split("\n")[: detect.LOOKED_AT.get(kind, 15)]
            n = sum(bool(re.search(p, x, re.A)) and not (kind == "search_results" and re.search(detect.DATED, x)) for p in patterns for x in part)
            assert r[f"hits_{kind}"] == (n if n >= 3 or kind not in detect.AT_LEAST_3 else 0), (r["doc_id"], kind)
