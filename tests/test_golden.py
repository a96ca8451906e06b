"""Small texts written by hand: one for each ruling, and the edges of each operator."""

import pytest

from textmill.config import PROFILES, Config, profile
from textmill.operators import detect, diff, json, listing, logs, search
from textmill.operators import text as prose
from textmill.operators.code import strip_c_like, strip_python
from textmill.operators.pipeline import reduce_all
from textmill.plans import analytics
from textmill.functions.text import short_number


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_kinds(spark):
    texts = {
        "json": '{"a": [1, 2, 3], "b": "x"}', "text": "short",
        "diff": "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@ f\n-a\n+b",
        "code_python": "import os\nimport sys\n\ndef f():\n    return 1\n", "code_rust": "use std::io;\nfn main() {\n}\n#[test]\npub fn x() {}\n",
        "file_listing": "total 3\n-rw-r--r-- 1 a b 3 Jun 15 22:00 x\nlrw-r--r-- 1 a b 3 Jun 15 22:00 y",
        "search_results": "a.py:1:x\na.py:2:y\nb.py:3:z\n", "build_output": "error: a b\nwarning: c d\n3 passed e\n",
        "logs": "2024-01-01 10:00:00 INFO a\n2024-01-01 10:00:01 INFO b\n2024-01-01 10:00:02 INFO c\n",
    }
    found = by_id(detect.detect(frame(spark, *texts.values())), "content_type")
    assert [found[i] for i in range(len(texts))] == list(texts)


def test_dated_lines_are_search_hits_only_on_request(spark):
    text = "2024-01-01 10:00:00 INFO a\n2024-01-01 10:00:01 INFO b\n2024-01-01 10:00:02 INFO c\n"
    assert by_id(detect.detect(frame(spark, text), Config(date_prefix_is_log=False)), "content_type") == {0: "search_results"}


@pytest.mark.parametrize("text,valid", [
    ('{"a":1}', True), ("[1]", True), (' [1, {"b": 2}] \n', True), ('{"a":1} junk', False), ('{"a":1}{"a":2}', False), ('{"a":1},{"a":2}', False),
    ('{"a":1}],[{"a":2}', False), ('{"a":1}},{"b":{"c":1}', False), ("12", False), ('"x"', False), ("", False), ("[1,", False), ('{"a":{"b":[1,2]}}', True),
])
def test_json_validity(spark, text, valid):
    from pyspark.sql import functions as F

    assert frame(spark, text).select(detect.is_json(F.col("text"))).first()[0] is valid


def test_json_arrays(spark):
    rows = ['[{"b":1,"a":"x,y"},{"a":null,"b":2},{"a":"z","b":3},{"a":"z","b":4},{"a":"q","b":5}]', "[1,2,3,4,5,6]", '[{"a":1},{"b":2},{"a":1},{"a":1},{"a":1}]', '{"z":1,"a":{"y":2,"b":3}}', "not json"]
    done = {r["doc_id"]: (r["mode"], r["compressed"]) for r in json.reduce_json(frame(spark, *rows)).collect()}
    assert done[0] == ("columnar", 'COLUMNS\n# a, b\n"x,y",1\n,2\nz,3\nz,4\nq,5')
    assert done[1] == ("compact_array", "[1,2,3,4,5,6]") and done[2][0] == "compact_array"
    assert done[3] == ("compact_object", '{"a":{"b":3,"y":2},"z":1}') and done[4] == ("passthrough", "not json")


def test_large_strings_at_any_depth(spark):
    big = "x" * 999 + '\\"'
    text = '{"k": [{"deep": "%s"}], "s": "%s"}' % (big, "y" * 999)
    row = json.reduce_json(frame(spark, text)).first()
    assert "[stored:" in row["compressed"] and row["compressed"].count("y") == 999 and "x" * 50 not in row["compressed"]
    assert json.stored_strings(frame(spark, text)).first()["original"] == "x" * 999 + '"'


@pytest.mark.parametrize("value,text", [(0.0, "0"), (5.0, "5"), (12.0, "12"), (99.6, "1e+02"), (123.0, "1.2e+02"), (100.0, "1e+02"), (0.5, "0.5"), (0.00012, "0.00012"), (-1234.0, "-1.2e+03"), (0.000012, "1.2e-05")])
def test_short_numbers(spark, value, text):
    from pyspark.sql import functions as F

    assert spark.range(1).select(short_number(F.lit(value))).first()[0] == text == f"{value:.2g}"


def test_logs(spark):
    lines = ["", "2024-01-01 10:00:00 start", "", "", "2024-01-01 10:00:01 start", "Traceback (most", "2024-01-01 10:00:02 start", "once", "twice", "twice", "  ", "Traceback (most"]
    assert by_id(logs.reduce_logs(frame(spark, "\n".join(lines))), "compressed")[0].split("\n") == [
        "[x3] 2024-01-01 10:00:00 start", "[last]  2024-01-01 10:00:02 start", "", "Traceback (most", "once", "twice", "", "Traceback (most",
    ]


def test_log_headline_and_cap(spark):
    row = logs.reduce_logs(frame(spark, "\n".join(f"line {chr(97 + i % 26)}{i}x" for i in range(300)))).first()
    out = row["compressed"].split("\n")
    assert out[0] == "# 300 lines, 300 unique patterns" and len(out) == row["compressed_lines"] == 201 and out[100] == "... 101 more lines truncated ..."


def test_log_blocks(spark):
    assert by_id(logs.collapse_blocks(frame(spark, "\n\n".join(["a\nb"] * 3 + ["c"]))), "compressed") == {0: "[x3] a\nb\nc"}


def test_search(spark):
    text = "\n".join(["--", "a.py:9:error here", "   more", "a.py-10-context", "note: said", "x.: no", "b.py:1:plain", *[f"c.py:{i}:t{i}" for i in range(1, 8)]])
    assert by_id(search.reduce_search(frame(spark, text)), "compressed")[0] == (
        "# c.py (4/7 matches)\n  1:t1\n  2:t2\n  3:t3\n  7:t7\n# a.py (2/2 matches)\n  9:error here\nmore\n  10:context\n# note (1/1 matches)\n  0:said\n# b.py (1/1 matches)\n  1:plain"
    )


def test_search_caps(spark):
    row = search.reduce_search(frame(spark, "\n".join(f"f{i % 20}.py:{i}:x" for i in range(100)))).first()
    assert row["compressed_files"] == 15 and row["compressed_matches"] == 30 and row["compressed"].endswith("... 9 more files with matches ...")


def test_diff(spark):
    head = ["diff --git a/x b/x", "index 1..2", "--- a/x", "+++ b/x"]
    hunk = ["@@ -1,5 +1,5 @@", " 1", " 2", " 3", "-a", "+b", " 4", " 5", " 6", "\\ No newline at end of file"]
    out = by_id(diff.reduce_diff(frame(spark, "\n".join(head + hunk))), "compressed")[0].split("\n")
    assert out == head + ["@@ -1,5 +1,5 @@", " 1", " 2", "-a", "+b", " 4", " 5", "\\ No newline at end of file"]
    bare = by_id(diff.reduce_diff(frame(spark, "\n".join(head + hunk)), Config(bare_hunks=False)), "compressed")[0]
    assert bare == "\n".join(head + hunk)
    many = "\n".join(f"diff --git a/{i} b/{i}\n@@ -1,1 +1,1 @@ f\n+x" for i in range(25))
    assert diff.stats(frame(spark, many)).first().asDict() == {"doc_id": 0, "files_affected": 20, "additions": 20, "deletions": 0, "hunks_kept": 20}
    assert by_id(diff.reduce_diff(frame(spark, many)), "compressed")[0].count("diff --git") == 25


def test_listing(spark):
    text = "total 8\ndrwxr-xr-x  2 a b 4096 Jun 15 22:00 d\nlrwxrwxrwx  1 a b 2560 Jun 15 2024 l\n-rw-r--r--  1 a b 5242880 Jun 15 22:00 big file\n-rw-r--r--  1 a b 12 Jun 15 22:00 s\nother"
    assert by_id(listing.reduce_listing(frame(spark, text)), "compressed")[0].split("\n") == [
        "[total: 8 blocks]", "      4K Jun 15 22:00 d/", "      2K Jun 15 2024 l@", "    5.0M Jun 15 22:00 big file", "      12 Jun 15 22:00 s", "other",
    ]


def test_code(spark):
    from pyspark.sql import functions as F

    py = 'def f():\n    """One."""\n    """Two\n    x = 1\n    """\n    # gone\n    s = 1  # stays\n\n\n\n    return s\n"""Long\nbody"""\ny = 2'
    c = "// a\nint x; /* b */ int y;\n/* c\n * d\n */\nint z; /* e\n*/\n* f\n\n\nurl();"
    row = frame(spark, py, c).agg(F.max(F.when(F.col("doc_id") == 0, strip_python(F.col("text")))), F.max(F.when(F.col("doc_id") == 1, strip_c_like(F.col("text"))))).first()
    assert row[0] == "def f():\n    s = 1  # stays\n\n    return s\ny = 2"
    assert row[1] == "int x;  int y;\nint z;\n\nurl();"


def test_prose(spark):
    cfg = Config(text_max_chars=30, text_head_chars=10, text_tail_chars=10, boundary_chars=8)
    text = "0123456789ab\n\ncdefghijklmnopqrstu\n\n\nvw\nxyz0123456"
    out = by_id(prose.reduce_text(frame(spark, text, "x" * 30, "y" * 31), cfg), "compressed")
    assert out[0].startswith("0123456789ab\n\n... [middle left out: ~") and out[0].endswith("\n\n\nvw\nxyz0123456")
    assert out[1] == "x" * 30 and out[2].startswith("y" * 18 + "\n... [middle left out: ~3 chars")


def test_overlapping_head_and_tail_drop_nothing(spark):
    cfg = Config(text_max_chars=10, text_head_chars=10, text_tail_chars=10, boundary_chars=4)
    assert "~0 chars" in by_id(prose.reduce_text(frame(spark, "a" * 12), cfg), "compressed")[0]


def test_null_empty_and_repeated_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 20), (4, "x" * 20)], "doc_id long, text string")
    assert by_id(detect.detect(df), "content_type") == {1: "text", 2: "text", 3: "text", 4: "text"}
    assert reduce_all(df).count() == 0
    tiny = Config(min_compress_chars=-1)
    assert reduce_all(df.where("text IS NOT NULL"), tiny).count() == 3


def test_unreducible_hint_stays_as_it_is(spark):
    df = spark.createDataFrame([(1, "z" * 4000, "code_generic")], "doc_id long, text string, hint string")
    row = reduce_all(df, hint="hint").first()
    assert (row["content_type"], row["was_compressed"], row["compressed"]) == ("code_generic", False, "z" * 4000)


def test_profiles(spark):
    assert profile("aggressive").log_min_repetitions == 2 and profile("balanced") == Config()
    with pytest.raises(ValueError):
        profile("none")
    for name in PROFILES:
        config = spark.createDataFrame(analytics.config_rows(profile(name)), "key string, value string")
        assert analytics.detect_profile(config).first()["profile"] == name
    nothing = spark.createDataFrame([("min_compress_chars", "7")], "key string, value string")
    assert analytics.detect_profile(nothing).first()["profile"] == "balanced"
