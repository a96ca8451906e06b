"""Restore store, files, requests and streams."""

from pyspark.sql import functions as F

from textmill.config import Config, from_file, from_session
from textmill.operators import history, requests
from textmill.operators.pipeline import reduce_all
from textmill.sources import files
from textmill.sources.store import Store
from textmill.streaming.texts import distinct_texts, reduce_stream

LOG = "\n".join(f"2024-01-01 10:00:{i % 60:02d} INFO worker did its usual thing" for i in range(100))


def results(spark, *texts):
    rows = [(i, t, f"short {i}", "logs", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, compressed string, content_type string, t long").withColumn("compressed_at", F.timestamp_seconds("t"))


def test_store_round_trip_eviction_and_clear(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), Config(store_max_entries=3))
    assert store.read().count() == 0
    store.put(results(spark, "a", "b", "a"))
    store.put(results(spark, "b", "c", "d"))
    assert store.read().count() == 4
    keys = store.read().select("hash").unionByName(spark.createDataFrame([("missing",)], "hash string"))
    got = {r["original"] for r in store.get(keys).collect()}
    assert got == {"a", "b", "c", "d", None}
    store.evict()
    assert sorted(r["original"] for r in store.read().collect()) == ["b", "c", "d"]
    store.clear()
    assert store.read().count() == 0


def test_reduced_texts_are_restored(spark, tmp_path):
    texts = spark.createDataFrame([(1, LOG), (2, "prose " * 3000)], "doc_id long, text string")
    done = reduce_all(texts).where("was_compressed")
    assert done.count() == 2 and done.where("compressed_chars >= original_chars").count() == 0
    store = Store(spark, str(tmp_path / "store"))
    store.put(done.join(texts, "doc_id"))
    back = store.get(done.select("doc_id", "hash")).join(texts, "doc_id")
    assert back.where("original = text").count() == 2


def test_files_and_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text(LOG)
    texts = files.read_texts(spark, str(tmp_path / "in"))
    assert texts.first()["text"] == LOG
    done = reduce_all(texts)
    assert files.write_companions(done, str(tmp_path / "out"), dry_run=True).count() == 1 and not (tmp_path / "out").exists()
    (tmp_path / "r.json").write_text('{"request_id": 1, "messages": [{"role": "user", "content": "x"}]}\n{broken\n')
    good, bad = files.read_requests(spark, str(tmp_path / "r.json"))
    assert good.cache().count() == 1 and bad.cache().count() == 1
    files.append_metrics(spark.createDataFrame([(2, 100), (0, 0)], "compressed long, chars_saved long"), str(tmp_path / "m"))
    assert files.metrics_summary(spark.read.json(str(tmp_path / "m"))).first().asDict() == {"requests": 2, "requests_compressed": 1, "compressions": 2, "chars_saved": 100}


def test_requests_are_rewritten_in_place(spark):
    schema = files.REQUEST
    item = [("tool_result", None, LOG), ("text", "keep", None)]
    rows = [
        (1, False, None, [("user", None, item), ("assistant", "fine", None)]),
        (2, True, None, [("user", LOG, None)]),
        (3, False, None, [("user", LOG, None), ("assistant", LOG, None)]),
    ]
    out = {r["request_id"]: r for r in requests.transform_requests(spark.createDataFrame(rows, schema)).collect()}
    assert out[1]["messages"][0]["items"][0]["content"].startswith("# 100 lines") and out[1]["messages"][0]["items"][1]["text"] == "keep"
    assert out[2]["messages"][0]["content"] == LOG and out[2]["tools"] is None
    assert out[3]["messages"][0]["content"].startswith("# 100 lines") and out[3]["messages"][1]["content"] == LOG
    assert out[1]["tools"][0]["function"]["name"] == requests.TOOL
    again = spark.createDataFrame([(1,)], "x int").select(requests.with_tool(requests.with_tool(F.lit(None).cast(f"array<{requests._TOOL_TYPE}>"))).alias("t"))
    assert len(again.first()["t"]) == 1


def test_history_guards(spark):
    turns = [(1, 0, "system", LOG), (1, 1, "user", LOG), (1, 2, "assistant", LOG), (1, 3, "user", LOG), (1, 4, "assistant", "ok"), (2, 0, "user", LOG)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r["text"] for r in history.rewrite(df, Config(history_threshold_chars=10000, history_keep_recent=2)).collect()}
    assert out[1, 1].startswith("[Reduced: text of turn 1 (") and all(out[k] == t for *k, _, t in turns if tuple(k) != (1, 1) for k in [tuple(k)])


def test_stream_equals_batch(spark, tmp_path):
    texts = spark.createDataFrame([(1, LOG), (2, "prose " * 3000), (3, "small")], "doc_id long, text string")
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    reduce_stream(stream, lambda df: df.write.mode("append").parquet(sink), str(tmp_path / "cp"), store=Store(spark, str(tmp_path / "store"))).awaitTermination()
    assert sorted(spark.read.parquet(sink).collect()) == sorted(reduce_all(texts).collect())
    assert Store(spark, str(tmp_path / "store")).read().count() == 2


def test_equal_texts_within_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 10), (2, "a", 11), (3, "b", 12)], "doc_id long, text string, t long").withColumn("at", F.timestamp_seconds("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = distinct_texts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "at", "1 minute")
    q = stream.writeStream.format("memory").queryName("distinct_texts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_texts").count() == 2


def test_command_line(spark, tmp_path, capsys):
    from textmill.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text(LOG)
    store = str(tmp_path / "store")
    assert main(["reduce", str(tmp_path / "in"), str(tmp_path / "out"), "--dry-run", "--store", store], spark) == 0 and not (tmp_path / "store").exists()
    assert main(["reduce", str(tmp_path / "in"), str(tmp_path / "out"), "--store", store, "--profile", "aggressive"], spark) == 0
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["path"].endswith("a.log") and "1 texts reduced" in capsys.readouterr().out
    assert main(["retrieve", row["hash"], "--store", store], spark) == 0 and capsys.readouterr().out == LOG + "\n"
    assert main(["retrieve", "nothing", "--store", store], spark) == 1
    assert main(["stats", "--store", store], spark) == 0 and "1 entries" in capsys.readouterr().out
    assert main(["clear", "--store", store], spark) == 0 and not (tmp_path / "store").exists()


def test_dispatch_reads_its_source_once(spark, tmp_path):
    """The source is classified and written once; the result reads the written table only."""
    spark.createDataFrame([(1, LOG), (2, "prose " * 3000)], "doc_id long, text string").write.parquet(str(tmp_path / "source"))
    done = reduce_all(spark.read.parquet(str(tmp_path / "source")))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan and plan.count("classified") > 0 and done.count() == 2


def test_null_and_repeated_ids_are_reduced(spark):
    texts = spark.createDataFrame([(None, LOG), (None, LOG + "\nmore"), (1, LOG), (1, LOG), (2, "prose " * 3000), (None, "prose " * 3000)], "doc_id long, text string")
    rows = reduce_all(texts).collect()
    assert len(rows) == 6 and all(r["was_compressed"] for r in rows) and sum(r["doc_id"] is None for r in rows) == 3


def test_far_places_in_requests_and_conversations(spark):
    far = [("assistant", "x", None)] * 5000 + [("user", LOG, None)]
    rows = spark.createDataFrame([(2**60, False, None, far)], files.REQUEST)
    found = requests.walk(rows).first()
    assert (found["request_id"], found["msg"], found["item"]) == (2**60, 5000, -1)
    turns = [(2**60, 0, "user", LOG), (2**60, 1, "assistant", LOG), (2**60, 2**40, "user", "ok")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r["turn"]: r["text"] for r in history.rewrite(df, Config(history_threshold_chars=10, history_keep_recent=1)).collect()}
    assert out[0].startswith("[Reduced: text of turn 0 (") and out[1] == LOG and out[2**40] == "ok"


def test_items_in_history(spark):
    """Contents of items count, their texts don't; the first large tool result or text gives way."""
    schema = "conv_id long, turn long, role string, text string, items array<struct<type:string,text:string,content:string>>"
    items = [("text", "short", None), ("tool_result", None, LOG), ("text", LOG + "!", None)]
    turns = [(1, 0, "user", None, items), (1, 1, "user", None, [("text", LOG, None)]), (1, 2, "user", "new", None), (2, 0, "user", None, [("text", LOG, None)]), (2, 1, "user", "x", None)]
    df = spark.createDataFrame(turns, schema)
    cfg = Config(history_threshold_chars=2000, history_keep_recent=1)
    assert {r["conv_id"]: r["total_chars"] for r in history.conversation_sizes(df, cfg).collect()} == {1: len(LOG) + 3, 2: 1}
    out = {(r["conv_id"], r["turn"]): r for r in history.rewrite(df, cfg).collect()}
    assert out[1, 0]["items"][1]["content"].startswith("[Reduced: text of turn 0") and out[1, 0]["items"][2]["text"] == LOG + "!" and out[1, 0]["items"][0]["text"] == "short"
    assert out[1, 1]["items"][0]["text"].startswith("[Reduced: text of turn 1") and out[2, 0]["items"][0]["text"] == LOG
    stats = {r["conv_id"]: r for r in history.stats(df, cfg).collect()}
    assert [e["turn"] for e in stats[1]["entries"]] == [0, 1] and stats[2]["compressed_count"] == 0


def test_texts_that_share_a_short_key_are_all_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), Config(hash_length=1))
    store.put(results(spark, *map(str, range(40))))
    assert store.read().count() == 40 and store.read().select("hash").distinct().count() <= 16
    assert store.get(store.read().select("hash").distinct()).count() == 40


def test_an_eviction_that_is_cut_off_loses_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.put(results(spark, "a", "b"))
    (tmp_path / "store").rename(tmp_path / "store.old")
    assert store.read().count() == 2 and (tmp_path / "store").exists()


def test_thresholds_from_file_and_session(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# ours\nprofile: aggressive\nlog_min_repetitions: 7\njson_auto_columnar: false\n")
    cfg = from_file(str(tmp_path / "c.yaml"))
    assert (cfg.log_min_repetitions, cfg.json_auto_columnar, cfg.text_max_chars) == (7, False, 5000)
    spark.conf.set("textmill.search_max_files", "3")
    assert from_session(spark).search_max_files == 3
    spark.conf.unset("textmill.search_max_files")
