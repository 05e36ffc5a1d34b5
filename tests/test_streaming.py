"""Keyed state over several micro-batches."""

from __future__ import annotations

from quarry.operators import traces
from quarry.operators.context import context_blocks
from quarry.operators.wiki import template_fields
from quarry.streaming import state
from quarry.streaming.log import BatchLog


def batches(spark, path, schema, *parts):
    """A stream that brings each part as a micro-batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_session_list_keeps_dropped_traces_out(spark, tmp_path):
    schema = "session_id string, trace_id string, us long"
    stream = batches(spark, tmp_path / "in", schema,
                     [("s", f"t{i}", i) for i in range(1, 4)], [("s", "t4", 4), ("s", "t5", 5), (None, "t6", 9)],
                     [("s", "t1", 99)])
    log = BatchLog(spark, "test-sessions", str(tmp_path / "log"))
    log.run(state.session_stream(stream, 2, ttl_ms=None), "update")
    got = log.latest(["session_id"]).orderBy("rank").collect()
    assert [(r.session_id, r.trace_id) for r in got] == [("s", "t5"), ("s", "t4")]


def test_session_list_follows_an_earlier_start(spark, tmp_path):
    schema = "session_id string, trace_id string, us long"
    stream = batches(spark, tmp_path / "in", schema, [("s", f"t{i}", i) for i in range(1, 6)], [("s", "t5", 0)])
    log = BatchLog(spark, "test-sessions", str(tmp_path / "log"))
    log.run(state.session_stream(stream, 2, ttl_ms=None), "update")
    assert [r.trace_id for r in log.latest(["session_id"]).orderBy("rank").collect()] == ["t4", "t3"]


def test_trace_records_in_any_order_of_arrival(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = "trace_id string, session_id string, event_id long, us long, name string, phase string, error string"
    rows = [("a", "s", i, 1000 * i, "react.step" if i % 2 else "note", "p", None) for i in range(1, 300)]
    rows += [("a", "s", 400, 500_000, "span.end", "p", ""), ("b", "s", 1, 5, "span.end", "p", "bad"), ("b", "late", 2, 9, "note", "p", None)]
    log = BatchLog(spark, "test-traces", str(tmp_path / "log"))
    log.run(state.trace_stream(batches(spark, tmp_path / "in", schema, rows[200:], rows[:100], rows[100:200]), ttl_ms=None), "update")
    cols = ["trace_id", "session_id", "status", "duration_ms", "n_events", "n_steps"]
    got = {r.trace_id: tuple(r) for r in log.latest(["trace_id"]).select(*cols).collect()}
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).withColumn(
        "payload", F.lit("{}")).withColumn("duration_ms", F.lit(1))
    batch = traces.trace_records(events).withColumn("n_events", F.size("events")).withColumn(
        "n_steps", F.coalesce(F.size("steps"), F.lit(0)))
    assert got == {r.trace_id: tuple(r) for r in batch.select(*cols).collect()}
    assert got["a"] == ("a", "s", "success", 499, 200, 100) and got["b"][1:3] == ("s", "failed")


def test_preferred_template_block(spark):
    plain, best, other = "{{宠物信息框\n|a=0\n}}\n{{宠物信息\n|a=1\n}}", "{{宠物信息/精灵\n|a=2\n}}", "{{精灵信息\n|a=3\n}}"
    df = spark.createDataFrame([(1, plain), (2, plain + best), (3, other + plain), (4, other), (5, "none"), (6, None)], "id int, text string")
    got = {r.id: (r.key, r.value) for r in template_fields(df, "id", "text").collect()}
    assert got == {1: ("a", "1"), 2: ("a", "2"), 3: ("a", "1"), 4: ("a", "3")}


def test_context_blocks_in_one_pass(spark):
    hits = spark.createDataFrame([(1, i, 10 + i, 0.5, "x" * 600) for i in range(1, 8)], "query_id int, rank int, id int, score double, content string")
    row = context_blocks(hits, "chat", "tool", "eval", "prompt").first()
    assert row.chat.startswith("[1] xxx") and len(row.chat.split("\n\n")[6]) == 504
    assert row.tool.split("\n\n")[1] == "[2] (相关度=0.50)\n" + "x" * 300
    assert row.eval == "\n".join(["x" * 300] * 5) and row.prompt.count("(id=") == 7 and len(row.prompt) > 4200


def test_traces_of_a_bucket_share_a_call(spark, tmp_path):
    """All traces in one bucket, in two triggers: each has its own record, and the row of a later trigger follows it."""
    schema = "trace_id string, session_id string, event_id long, us long, name string, phase string, error string"
    first = [(f"t{i}", f"s{i}", i, 1000 * i, "react.step", "p", None) for i in range(20)]
    second = [(f"t{i}", "late", 100 + i, 50_000, "span.end", "p", None) for i in range(0, 20, 2)]
    log = BatchLog(spark, "test-buckets", str(tmp_path / "log"))
    log.run(state.trace_stream(batches(spark, tmp_path / "in", schema, first, second), None, 1), "update")
    got = {r.trace_id: (r.session_id, r.status, r.started_us, r.duration_ms, r.n_events, r.n_steps)
           for r in log.latest(["trace_id"]).collect()}
    assert got == {f"t{i}": (f"s{i}", "success", 1000 * i, 50 - i, 2, 1) if i % 2 == 0 else (f"s{i}", "running", 1000 * i, None, 1, 1)
                   for i in range(20)}
