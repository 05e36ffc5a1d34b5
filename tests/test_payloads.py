from pyspark.sql import functions as F

from quarry.functions.text import trim_nested
from quarry.operators import catalog, traces

MARK = "...[truncated]"


def cut(value, chars, items, keys):
    """Plain version on Python values."""
    if isinstance(value, str):
        return value if len(value) <= chars else value[:chars] + MARK
    if isinstance(value, list):
        return [cut(v, chars, items, keys) for v in value[:items]]
    if isinstance(value, dict):
        return {k: cut(v, chars, items, keys) for k, v in list(value.items())[:keys]}
    return value


def test_nested_payload_is_cut_at_every_depth(spark):
    values = [{"a": [["x" * 9, None, ""], [], None], "b": [["yy", "z" * 5]], "c": []}, {}, None,
              {f"k{i}": [["v" * i] * i] * i for i in range(6)}]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, p map<string, array<array<string>>>")
    got = df.select("id", trim_nested(F.col("p"), df.schema["p"].dataType, 4, 2, 3).alias("p")).orderBy("id").collect()
    for row, value in zip(got, values, strict=True):
        assert row.p == cut(value, 4, 2, 3)


def test_nested_struct_keeps_nulls_and_other_types(spark):
    df = spark.createDataFrame([(("abcdef", 7, [("qwerty", 1.5)]),), (None,)], "p struct<s: string, n: int, l: array<struct<t: string, x: double>>>")
    got = [r.p for r in df.select(trim_nested(F.col("p"), df.schema["p"].dataType, 3).alias("p")).collect()]
    assert got[0].asDict(True) == {"s": "abc" + MARK, "n": 7, "l": [{"t": "qwe" + MARK, "x": 1.5}]}
    assert got[1] is None


EVENTS = ("trace_id string, event_id long, ts long, name string, phase string, payload string, duration_ms int, error string, "
          "span_id string, mode string, intent string, action string, tool string, subtask_id string, status string, "
          "action_input map<string, string>")


def event(trace, n, name, phase=None, error=None, span=None, mode=None, intent=None, action=None, tool=None, sub=None,
          status=None, payload=None):
    return (trace, n, n // 2, name, phase, payload, 3, error, span, mode, intent, action, tool, sub, status, None)


def test_steps_name_what_they_called(spark):
    rows = [event("t", 1, "react.step", phase="think", action="", tool="calc", payload="p" * 4001),
            event("t", 2, "plan_execute", sub="s1", error="late"),
            event("t", 3, "react.step", error="", action="find", status="skipped", span="x"),
            event("t", 4, "note", action="no step")]
    got = traces.traced_steps(spark.createDataFrame(rows, EVENTS)).orderBy("index").collect()
    assert [(r["index"], r.phase, r.status, r.action, r.span_id) for r in got] == [
        (1, "think", "success", "calc", None), (2, "s1", "error", "s1", None), (3, "react.step", "skipped", "find", "x")]
    assert got[0].raw == "p" * 4000 + MARK and got[1].raw is None and got[0].action_input is None


def test_steps_beyond_the_limit_keep_their_index(spark):
    rows = [event("hot", n, "react.step", action=str(n)) for n in range(250)] + [event("b", 1, "react.step")]
    got = traces.traced_steps(spark.createDataFrame(rows, EVENTS)).filter("trace_id = 'hot'").orderBy("index").collect()
    assert [(r["index"], r.action) for r in got] == [(n + 1, str(n)) for n in range(150, 250)]


def test_origins_come_from_the_first_start(spark):
    rows = [event("a", 1, "note", span="s0", mode="late", intent="n"), event("a", 2, "span.start", span="s1", mode="plan", intent="i"),
            event("a", 3, "span.start", span="s2", mode="other"), event("b", 5, "note", span="s9", mode="plan", intent="i"),
            event("c", 6, "span.start", mode="")]
    got = traces.trace_origins(spark.createDataFrame(rows, EVENTS)).orderBy("trace_id").collect()
    assert [tuple(r) for r in got] == [("a", "s1", "plan", "i"), ("b", "s9", "react", None), ("c", None, "react", None)]


def test_cap_keeps_the_newest(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 0)], "trace_id string, started_at long")
    assert [r.trace_id for r in catalog.cap_traces(df, 2).collect()] == ["c", "b"]
    assert catalog.cap_traces(df).count() == 4
