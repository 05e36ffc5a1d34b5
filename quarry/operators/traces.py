"""Traces, sessions and usage in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import first_nonempty, is_hex_trace_id, trim_nested, trim_string
from quarry.operators.ordered import previous
from quarry.operators.ranking import top_k

MAX_EVENTS, MAX_STEPS = 200, 100  # fixed values
STEP_NAMES = ("react.step", "plan_execute")  # fixed values


def span_parents(spans: DataFrame) -> DataFrame:
    """Explicit parent, else the span opened just before in the trace.

    ``spans`` has (trace_id, span_id, start_time, parent_span_id, is_root).
    """
    linked = previous(spans, ["trace_id"], ["start_time", "span_id"], F.date_trunc("hour", "start_time"),
                      "span_id", "_before")
    parent = F.when(~F.col("is_root"), F.coalesce("parent_span_id", "_before"))
    return linked.withColumn("parent_span_id", parent).drop("_before")


def step_rows(events: DataFrame) -> DataFrame:
    """Last steps of each trace; the index keeps counting.

    The position is the count minus the backward rank, so no trace is ever
    ordered as a whole: the rank limit drops all but the last rows per task.
    """
    steps = events.filter(F.col("name").isin(*STEP_NAMES))
    counts = steps.groupBy("trace_id").agg(F.count("*").alias("_n"))
    last = top_k(steps, ["trace_id"], [F.col("ts").desc(), F.col("event_id").desc()], MAX_STEPS, "_r")
    return (last.join(counts, "trace_id").withColumn("index", F.col("_n") - F.col("_r") + 1)
            .withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise("success"))
            .withColumn("observation", trim_string(F.col("payload")))
            .select("trace_id", "index", "ts", F.col("phase"), "status", "observation", "duration_ms", "error"))


def trace_heads(events: DataFrame) -> DataFrame:
    """Session, status and times per trace, without its lists."""
    ended = F.col("name") == "span.end"
    head = events.groupBy("trace_id").agg(
        F.min_by("session_id", F.struct("ts", "event_id")).alias("session_id"), F.min("ts").alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("ended_at"),
        F.max_by("error", F.when(ended, F.struct("ts", "event_id"))).alias("error"))
    return (head.withColumn("status", F.when(F.col("ended_at").isNull(), "running")
                            .when(F.coalesce(F.col("error") != "", F.lit(False)), "failed").otherwise("success"))
            .withColumn("duration_ms", ((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000).cast("long"))
            .withColumn("otel_trace_id", F.when(is_hex_trace_id(F.col("trace_id")), F.col("trace_id"))))


def trace_records(events: DataFrame) -> DataFrame:
    """One record per trace: status, times, last events and steps.

    ``events`` has (trace_id, session_id, event_id, ts, name, phase, payload,
    duration_ms, error); ``span.start`` opens and ``span.end`` closes a trace.
    """
    head = trace_heads(events)
    last = top_k(events, ["trace_id"], [F.col("ts").desc(), F.col("event_id").desc()], MAX_EVENTS, "_r")
    packed = last.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(
        "ts", "event_id", "name", trim_string(F.col("payload")).alias("payload")))).alias("events"))
    steps = step_rows(events).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(
        "index", "phase", "status", "observation", "duration_ms", "error"))).alias("steps"))
    return head.join(packed, "trace_id").join(steps, "trace_id", "left")


def traced_steps(events: DataFrame) -> DataFrame:
    """Last steps of each trace with what they called and the payload they carried.

    ``events`` has the columns of ``trace_records`` and span_id, action, tool,
    subtask_id, action_input (a map or struct, or null) and status.  The action
    is the first of action, tool and subtask_id that is not empty, the phase
    the first of phase, subtask_id and the event's name; a step without status
    has failed if it has an error.
    """
    kind = events.schema
    one = lambda *names: F.nullif(first_nonempty(F.array(*[F.col(n).cast("string") for n in names])), F.lit(""))
    steps = events.filter(F.col("name").isin(*STEP_NAMES))
    counts = steps.groupBy("trace_id").agg(F.count("*").alias("_n"))
    last = top_k(steps, ["trace_id"], [F.col("ts").desc(), F.col("event_id").desc()], MAX_STEPS, "_r")
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    raw = trim_nested(F.col("payload"), kind["payload"].dataType)
    return last.join(counts, "trace_id").select(
        "trace_id", (F.col("_n") - F.col("_r") + 1).alias("index"), "ts", one("phase", "subtask_id", "name").alias("phase"),
        F.coalesce(one("status"), F.when(failed, "error").otherwise("success")).alias("status"),
        one("action", "tool", "subtask_id").alias("action"), "action_input", "duration_ms",
        trim_string(F.col("error")).alias("error"), "span_id", raw.alias("raw"))


def trace_origins(events: DataFrame) -> DataFrame:
    """Root span, mode and intent of each trace.

    ``events`` has (trace_id, event_id, ts, name, span_id, mode, intent).  They
    come from the first ``span.start``; a trace without one has the span of its
    first event, no intent, and like one that names no mode the mode ``react``.
    """
    at = F.struct("ts", "event_id")
    opened = F.when(F.col("name") == "span.start", at)
    found = events.groupBy("trace_id").agg(
        F.max(F.col("name") == "span.start").alias("_opened"), F.min_by("span_id", opened).alias("_root"),
        F.min_by("span_id", at).alias("_first"), F.min_by("mode", opened).alias("_mode"),
        F.min_by("intent", opened).alias("intent"))
    return found.select("trace_id", F.when(F.col("_opened"), F.col("_root")).otherwise(F.col("_first")).alias("root_span_id"),
                        F.coalesce(F.nullif("_mode", F.lit("")), F.lit("react")).alias("mode"), "intent")


def trace_steps(records: DataFrame) -> DataFrame:
    """Steps only, one row each."""
    return records.select("trace_id", F.explode("steps").alias("s")).select("trace_id", "s.*")


def replay(records: DataFrame) -> DataFrame:
    """Events and steps of each trace as one ordered list of rows."""
    events = records.select("trace_id", F.posexplode("events").alias("pos", "e")).select(
        "trace_id", F.lit("event").alias("kind"), "pos", F.col("e.name").alias("label"))
    steps = records.select("trace_id", F.posexplode("steps").alias("pos", "s")).select(
        "trace_id", F.lit("step").alias("kind"), "pos", F.col("s.phase").alias("label"))
    return events.unionByName(steps)


def session_traces(heads: DataFrame, limit: int = 50) -> DataFrame:
    """Newest traces per session (W5, J17, T3); ``heads`` has (session_id, trace_id, started_at)."""
    named = heads.filter(F.col("session_id").isNotNull())
    return top_k(named, ["session_id"], [F.col("started_at").desc(), F.col("trace_id")], limit)


def usage_totals(usage: DataFrame, prompt_price: float = 0.27, completion_price: float = 1.10) -> DataFrame:
    """Requests, tokens, cost and shares.

    ``usage`` has (prompt_tokens, completion_tokens, total_tokens); prices are
    per million tokens.
    """
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    t = usage.agg(F.count("*").alias("requests"), n("total_tokens"), n("prompt_tokens"), n("completion_tokens"))
    return with_cost(t, prompt_price, completion_price)


def with_cost(totals: DataFrame, prompt_price: float = 0.27, completion_price: float = 1.10) -> DataFrame:
    p, c = F.col("prompt_tokens"), F.col("completion_tokens")
    share = lambda x: F.when(p + c > 0, F.round(x / (p + c) * 100)).otherwise(0).cast("long")
    return (totals.withColumn("cost", F.round(p / 1e6 * prompt_price + c / 1e6 * completion_price, 4))
            .withColumn("prompt_pct", share(p)).withColumn("completion_pct", share(c)))
