"""Keyed state: conversation memory, trace records, session lists.

State per key is bounded (a window of messages, the last events and steps, the
newest traces; starts of traces until they expire) and expires by processing time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.memory import add_message
from quarry.operators.traces import MAX_EVENTS, MAX_STEPS, STEP_NAMES

DAY_MS = 24 * 3600 * 1000


def _keyed(df: DataFrame, key: str):
    """Grouped by key, on the state store that list state needs."""
    df.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df.groupBy(key)


def _time_mode(ttl_ms: int | None) -> str:
    """Expiry needs processing time, and such a query goes on until it is stopped.

    Without expiry a query can run over what has arrived and end.
    """
    return "None" if ttl_ms is None else "ProcessingTime"


class ConversationMemory(StatefulProcessor):
    """Memory window per conversation; emits the whole window after each batch."""

    def __init__(self, window: int, max_tokens: int, ttl_ms: int | None):
        self.window, self.max_tokens, self.ttl_ms = window, max_tokens, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "role string, content string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory = [(r, c) for r, c in self.messages.get()] if self.messages.exists() else []
        pending = pd.concat(list(rows)).sort_values("index")  # one trigger's rows of one key
        for role, content in zip(pending["role"], pending["content"]):
            memory = add_message(memory, role, content or "", self.window, self.max_tokens)
        self.messages.put(memory)
        yield pd.DataFrame({"conversation_id": key[0], "index": range(len(memory)),
                            "role": [r for r, _ in memory], "content": [c for _, c in memory]})

    def close(self) -> None:
        pass


def memory_stream(messages: DataFrame, window: int = 20, max_tokens: int = 4000, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """``messages``: streaming (conversation_id, index, role, content)."""
    key = messages.schema["conversation_id"].dataType.simpleString()
    rows = messages.select("conversation_id", "index", "role", "content")
    return _keyed(rows, "conversation_id").transformWithStateInPandas(
        ConversationMemory(window, max_tokens, ttl_ms),
        f"conversation_id {key}, index int, role string, content string", "Update", _time_mode(ttl_ms))


TRACE_BUCKETS = 1024  # groups of traces that share one call of the processor in a trigger
RECORD = ("session_id string, started_us long, started_id long, ended_us long, ended_id long, error string, steps_seen long, "
          "event_us array<long>, event_id array<long>, event_name array<string>, "
          "step_us array<long>, step_id array<long>, step_phase array<string>")


class TraceRecord(StatefulProcessor):
    """Running record per trace with its last events and steps.

    A call takes a bucket of traces: the state is a map of their records, each
    read once and written once in a trigger, and the rows of all come in one
    frame.  Every field goes by (time, event), so the order of arrival does not
    matter.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "trace_id string", RECORD, self.ttl_ms)

    def _load(self, trace: str) -> dict:
        known = self.records.getValue((trace,))
        if known is None:
            return {"session": None, "start": None, "end": None, "error": None, "seen": 0, "events": [], "steps": []}
        session, started_us, started_id, ended_us, ended_id, error, seen, *lists = known
        return {"session": session, "start": (started_us, started_id), "end": None if ended_us is None else (ended_us, ended_id),
                "error": error, "seen": seen, "events": list(zip(*lists[:3])), "steps": list(zip(*lists[3:]))}

    def _save(self, trace: str, r: dict) -> None:
        column = lambda rows, i: [row[i] for row in rows]
        self.records.updateValue((trace,), (
            r["session"], *r["start"], *(r["end"] or (None, None)), r["error"], r["seen"],
            *[column(r["events"], i) for i in range(3)], *[column(r["steps"], i) for i in range(3)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        records = {}
        for pdf in rows:
            touched = set()
            for trace, session, event_id, us, name, phase, error in zip(*[pdf[c].tolist() for c in (
                    "trace_id", "session_id", "event_id", "us", "name", "phase", "error")]):
                if trace not in records:
                    records[trace] = self._load(trace)
                r, at = records[trace], (us, event_id)
                touched.add(trace)
                r["events"].append((*at, name))
                if r["start"] is None or at < r["start"]:
                    r["start"], r["session"] = at, session
                if name == "span.end" and (r["end"] is None or at > r["end"]):
                    r["end"], r["error"] = at, error if isinstance(error, str) else None
                if name in STEP_NAMES:
                    r["seen"] += 1
                    r["steps"].append((*at, phase))
            for trace in touched:
                r = records[trace]
                r["events"] = sorted(r["events"], key=lambda e: e[:2])[-MAX_EVENTS:]
                r["steps"] = sorted(r["steps"], key=lambda s: s[:2])[-MAX_STEPS:]
        out = []
        for trace, r in records.items():
            self._save(trace, r)
            end, start = r["end"], r["start"]
            status = "running" if end is None else "failed" if r["error"] else "success"
            out.append((trace, r["session"], status, start[0], None if end is None else (end[0] - start[0]) // 1000,
                        len(r["events"]), len(r["steps"]), r["seen"]))
        names = ["trace_id", "session_id", "status", "started_us", "duration_ms", "n_events", "n_steps", "steps_seen"]
        yield pd.DataFrame(out, columns=names).astype({"duration_ms": "Int64"})

    def close(self) -> None:
        pass


def trace_stream(events: DataFrame, ttl_ms: int | None = DAY_MS, buckets: int = TRACE_BUCKETS) -> DataFrame:
    """``events``: streaming (trace_id, session_id, event_id, us, name, phase, error)."""
    rows = events.select("trace_id", "session_id", "event_id", "us", "name", "phase", "error",
                         F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).alias("bucket"))
    return _keyed(rows, "bucket").transformWithStateInPandas(
        TraceRecord(ttl_ms), "trace_id string, session_id string, status string, started_us long, duration_ms long, "
                             "n_events long, n_steps long, steps_seen long", "Update", _time_mode(ttl_ms))


class SessionTraces(StatefulProcessor):
    """Newest traces per session.

    The start of every trace of the last ``ttl_ms`` stays in the state store,
    so a later event of a trace that fell off the list does not bring it back.
    The list is taken anew from there only when an event moves the start of a
    listed trace back in time.
    """

    def __init__(self, limit: int, ttl_ms: int | None):
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.traces = handle.getListState("traces", "trace_id string, started_us long", self.ttl_ms)
        self.starts = handle.getMapState("starts", "trace_id string", "started_us long", self.ttl_ms)

    def _newest(self, traces) -> list[tuple[str, int]]:
        return heapq.nsmallest(self.limit, traces, key=lambda t: (-t[1], t[0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        listed = {t: us for t, us in self.traces.get()} if self.traces.exists() else {}
        moved = False
        for pdf in rows:
            for trace, us in pdf.groupby("trace_id")["us"].min().items():
                us, name = int(us), (trace,)
                row = self.starts.getValue(name)
                known = None if row is None else row[0]
                if known is not None and known <= us:
                    continue
                self.starts.updateValue(name, (us,))
                moved = moved or trace in listed
                if known is None:
                    listed[trace] = us
            listed = dict(self._newest(listed.items()))
        if moved:
            listed = dict(self._newest((t[0], us[0]) for t, us in self.starts.iterator()))
        newest = self._newest(listed.items())
        self.traces.put(newest)
        yield pd.DataFrame({"session_id": key[0], "trace_id": [t for t, _ in newest],
                            "rank": range(1, len(newest) + 1)})

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, limit: int = 50, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """``events``: streaming (session_id, trace_id, us)."""
    rows = events.filter("session_id is not null").select("session_id", "trace_id", "us")
    return _keyed(rows, "session_id").transformWithStateInPandas(
        SessionTraces(limit, ttl_ms), "session_id string, trace_id string, rank int", "Update", _time_mode(ttl_ms))
