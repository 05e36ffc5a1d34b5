"""Streaming jobs run to completion over the tables, checked against the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import extraction as kg
from quarry.registry.catalog import CATALOG, query, table
from quarry.registry import conversations as conv, graph as g
from quarry.sources import files
from quarry.streaming import jobs, state
from quarry.streaming.log import BatchLog, arrivals


def sql_of(name: str) -> str:
    return CATALOG.get(name).sql


SLICES = 3


def table_stream(spark, sf, name, slice_no=None):
    """A whole table that arrives in three slices, in mixed order unless a slice number says otherwise."""
    df = table(spark, sf, name)
    mixed = F.pmod(F.xxhash64(F.col(df.columns[0])), F.lit(SLICES))
    return arrivals(df, mixed if slice_no is None else slice_no, SLICES)


class StreamTables:
    """Reads the registered queries' inputs as streams instead of tables."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    def messages(self):
        # Messages of a conversation arrive in their order.
        by_turn = F.coalesce(F.greatest(F.lit(0), F.least(F.col("turn") / 2, F.lit(SLICES - 1))).cast("int"), F.lit(0))
        return table_stream(self.spark, self.sf, "conversations", by_turn).select(
            F.col("conv_id").alias("conversation_id"), F.col("turn").alias("index"), "role", F.col("text").alias("content"))

    def events(self):
        e = table_stream(self.spark, self.sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        e = conv.as_trace_events(e)
        return e.withColumn("us", F.unix_micros("ts"))


@query("T1", sql_of("memory_window"))
def stream_memory(spark, sf):
    """Conversation memory as keyed state."""
    log = BatchLog(spark, "stream-memory")
    log.run(state.memory_stream(StreamTables(spark, sf).messages(), 4, 300, ttl_ms=None), "update")
    return log.latest(["conversation_id"])


@query("T2", f"""SELECT trace_id, session_id, status, started_us, duration_ms, n_events, n_steps FROM ({sql_of('trace_records')})""")
def stream_traces(spark, sf):
    """Trace records as keyed state."""
    log = BatchLog(spark, "stream-traces")
    log.run(state.trace_stream(StreamTables(spark, sf).events(), ttl_ms=None), "update")
    return log.latest(["trace_id"]).drop("steps_seen")


@query("T3", sql_of("session_traces"))
def stream_sessions(spark, sf):
    """Ten newest traces per session as keyed state."""
    log = BatchLog(spark, "stream-sessions")
    log.run(state.session_stream(StreamTables(spark, sf).events(), 10, ttl_ms=None), "update")
    return log.latest(["session_id"])


@query("T4", sql_of("usage_cost"))
def stream_usage(spark, sf):
    """Running usage totals."""
    return jobs.usage_counters(conv.usage_rows(StreamTables(spark, sf).messages()), BatchLog(spark, "stream-usage"))


@query("T5 U3", f"""SELECT id, document_id::BIGINT AS document_id, chunk_index, content FROM ({sql_of('ingest_chunks')})""")
def stream_ingest(spark, sf):
    """Arriving documents parsed and chunked."""
    docs = table_stream(spark, sf, "documents")
    html = F.col("lang") == "fr"
    raw = docs.select(F.col("doc_id").alias("document_id"), F.col("text").cast("binary").alias("data"),
                      F.concat(F.lit("note_"), F.col("doc_id").cast("string"), F.when(html, ".html").otherwise(".TXT")).alias("filename"),
                      F.when(html, "text/html").alias("mime"))
    rows, outcome = BatchLog(spark, "stream-chunks"), BatchLog(spark, "stream-outcomes")
    jobs.ingest_stream(files.parse_documents(raw), rows, outcome, "fixed")
    return rows.read().select("id", "document_id", "chunk_index", "content")


@query("T6 A3", f"""SELECT id, type, normalized_name, name, source_document_id FROM ({sql_of('kg_entities')})""")
def stream_entities(spark, sf):
    """Entity table of arriving part documents."""
    docs = g.as_documents(table_stream(spark, sf, "part"))
    out = jobs.entity_upserts(docs, kg.mapping_table(spark), jobs.entity_log(spark, "stream-entities"))
    return out.select("id", "type", "normalized_name", "name", "source_document_id")


@query("T7 F5", r"""WITH k AS (SELECT regexp_replace(lower(regexp_replace(event_type || ' ' || user_id, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS q, event_id, ts, value FROM events),
l AS (SELECT q, last(value ORDER BY ts, event_id) AS value, max(ts) AS ts FROM k GROUP BY 1)
SELECT q AS query_key, value, epoch_us(ts) AS written_us FROM l WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-30'""")
def stream_cache(spark, sf):
    """Cache entries keyed by event type and user, valid for ten days."""
    e = table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    entries = e.select(F.concat(F.lit("  "), F.upper("event_type"), F.lit("   "), F.col("user_id").cast("string")).alias("query_text"),
                       "value", F.col("ts").alias("written_at"))
    out = jobs.cache_inserts(entries, BatchLog(spark, "stream-cache"), 10 * 86400, F.lit("2024-01-30").cast("timestamp"))
    from quarry.functions.text import normalize_text

    return out.select(normalize_text(F.col("query_text")).alias("query_key"), "value",
                      F.unix_micros("written_at").alias("written_us"))


@query("T8", """SELECT conv_id AS conversation_id, 0 AS index, role, 'saved ' || text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def stream_conversations(spark, sf):
    """Every message saves its thread anew; the last save stays."""
    payloads = StreamTables(spark, sf).messages().select(
        "conversation_id", F.lit("t").alias("title"),
        F.array(F.struct("role", F.concat(F.lit("saved "), "content").alias("content"))).alias("messages"),
        F.col("index").alias("saved_at"))
    m = conv.messages(spark, sf)
    headers = m.select("conversation_id").distinct().select("conversation_id", F.lit("x").alias("title"), F.lit(0).cast("long").alias("updated_at"))
    _, saved = jobs.conversation_saves(payloads, BatchLog(spark, "stream-saves"), headers, m.withColumn("index", F.col("index").cast("int")))
    return saved
