"""Streaming jobs on a batch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize_text
from quarry.operators import extraction as kg
from quarry.operators.catalog import save_conversations
from quarry.operators.traces import with_cost
from quarry.session import cut_lineage
from quarry.sources import files
from quarry.streaming.log import BatchLog, MergedLog


def usage_counters(usage: DataFrame, log: BatchLog) -> DataFrame:
    """Running totals of requests and tokens (T4)."""
    totals = usage.groupBy().agg(
        F.count("*").alias("requests"), *[F.sum(c).cast("long").alias(c)
                                          for c in ("total_tokens", "prompt_tokens", "completion_tokens")])
    log.run(totals, "complete")
    rows = log.read()
    return with_cost(rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch"))


def ingest_stream(documents: DataFrame, chunk_log: BatchLog, outcome_log: BatchLog, strategy: str = "recursive",
                  size: int = 512, overlap: int = 64) -> None:
    """Chunk arriving parsed documents; one outcome row per document (T5)."""

    def both(df: DataFrame, batch_id: int) -> None:
        rows, outcome = files.ingest(df, strategy, size, overlap)
        chunk_log.write(rows, batch_id)
        outcome_log.write(outcome, batch_id)

    query = (documents.writeStream.option("checkpointLocation", chunk_log.checkpoint)
             .foreachBatch(both).trigger(availableNow=True).start())
    query.awaitTermination()


def entity_upserts(documents: DataFrame, mapping: DataFrame, log: BatchLog) -> DataFrame:
    """Entity table of arriving documents.

    Each batch appends its node rows; reading merges them by (type, name) in
    document order, whatever the order of arrival.  With :func:`entity_log` the
    log itself keeps few folders of condensed rows.  A batch's fields and facts
    are written before they are read several times.
    """
    def nodes(df: DataFrame) -> DataFrame:
        rows = cut_lineage(kg.field_rows(df, "document_id", "text", "filename"), "fields")
        found = kg.document_nodes(rows, cut_lineage(kg.extract_facts(rows, mapping), "facts"))
        found = found.join(df.select("document_id", "created_at"), "document_id")
        return found.withColumn("source_document_id", F.col("document_id"))

    log.run(documents, prepare=nodes)
    return kg.upsert_entities(log.read(), ["created_at", "document_id"])


def entity_log(spark, purpose: str, path: str | None = None) -> MergedLog:
    """A log for :func:`entity_upserts` that condenses node rows as batches arrive."""
    return MergedLog(spark, purpose, lambda rows: kg.condense_nodes(rows, ["created_at", "document_id"]), path)


def cache_inserts(entries: DataFrame, log: BatchLog, ttl_seconds: int, as_of: Column | None = None) -> DataFrame:
    """Live cache entries, the last one per normalised query.

    ``entries``: streaming (query_text, value, written_at).
    """
    key = F.sha2(normalize_text(F.col("query_text")), 256)
    keyed = entries.withColumn("key", key).withColumn(
        "expires_at", F.col("written_at") + F.make_interval(secs=F.lit(ttl_seconds)))
    log.run(keyed)
    last = log.read().groupBy("key").agg(F.max_by(
        F.struct("query_text", "value", "written_at", "expires_at"), F.struct("written_at", "query_text", "value")).alias("e")).select("key", "e.*")
    return last.filter(F.col("expires_at") > as_of) if as_of is not None else last


def conversation_saves(payloads: DataFrame, log: BatchLog, headers: DataFrame, messages: DataFrame):
    """Threads after all arrived saves."""
    log.run(payloads)
    return save_conversations(headers, messages, log.read().drop("batch"))
