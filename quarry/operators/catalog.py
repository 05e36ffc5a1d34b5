"""Document, chunk and conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import group_path
from quarry.operators.ranking import top_k


def with_group(df: DataFrame) -> DataFrame:
    """Normalised group, parent_group and child_group columns."""
    g = group_path(*[F.col(c) if c in df.columns else F.lit("") for c in ("group", "parent_group", "child_group")])
    df = df.withColumn("_g", g)
    return (df.withColumn("group", F.col("_g.path")).withColumn("parent_group", F.col("_g.parent"))
            .withColumn("child_group", F.col("_g.child")).drop("_g"))


def document_listing(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with group path and chunk count, newest first."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return (with_group(documents).join(counts, "document_id", "left")
            .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
            .orderBy(F.col("created_at").desc(), "document_id"))


def group_tree(documents: DataFrame) -> DataFrame:
    """Sorted children per parent group."""
    pairs = with_group(documents).filter("parent_group <> ''").select("parent_group", "child_group").distinct()
    return pairs.groupBy("parent_group").agg(
        F.array_sort(F.collect_list(F.when(F.col("child_group") != "", F.col("child_group")))).alias("children"))


def regroup(table: DataFrame, updates: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows with the new group of their document where one is given.

    ``updates`` has (document_id, new_parent, new_child); apply it to the
    document, chunk and vector tables alike.
    """
    u = updates.select(F.col("document_id").alias(key), "new_parent", "new_child")
    changed = F.col("new_parent").isNotNull()
    joined = table.join(u, key, "left")
    joined = (joined.withColumn("group", F.when(changed, "").otherwise(F.col("group")))
              .withColumn("parent_group", F.coalesce("new_parent", "parent_group"))
              .withColumn("child_group", F.when(changed, F.coalesce("new_child", F.lit(""))).otherwise(
                  F.col("child_group"))))
    return with_group(joined.drop("new_parent", "new_child"))


def delete_rows(table: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not deleted: chunks of a document, messages of a thread."""
    return table.join(deleted.select(key), key, "left_anti")


def clear_provenance(table: DataFrame, deleted: DataFrame, column: str, key: str = "document_id") -> DataFrame:
    """Rows kept, with the reference to a deleted row set to NULL."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    return (table.join(gone, F.col(column) == F.col("_gone"), "left")
            .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone"))


REQUIRED_FIELDS = ("id", "content", "source", "document_id", "entity_name", "normalized_entity_name", "group",
                   "parent_group", "child_group", "chunk_index", "embedding")


def schema_status(df: DataFrame, required=REQUIRED_FIELDS) -> DataFrame:
    """Per required field: present in the schema, filled rows, all rows."""
    have = [c for c in required if c in df.columns]
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in have])
    entries = [F.struct(F.lit(c).alias("field"), F.lit(c in have).alias("present"),
                        (F.col(c) if c in have else F.lit(0)).cast("long").alias("filled")) for c in required]
    rows = counts.select("_rows", F.explode(F.array(*entries)).alias("e"))
    return rows.select("e.field", "e.present", "e.filled", F.col("_rows").alias("rows"),
                       F.lit(len(have) < len(required)).alias("needs_recreate"))


def reindex_rows(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vector-table rows to rebuild, in document and chunk order."""
    d = documents.select("document_id", "filename", "group", "parent_group", "child_group", "created_at")
    return (chunks.join(d, "document_id").withColumnRenamed("filename", "source")
            .orderBy("created_at", "document_id", "chunk_index"))


def reindex_missing(rows: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Rows that have no vector yet (S9 incremental)."""
    return rows.join(vectors.select(key).distinct(), key, "left_anti")


def job_rollup(outcomes: DataFrame, job: str = "job_id", failed: Column | None = None) -> DataFrame:
    """Totals and status per job; partial as soon as one item failed."""
    bad = F.col("status") == "failed" if failed is None else failed
    return outcomes.groupBy(job).agg(
        F.count("*").alias("total"), F.count("*").alias("processed"), F.count_if(~bad).alias("success"),
        F.count_if(bad).alias("failed"),
    ).withColumn("status", F.when(F.col("failed") == 0, "ready").otherwise("partial"))


def conversation_listing(messages: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Message count and first non-empty preview per thread (A10)."""
    filled = F.coalesce(F.col("content") != "", F.lit(False))
    out = messages.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"),
        F.coalesce(F.min_by(F.left("content", F.lit(100)), F.when(filled, F.col("index"))), F.lit("")).alias("preview"))
    if headers is None:
        return out.withColumn("title", F.lit("未命名对话"))
    title = F.when(F.coalesce("title", F.lit("")) == "", "未命名对话").otherwise(F.col("title"))
    return (headers.join(out, "conversation_id", "left").withColumn("title", title)
            .withColumn("message_count", F.coalesce("message_count", F.lit(0)))
            .withColumn("preview", F.coalesce("preview", F.lit("")))
            .orderBy(F.col("updated_at").desc(), "conversation_id"))


def save_conversations(headers: DataFrame, messages: DataFrame, payloads: DataFrame):
    """(headers, messages) after saving whole threads; the latest payload wins.

    ``payloads`` has (conversation_id, title, messages ARRAY<STRUCT<role,
    content>>, saved_at).
    """
    last = payloads.groupBy("conversation_id").agg(
        F.max_by(F.struct("title", "messages"), F.struct("saved_at", "title", "messages")).alias("p"), F.max("saved_at").alias("updated_at"))
    title = F.coalesce("p.title", F.lit("未命名对话"))
    new_headers = last.select("conversation_id", title.alias("title"), "updated_at")
    new_messages = last.select("conversation_id", F.posexplode("p.messages").alias("index", "m")).select(
        "conversation_id", "index", F.coalesce("m.role", F.lit("user")).alias("role"),
        F.coalesce("m.content", F.lit("")).alias("content"))
    keep = lambda df: df.join(last.select("conversation_id"), "conversation_id", "left_anti")
    return (keep(headers).unionByName(new_headers),
            keep(messages.select("conversation_id", "index", "role", "content")).unionByName(new_messages))


def remember(items: DataFrame, new: DataFrame) -> DataFrame:
    """Memory table with new items appended."""
    return items.unionByName(new)


def forget(items: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    return delete_rows(items, ids, key)


def keep_newest(df: DataFrame, n: int, order: str, key: str) -> DataFrame:
    """Newest ``n`` rows of a table."""
    return df.orderBy(F.col(order).desc(), F.col(key).desc()).limit(n)


def cap_traces(traces: DataFrame, max_traces: int = 5000) -> DataFrame:
    """Newest ``max_traces`` traces by start; equal starts go to the larger id."""
    return keep_newest(traces, max_traces, "started_at", "trace_id")


def request_log(traces: DataFrame, spans: DataFrame, n: int = 50, max_spans: int = 20) -> DataFrame:
    """Newest requests with their first spans.

    ``traces`` has (trace_id, started_at, duration_ms, error); ``spans``
    (trace_id, span_no, span_id, operation, duration_ms).
    """
    newest = keep_newest(traces, n, "started_at", "trace_id")
    first = top_k(spans.join(newest.select("trace_id"), "trace_id", "left_semi"), ["trace_id"],
                  [F.col("span_no")], max_spans, "_r")
    packed = first.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(
        "span_no", "span_id", "operation", "duration_ms"))).alias("spans"))
    return newest.join(packed, "trace_id", "left")
