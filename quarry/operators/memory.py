"""Conversation memory in batch (T1, W10, W11, V2 recall)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.dense import keyed_topk
from quarry.operators.ranking import ordered_texts, rank_all, top_k

SUMMARY_HEAD = "[历史摘要]\n"  # fixed value
SUMMARY_CHARS = 2000  # fixed value


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def add_message(messages: list[tuple[str, str]], role: str, content: str, window: int,
                max_tokens: int) -> list[tuple[str, str]]:
    """Memory after one more message; older ones fold into a summary."""
    messages = [*messages, (role, content)]
    crowded = len(messages) > window or sum(tokens(c) for _, c in messages) > max_tokens
    if not crowded or len(messages) < 2:
        return messages
    keep = min(max(2, window // 2), len(messages) - 1)
    summary = "\n".join(f"{r}: {c}" for r, c in messages[:-keep])[:SUMMARY_CHARS]
    return [("system", SUMMARY_HEAD + summary), *messages[-keep:]]


def memory_window(messages: DataFrame, window: int = 20, max_tokens: int = 4000) -> DataFrame:
    """Memory of every conversation after its last message.

    ``messages`` has (conversation_id, index, role, content).  The memory after
    a message depends on the memory before it, so a conversation is folded in
    order; rows stream through and only the bounded memory is held, however
    long a conversation is.
    """
    rows = (messages.select("conversation_id", "index", "role", "content")
            .repartition("conversation_id").sortWithinPartitions("conversation_id", "index"))
    key_type = messages.schema["conversation_id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []

        def rows_of(key, state):
            return [(key, i, r, c) for i, (r, c) in enumerate(state)]

        for pdf in batches:
            out = []
            for key, role, content in zip(pdf["conversation_id"], pdf["role"], pdf["content"]):
                if key != current:
                    out.extend(rows_of(current, state))
                    current, state = key, []
                state = add_message(state, role, content or "", window, max_tokens)
            yield pd.DataFrame(out, columns=["conversation_id", "index", "role", "content"])
        yield pd.DataFrame(rows_of(current, state), columns=["conversation_id", "index", "role", "content"])

    return rows.mapInPandas(fold, f"conversation_id {key_type}, index int, role string, content string")


def recent_turns(messages: DataFrame, queries: DataFrame, n: int = 8) -> DataFrame:
    """Printed last turns per conversation, without the query itself.

    ``queries`` has (conversation_id, query).  Threads with at most one user
    message have no history to print.
    """
    users = messages.filter("role = 'user'").groupBy("conversation_id").agg(F.count("*").alias("_u")).filter("_u > 1")
    last = top_k(messages, ["conversation_id"], [F.col("index").desc()], n, "_r")
    last = last.join(queries, "conversation_id").join(users, "conversation_id", "left_semi")
    last = last.filter(~((F.col("role") == "user") & (F.col("content") == F.col("query"))))
    label = F.when(F.col("role") == "user", "用户").otherwise("助手")
    return last.groupBy("conversation_id").agg(F.array_join(ordered_texts(
        F.col("index"), F.concat(label, F.lit("："), "content")), "\n").alias("history"))


def snippets(short_term: DataFrame, long_term: DataFrame, limit: int = 8, max_chars: int = 200) -> DataFrame:
    """Short-term then long-term texts per session, cut, first ``limit``.

    Both inputs have (session_id, position, content).
    """
    side = lambda df, n: df.select("session_id", F.lit(n).alias("source"), F.col("position").cast("long").alias("position"),
                                   F.left("content", F.lit(max_chars)).alias("snippet"))
    both = side(short_term, 0).unionByName(side(long_term, 1))
    return top_k(both, ["session_id"], [F.col("source"), F.col("position"), F.col("snippet")], limit)


def recall(items: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Nearest memory items of the same session by squared distance (V2).

    ``items`` has (memory_id, session_id, vector), ``queries`` (query_id,
    session_id, vec).
    """
    return keyed_topk(items, queries, "session_id", k, "l2", "memory_id", "vector", "query_id", "vec")


def indexed(messages: DataFrame, order: list[str]) -> DataFrame:
    """Messages with their position in the conversation."""
    return rank_all(messages, ["conversation_id"], [F.col(c) for c in order], "index").withColumn(
        "index", F.col("index") - 1)
