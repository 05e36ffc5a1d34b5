"""Printed context blocks and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.parsing import citation_numbers
from quarry.functions.rows import unnest
from quarry.operators.ranking import ordered_texts


def block_text(style: str = "chat", max_chars: int | None = None, max_hits: int | None = None) -> Column:
    """Aggregate of a group of hits (rank, id, score, content) as one printed block.

    Styles: ``chat`` (500 characters), ``tool`` (score and 300 characters),
    ``eval`` (first five, 300 characters), ``prompt`` (id and full text).
    """
    most = {"chat": 500, "tool": 300, "eval": 300}.get(style) if max_chars is None else max_chars
    hits = 5 if style == "eval" and max_hits is None else max_hits
    n = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"))
    content = F.col("content") if most is None else F.left("content", F.lit(most))
    if style == "chat":
        line, sep = F.concat(n, F.lit(" "), content), "\n\n"
    elif style == "tool":
        line, sep = F.concat(n, F.format_string(" (相关度=%.2f)\n", F.col("score")), content), "\n\n"
    elif style == "eval":
        line, sep = content, "\n"
    else:
        line, sep = F.concat(n, F.lit(" (id="), F.col("id").cast("string"), F.lit(")\n"), content), "\n\n"
    # Joining leaves nulls out.
    line = line if hits is None else F.when(F.col("rank") <= hits, line)
    return F.array_join(ordered_texts(F.col("rank"), line), sep)


def context_blocks(hits: DataFrame, *styles: str) -> DataFrame:
    """One block column per style for each query, in one pass over its top-k hits."""
    return hits.groupBy("query_id").agg(*[block_text(s).alias(s) for s in styles])


def history_block(turns: DataFrame) -> DataFrame:
    """``role: content`` lines per conversation window."""
    return turns.groupBy("conversation_id").agg(F.array_join(ordered_texts(
        F.col("index"), F.concat("role", F.lit(": "), "content")), "\n").alias("block"))


def citations(answers: DataFrame, hits: DataFrame, max_chars: int = 200) -> DataFrame:
    """Contexts cited by ``[n]`` in each answer, in first-mention order.

    ``answers`` has (query_id, answer), ``hits`` (query_id, rank, id, content).
    """
    marks = unnest(answers, citation_numbers(F.col("answer")), "rank", "pos", ["query_id"])
    cut = F.concat(F.left("content", F.lit(max_chars)),
                   F.when(F.length("content") > max_chars, "...").otherwise(""))
    found = marks.join(hits.select("query_id", "rank", "id", cut.alias("snippet")), ["query_id", "rank"])
    return found.select("query_id", "pos", F.col("rank").alias("index"), "id", "snippet")
