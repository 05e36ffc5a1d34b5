"""Retrieval and answer scores: verdict columns in, metrics out (E, A5-A9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.rows import unnest
from quarry.functions.text import blank
from quarry.functions.vectors import cosine
from quarry.operators.ordered import exact_median, running_sum

CUTS = (1, 3, 5)


# --- one case per row -----------------------------------------------------------------

def recall_at(relevant: Column, retrieved: Column, k: int) -> Column:
    """Hits among the first k over min(k, distinct relevant)."""
    hits = F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(relevant, x)))
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, hits / F.least(F.lit(k), n)).otherwise(F.lit(0.0))


def reciprocal_rank(relevant: Column, retrieved: Column) -> Column:
    """1 / position of the first relevant id, else 0."""
    marks = F.transform(retrieved, lambda x: F.array_contains(relevant, x))
    at = F.array_position(marks, True)
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def answer_correctness(tp: Column, fp: Column) -> Column:
    """2tp(1-fp)/(tp+1-fp) on clamped inputs; unparsed input scores 0.5."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    t, f = clamp(tp), clamp(fp)
    score = (F.when(t + f == 0, 0.0).when(t + (1 - f) > 0, 2 * t * (1 - f) / (t + (1 - f))).otherwise(0.0))
    return F.when(tp.isNull() | fp.isNull(), F.lit(0.5)).otherwise(score)


# --- long tables ----------------------------------------------------------------------

def retrieval_case_scores(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """recall_at_1/3/5 and mrr per query that retrieved anything.

    ``hits`` has (query_id, id, rank), ``relevant`` (query_id, id).
    """
    truth = relevant.select("query_id", "id").distinct()
    n_rel = truth.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = hits.select("query_id", "id", "rank").join(truth.withColumn("rel", F.lit(1)), ["query_id", "id"], "left")
    per = marked.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, F.coalesce("rel", F.lit(0))).otherwise(0)).alias(f"h{k}") for k in CUTS],
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    per = per.join(n_rel, "query_id", "left")
    recall = lambda k: F.when(F.col("n_rel") > 0, F.col(f"h{k}") / F.least(F.lit(k), F.col("n_rel"))).otherwise(0.0)
    return per.select("query_id", *[recall(k).alias(f"recall_at_{k}") for k in CUTS],
                      F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def retrieval_means(case_scores: DataFrame) -> DataFrame:
    """Mean recall and reciprocal rank; zeros without cases."""
    names = [*(f"recall_at_{k}" for k in CUTS), "mrr"]
    return case_scores.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names],
                           F.count("*").alias("cases"))


def context_precision(verdicts: DataFrame) -> DataFrame:
    """Precision at k weighted by rel/k, per query.

    ``verdicts`` has (query_id, rank, relevant) with ranks 1..n.
    """
    rel = F.col("relevant").cast("int")
    run = running_sum(verdicts.select("query_id", "rank", rel.alias("relevant")), ["query_id"], "rank",
                      F.col("relevant"), "seen")
    weight = F.col("relevant") / F.col("rank")
    return run.groupBy("query_id").agg(
        F.coalesce(F.sum(F.col("seen") / F.col("rank") * weight) / F.nullif(F.sum(weight), F.lit(0.0)),
                   F.lit(0.0)).alias("value"))


def share_true(verdicts: DataFrame, flag: str) -> DataFrame:
    """Share of positive verdicts per query: context recall (E4), faithfulness (E5)."""
    return verdicts.groupBy("query_id").agg(F.avg(F.col(flag).cast("double")).alias("value"))


def answer_relevancy(query_vectors: DataFrame, question_vectors: DataFrame,
                     direct: DataFrame | None = None) -> DataFrame:
    """Mean of max(0, cosine) of query and generated questions.

    Cases without question vectors use the ``direct`` score when given.
    """
    q = query_vectors.select("query_id", F.col("vec").alias("qv"))
    sims = q.join(question_vectors.select("query_id", F.col("vec").alias("gv")), "query_id").groupBy("query_id").agg(
        F.avg(F.greatest(F.lit(0.0), cosine(F.col("qv"), F.col("gv")))).alias("value"))
    if direct is None:
        return sims
    return (sims.join(direct.select("query_id", F.col("value").alias("direct")), "query_id", "full")
            .select("query_id", F.coalesce("value", "direct").alias("value")))


def _named(df: DataFrame, metric: str) -> DataFrame:
    return df.select("query_id", F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"))


def case_metrics(mode: str, cases: DataFrame, relevance: DataFrame, coverage: DataFrame, claims: DataFrame,
                 relevancy: DataFrame, correctness: DataFrame) -> DataFrame:
    """Long (query_id, metric, value) table for one mode.

    ``mode`` is ``retrieval_only``, ``generation_only`` or ``full``.  ``cases``
    has (query_id, answer, ground_truth_answer, n_contexts, error).  A case
    whose retrieval failed has no metrics; metrics whose inputs are missing
    are left out.
    """
    live = cases.filter(blank(F.col("error"))) if mode != "generation_only" else cases
    with_context = live.filter("n_contexts > 0").select("query_id")
    answered = live.filter(~blank(F.col("answer"))).select("query_id")
    graded = live.filter(~blank(F.col("answer")) & ~blank(F.col("ground_truth_answer"))).select("query_id")
    parts = []
    if mode in ("retrieval_only", "full"):
        precision = live.select("query_id").join(context_precision(relevance), "query_id", "left").select(
            "query_id", F.coalesce("value", F.lit(0.0)).alias("value"))
        parts.append(_named(precision, "context_precision"))
        parts.append(_named(share_true(coverage, "covered").join(with_context, "query_id", "left_semi"),
                            "context_recall"))
    if mode in ("generation_only", "full"):
        faithful = answered.join(with_context, "query_id", "left_semi").join(
            share_true(claims, "supported"), "query_id", "left").select(
            "query_id", F.coalesce("value", F.lit(0.0)).alias("value"))
        parts.append(_named(faithful, "faithfulness"))
        parts.append(_named(relevancy.join(answered, "query_id", "left_semi"), "answer_relevancy"))
        right = correctness.select("query_id", answer_correctness(F.col("tp"), F.col("fp")).alias("value"))
        parts.append(_named(right.join(graded, "query_id", "left_semi"), "answer_correctness"))
    if not parts:
        raise ValueError(f"unknown mode {mode}")
    return reduce(DataFrame.unionByName, parts)


def metric_summary(metrics: DataFrame) -> DataFrame:
    """mean, median, std, min, max and count per metric, 6 digits (A5)."""
    stats = metrics.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("value").alias("available"))
    stats = stats.join(exact_median(metrics, ["metric"], "value"), "metric")
    return stats.select("metric", *[F.bround(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")],
                        "available")


def with_retrieval_means(summary: DataFrame, means: DataFrame, n_cases: Column) -> DataFrame:
    """Summary rows plus one row per retrieval mean (std 0, all cases)."""
    names = [*(f"recall_at_{k}" for k in CUTS), "mrr"]
    rows = means.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("r"))
    return summary.unionByName(rows.select(
        F.col("r.metric").alias("metric"), F.col("r.v").alias("mean"), F.col("r.v").alias("median"),
        F.lit(0.0).alias("std"), F.col("r.v").alias("min"), F.col("r.v").alias("max"), n_cases.alias("available")))


def overall_score(summary: DataFrame) -> DataFrame:
    """Mean of the metric means."""
    return summary.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("overall_score"))


def error_count(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_if(~blank(F.col("error"))).alias("error_count"))


def latency_summary(cases: DataFrame) -> DataFrame:
    """Average, maximum and minimum of the positive latencies."""
    return cases.filter("latency_ms > 0").agg(
        F.avg("latency_ms").alias("avg_ms"), F.max("latency_ms").alias("max_ms"), F.min("latency_ms").alias("min_ms"))


def score_histogram(metrics: DataFrame, bins: int = 5) -> DataFrame:
    """Cases per equal bin of [0, 1]; 1 and above count in the last bin."""
    v = F.col("value")
    near = F.floor(v * bins)
    exact = F.when(v < near / bins, near - 1).when(v >= (near + 1) / bins, near + 1).otherwise(near)
    counted = (metrics.filter(v >= 0).select("metric", F.least(exact, F.lit(bins - 1)).cast("int").alias("bin"))
               .groupBy("metric", "bin").agg(F.count("*").alias("n")))
    grid = metrics.select("metric").distinct().select(
        "metric", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, ["metric", "bin"], "left").select(
        "metric", "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def legacy_scores(case_scores: DataFrame, claims: DataFrame, cases: DataFrame) -> DataFrame:
    """Retrieval means plus mean faithfulness over answered cases."""
    live = cases.filter(~blank(F.col("answer")) & (F.col("n_contexts") > 0)).select("query_id")
    faith = live.join(share_true(claims, "supported"), "query_id", "left").agg(
        F.coalesce(F.avg(F.coalesce("value", F.lit(0.0))), F.lit(0.0)).alias("f"))
    return retrieval_means(case_scores).withColumn("faithfulness", faith.select("f").scalar())


def testset_flags(cases: DataFrame) -> DataFrame:
    """Whether any case has an answer, and any has relevant ids."""
    return cases.agg(
        F.coalesce(F.bool_or(F.length("ground_truth_answer") > 0), F.lit(False)).alias("has_answer"),
        F.coalesce(F.bool_or(F.size("relevant_ids") > 0), F.lit(False)).alias("has_relevant_ids"))


def cases_from_answers(answers: DataFrame, id_col: str, raw_col: str, per_chunk: int = 2) -> DataFrame:
    """Evaluation cases from model answers, at most ``per_chunk`` each."""
    from quarry.functions.parsing import json_field, json_items, json_object
    from quarry.functions.text import strip

    # The cut comes before blank questions are dropped.
    pairs = F.slice(json_items(json_object(F.col(raw_col)), "qa_pairs"), 1, per_chunk)
    rows = unnest(answers, pairs, "item", "pos", [F.col(id_col).cast("string").alias("chunk_id")])
    field = lambda n: strip(F.coalesce(json_field(F.col("item"), n), F.lit("")))
    facts = F.coalesce(F.from_json(json_field(F.col("item"), "key_facts"), "array<string>"),
                       F.array().cast("array<string>"))
    return rows.select(
        "chunk_id", "pos", field("question").alias("query"), field("answer").alias("ground_truth_answer"),
        F.array("chunk_id").alias("relevant_ids"), facts.alias("key_facts"),
        F.create_map(F.lit("source_chunk_id"), F.col("chunk_id"),
                     F.lit("generation_method"), F.lit("llm_auto")).alias("metadata")).filter("query <> ''")
