"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import score_band
from quarry.operators import dense, evaluation as ev
from quarry.operators.ranking import extreme_cases
from quarry.registry.catalog import query, table
from quarry.registry.search import COSINE_SQL, label_centroids, top_sql

HITS_SQL = f"""{COSINE_SQL}, hits AS ({top_sql('cos', 10)}),
    marked AS (SELECT hits.*, (label = query_id)::INT AS rel FROM hits JOIN c USING (id)),
    n_rel AS (SELECT label AS query_id, count(*) AS n FROM embeddings GROUP BY 1),
    per AS (SELECT query_id, n,
      sum(rel) FILTER (rank <= 1) / least(1, n) AS r1, sum(rel) FILTER (rank <= 3) / least(3, n) AS r3,
      sum(rel) FILTER (rank <= 5) / least(5, n) AS r5,
      coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS mrr FROM marked JOIN n_rel USING (query_id) GROUP BY query_id, n)"""
PRECISION_SQL = """
    run AS (SELECT query_id, rank, rel, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM marked),
    cp AS (SELECT query_id, coalesce(sum(p * rel / rank) / nullif(sum(rel / rank), 0), 0)::DOUBLE AS value FROM run GROUP BY 1)"""


def label_hits(spark, sf, k=10):
    """Hits of every label centroid, and the relevant ids (same label)."""
    emb = table(spark, sf, "embeddings")
    hits = dense.dense_topk(emb, label_centroids(emb), k)
    relevant = emb.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"))
    return hits, relevant


@query("E1 E2 A6 O4", f"""WITH {HITS_SQL} SELECT round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3,
round(avg(r5), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr, count(*) AS cases FROM per""")
def retrieval_metrics(spark, sf):
    """Mean recall and reciprocal rank of label retrieval."""
    means = ev.retrieval_means(ev.retrieval_case_scores(*label_hits(spark, sf)))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns if c != "cases"], "cases")


def _verdicts(hits, relevant):
    truth = relevant.withColumn("relevant", F.lit(1))
    return hits.join(truth, ["query_id", "id"], "left").select(
        "query_id", "rank", F.coalesce("relevant", F.lit(0)).alias("relevant"))


@query("E3 W2", f"WITH {HITS_SQL}, {PRECISION_SQL} SELECT query_id, round(value, 6) AS value FROM cp")
def context_precision(spark, sf):
    """Weighted precision of the ten contexts per label."""
    return ev.context_precision(_verdicts(*label_hits(spark, sf))).withColumn("value", F.round("value", 6))


EVENT_SCORES_SQL = "SELECT event_id AS query_id, event_type AS metric, value / 250 AS value FROM events"


def event_scores(spark, sf):
    """Events as scored cases: the event type is the metric."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"), F.col("event_type").alias("metric"), (F.col("value") / 250).alias("value"))


@query("A5", f"""WITH m AS ({EVENT_SCORES_SQL}) SELECT metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS available FROM m GROUP BY metric""")
def metric_summary(spark, sf):
    """Summary of the event scores per type."""
    return ev.metric_summary(event_scores(spark, sf))


@query("A7", f"""WITH m AS ({EVENT_SCORES_SQL}), b AS (SELECT DISTINCT metric, bin FROM m, range(20) r(bin))
SELECT b.metric, b.bin::INT AS bin, bin / 20 AS low, (bin + 1) / 20 AS high, count(value) AS n
FROM b LEFT JOIN m ON m.metric = b.metric AND value >= bin / 20 AND (value < (bin + 1) / 20 OR bin = 19) GROUP BY ALL""")
def score_histogram(spark, sf):
    """Twenty score bins per event type."""
    return ev.score_histogram(event_scores(spark, sf), 20)


@query("L2", f"""WITH m AS ({EVENT_SCORES_SQL}) SELECT 'worst' AS side, * FROM (SELECT * FROM m WHERE metric = 'click' ORDER BY value, query_id LIMIT 7)
UNION ALL SELECT 'best', * FROM (SELECT * FROM m WHERE metric = 'click' ORDER BY value DESC, query_id LIMIT 7)""")
def worst_cases(spark, sf):
    """Seven worst and best click events."""
    m = event_scores(spark, sf)
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "*")
    return tag(extreme_cases(m, "click", 7), "worst").unionByName(tag(extreme_cases(m, "click", 7, best=True), "best"))


@query("A8 A6 A5", f"""WITH {HITS_SQL}, m AS ({EVENT_SCORES_SQL}),
s AS (SELECT avg(value) AS mean FROM m GROUP BY metric UNION ALL
      SELECT unnest([avg(r1), avg(r3), avg(r5), avg(mrr)]) FROM per)
SELECT round(avg(mean), 5) AS overall_score, (SELECT count(*) FROM events WHERE event_type = 'error') AS error_count FROM s""")
def overall_score(spark, sf):
    """Mean of metric means with the retrieval means included, and the error count."""
    scores = event_scores(spark, sf)
    means = ev.retrieval_means(ev.retrieval_case_scores(*label_hits(spark, sf)))
    summary = ev.with_retrieval_means(ev.metric_summary(scores), means, F.lit(0).cast("long"))
    errors = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return ev.overall_score(summary).select(
        F.round("overall_score", 5).alias("overall_score"),
        ev.error_count(errors).scalar().alias("error_count"))


@query("E4 E5 E7", """WITH v AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)),
g AS (SELECT source, avg(1 - toxic) AS rec, avg(quality) AS tp, avg(toxic) AS fp FROM v GROUP BY 1)
SELECT source AS query_id, round(rec, 6) AS context_recall, round(tp, 6) AS faithfulness,
CASE WHEN tp + fp = 0 THEN 0.0 WHEN tp + 1 - fp > 0 THEN round(2 * tp * (1 - fp) / (tp + 1 - fp), 6) ELSE 0.0 END AS answer_correctness FROM g""")
def answer_scores(spark, sf):
    """Answer scores per source from its quality and toxicity verdicts."""
    v = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    v = v.select(F.col("source").alias("query_id"), "quality", "toxic", (1 - F.col("toxic")).alias("covered"))
    rates = v.groupBy("query_id").agg(F.avg("quality").alias("tp"), F.avg("toxic").alias("fp"))
    right = rates.select("query_id", F.round(ev.answer_correctness(F.col("tp"), F.col("fp")), 6).alias("answer_correctness"))
    name = lambda df, n: df.select("query_id", F.round("value", 6).alias(n))
    return (name(ev.share_true(v, "covered"), "context_recall")
            .join(name(ev.share_true(v, "quality"), "faithfulness"), "query_id").join(right, "query_id"))


# Cases = the ten labels; documents and events fall to the case of their id's last digit.
CASES_SQL = f"""{HITS_SQL}, {PRECISION_SQL},
    v AS (SELECT doc_id % 10 AS query_id, avg(1 - toxic) AS rec, avg(quality) AS tp, avg(toxic) AS fp FROM labels GROUP BY 1),
    e AS (SELECT user_id % 10 AS query_id, avg(value) AS latency_ms, max(value) FILTER (event_type = 'error') AS worst FROM events GROUP BY 1),
    lim AS (SELECT avg(worst) AS mean_worst FROM e),
    cases AS (SELECT query_id, latency_ms, worst > mean_worst * 1.2 AS failed FROM e, lim),
    rel AS (SELECT q.query_id, avg(greatest(0, list_cosine_similarity(q.vec, c.vec))) AS value
            FROM q JOIN c ON c.label = q.query_id GROUP BY 1),
    ret AS (SELECT query_id, 'context_precision' AS metric, value FROM cp UNION ALL SELECT query_id, 'context_recall', rec FROM v),
    gen AS (SELECT query_id, 'faithfulness' AS metric, tp AS value FROM v UNION ALL SELECT query_id, 'answer_relevancy', value FROM rel
            UNION ALL SELECT query_id, 'answer_correctness',
              CASE WHEN tp + fp = 0 THEN 0.0 WHEN tp + 1 - fp > 0 THEN 2 * tp * (1 - fp) / (tp + 1 - fp) ELSE 0.0 END FROM v),
    modes AS (SELECT 'retrieval_only' AS mode, ret.* FROM ret JOIN cases USING (query_id) WHERE NOT failed
      UNION ALL SELECT 'generation_only', gen.* FROM gen
      UNION ALL SELECT 'full', u.* FROM (SELECT * FROM ret UNION ALL SELECT * FROM gen) u JOIN cases USING (query_id) WHERE NOT failed)"""


def label_cases(spark, sf):
    """Inputs of a case evaluation: cases, hits, and the five verdict tables."""
    emb, labels, events = (table(spark, sf, t) for t in ("embeddings", "labels", "events"))
    queries = label_centroids(emb)
    hits, relevant = label_hits(spark, sf)
    v = labels.select((F.col("doc_id") % 10).alias("query_id"), F.col("quality").alias("supported"),
                      (1 - F.col("toxic")).alias("covered"), "quality", "toxic")
    e = events.groupBy((F.col("user_id") % 10).alias("query_id")).agg(
        F.avg("value").alias("latency_ms"),
        F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("worst"))
    mean_worst = e.agg(F.avg("worst")).scalar()
    contexts = hits.groupBy("query_id").agg(F.count("*").alias("n_contexts"))
    cases = e.join(contexts, "query_id").select(
        "query_id", "latency_ms", "n_contexts", F.lit("an answer").alias("answer"),
        F.lit("the truth").alias("ground_truth_answer"),
        F.when(F.col("worst") > mean_worst * 1.2, "slow store").alias("error"))
    relevancy = ev.answer_relevancy(queries, emb.select(F.col("label").alias("query_id"), F.col("embedding").alias("vec")))
    correctness = v.groupBy("query_id").agg(F.avg("quality").alias("tp"), F.avg("toxic").alias("fp"))
    return cases, hits, relevant, (_verdicts(hits, relevant), v, v, relevancy, correctness)


@query("E8 E9 E6", f"WITH {CASES_SQL} SELECT mode, query_id::BIGINT AS query_id, metric, round(value, 6) AS value FROM modes")
def eval_modes(spark, sf):
    """Per-case metrics of the three evaluation modes."""
    cases, _, _, inputs = label_cases(spark, sf)
    parts = [ev.case_metrics(m, cases, *inputs).select(F.lit(m).alias("mode"), "query_id", "metric",
                                                       F.round("value", 6).alias("value"))
             for m in ("retrieval_only", "generation_only", "full")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("query_id", F.col("query_id").cast("long"))


@query("E8 E10 A5 A9 F23", f"""WITH {CASES_SQL}, m AS (SELECT * FROM modes WHERE mode = 'full'),
s AS (SELECT metric, avg(value) AS mean, median(value) AS med, count(*) AS available FROM m GROUP BY 1),
lat AS (SELECT avg(latency_ms) AS a, max(latency_ms) AS b, min(latency_ms) AS c FROM cases WHERE latency_ms > 0),
legacy AS (SELECT avg(tp) AS f FROM v)
SELECT metric, round(mean, 6) AS mean, round(med, 6) AS median, available,
CASE WHEN mean >= 0.8 THEN 'high' WHEN mean >= 0.5 THEN 'mid' ELSE 'low' END AS band,
round(a, 4) AS avg_ms, round(b, 4) AS max_ms, round(c, 4) AS min_ms, round(f, 6) AS legacy_faithfulness,
(SELECT count(*) FROM cases WHERE failed) AS errors FROM s, lat, legacy""")
def eval_full(spark, sf):
    """Full-mode summary with score bands, latency and the legacy faithfulness."""
    cases, hits, relevant, inputs = label_cases(spark, sf)
    summary = ev.metric_summary(ev.case_metrics("full", cases, *inputs))
    latency = ev.latency_summary(cases)
    legacy = ev.legacy_scores(ev.retrieval_case_scores(hits, relevant), inputs[2], cases)
    one = lambda df, c, d: F.round(df.select(c).scalar(), d)
    return summary.select(
        "metric", "mean", "median", "available",
        score_band(F.col("mean")).alias("band"),
        *[one(latency, c, 4).alias(c) for c in ("avg_ms", "max_ms", "min_ms")],
        one(legacy, "faithfulness", 6).alias("legacy_faithfulness"),
        ev.error_count(cases).scalar().alias("errors"))
