"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quarry.registry import CATALOG
from quarry.session import local_session

HEADLINE = [
    "bm25_topk", "corpus_term_stats", "sparse_tf_topk", "dense_cosine_topk", "dense_l2_topk", "hybrid_weighted",
    "rrf_fusion", "mode_switch", "multi_query", "graph_hybrid", "chunk_fixed", "chunk_recursive", "jaccard_pairs",
    "cache_lookup", "retrieval_metrics", "metric_summary", "score_histogram", "kg_facts", "kg_khop", "kg_context",
    "trace_records", "span_parents", "memory_window", "batched_scoring",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))
    for name in ("corpus_term_stats", "batched_scoring"):  # warm the JVM and the Python workers
        CATALOG.get(name).run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        try:
            CATALOG.get(name).run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
        except Exception as exc:  # one failing query must not hide the others
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    n_queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    rate = {q: round(n_queries / times[q], 2) for q in ("bm25_topk", "hybrid_weighted", "multi_query") if q in times}
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": sf_dir.rsplit("sf", 1)[-1], "searches_per_second": rate}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
