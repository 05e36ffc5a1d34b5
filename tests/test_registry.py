"""Registered queries against their check SQL at the smallest scale."""

import pytest

from quarry.registry import CATALOG
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# A cross-section; tests/oracle.py runs all of them.
NAMES = ["bm25_topk", "sparse_tf_topk", "dense_cosine_topk", "weighted_rrf", "chunk_recursive", "chunk_paragraph",
         "context_precision", "metric_summary", "score_histogram", "kg_facts", "kg_entities", "kg_khop", "kg_search",
         "document_listing", "regroup", "cascade_delete", "effectiveness", "template_fields", "memory_window",
         "trace_records", "session_traces", "intent_labels", "judge_parse", "transcript_fields", "planned_filter_search",
         "stream_usage", "stream_memory"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, CATALOG.get(name), SF)
    assert ok, message


def test_guard_refuses_writes(spark):
    from quarry.operators.filters import guarded_sql

    for bad in ("DELETE FROM t", "select 1; drop table t"):
        with pytest.raises(ValueError):
            guarded_sql(spark, bad)
    assert guarded_sql(spark, "select 1 as updated_at;").first()[0] == 1
