"""Evaluation cases go through their file with whole texts."""

from pyspark.sql import functions as F

from quarry.registry import documents
from quarry.registry.catalog import table
from quarry.session import shared_dir
from quarry.sources import files

SF = "/root/testdata/sf0.001"


def test_cases_keep_whole_texts(spark):
    cases, path = documents._cases(spark, SF), shared_dir(spark, "cases")
    files.write_cases(cases, path)
    back = files.read_cases(spark, path, cases.schema)
    got = {int(r.relevant_ids[0]): ("\n".join(r.ground_truth_contexts), r.ground_truth_answer) for r in back.collect()}
    rows = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").select(
        "doc_id", "text", F.when(F.col("quality") == 1, F.col("text")).otherwise("").alias("answer")).collect()
    assert got == {r.doc_id: (r.text, r.answer) for r in rows}
    assert max(len(r.text) for r in rows) > 1000
