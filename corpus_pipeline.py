"""Documents to training windows: quality, near duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents.  No SQL expresses the learned classifier, so
the pipeline is tested against brute-force versions of its stages.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, partenum, passages, quality
from quarry.llm.common import Folders, free_name, rows_by_id, stage
from quarry.llm.queries import TARGETS, VOCABULARY, table
from quarry.llm.tokens import vocabulary_file


_MINE = threading.local()  # a pipeline's folders; pipelines of other threads and other queries keep theirs


@contextmanager
def _staging():
    """What is staged within belongs to this thread's pipeline."""
    if not hasattr(_MINE, "folders"):
        _MINE.folders = Folders()
    with _MINE.folders.collecting() as folders:
        yield folders


@contextmanager
def _turn(spark: SparkSession, docs: DataFrame):
    """A stage: the folders of the stages before it go, but for those that ``docs`` reads."""
    with _staging() as folders:
        folders.release(spark, docs)
        yield


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    with _turn(spark, docs):
        return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each class of rows whose 5-word shingles have a similarity of 0.8 or more."""
    with _turn(spark, docs):
        return partenum.one_of_each(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that rows before them, by id and size, keep."""
    with _turn(spark, docs):
        rows, node = rows_by_id(docs), free_name(docs, "node")
        spans = passages.repeated_passages(rows.select("node", "row.text"), key="node")
        return passages.remove(rows.select("row.*", F.col("node").alias(node)), spans, node).drop(node)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted over the whole table by their place in the mixture of sources."""
    with _turn(spark, docs):
        rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
        return mixing.in_order(mixing.mix(rows, TARGETS, keep=["row"])).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of all documents; each task packs its part of the mixture in order."""
    with _turn(spark, docs):
        return packing.pack(docs, vocabulary_file(VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("passages", passages_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        made = step(spark, docs, sf_dir)
        with _staging():
            docs = stage(made, name)
    return docs
