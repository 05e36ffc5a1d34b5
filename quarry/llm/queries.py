"""The registered query of each operator, with production parameters, and its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import alignment, ann, fingerprints, html, licenses, maxscore, mixing, packing, partenum, passages, pfor, quality, sharding
from quarry.llm.common import scratch
from quarry.llm.tokens import vocabulary_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"
# Target weights in hundredths: a fifth to the largest source, the rest evenly.
TARGETS = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, mixing.OTHER: 4}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_token_files(spark, sf_dir):
    """Documents encoded into patched frame-of-reference files in doc_id order, and read back."""
    path = scratch(spark, "tokens")
    pfor.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_file(VOCABULARY), end_id=2)
    return pfor.read_tokens(spark, path)


@query()
def op2_jaccard(spark, sf_dir):
    """Classes of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return partenum.jaccard_classes(table(spark, sf_dir, "documents"), shingle_words=3, num=9, den=10)


@query()
def op3_quality(spark, sf_dir):
    """Quality score of every document from boosted trees over text statistics."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_NAMES = [n for n in TARGETS if n != mixing.OTHER]
_SHARES = [*(TARGETS[n] for n in _NAMES), TARGETS[mixing.OTHER]]
_W, _N = sum(_SHARES), len(_SHARES)


@query(f"""
WITH RECURSIVE k AS (SELECT {_SHARES} AS a, {_NAMES} AS names),
s(t, c, q) AS (
  SELECT -1, list_transform(range({_N}), lambda i: 0::BIGINT), NULL::BIGINT
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, i: CASE WHEN i - 1 = pick THEN x + 1 ELSE x END), pick
  FROM (SELECT t, c, list_min(list_transform(
          list_filter(range({_N}), lambda i: c[i + 1] < a[i + 1] AND (c[i + 1] * {_W}) // a[i + 1] <= t + 1),
          lambda i: {{'d': ((c[i + 1] + 1) * {_W} + a[i + 1] - 1) // a[i + 1], 'i': i}})).i AS pick FROM s, k)
  WHERE t < {_W - 1}),
period AS (SELECT t AS at, q AS queue, c[q + 1] - 1 AS k FROM s WHERE t >= 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY doc_id) - 1 AS r
  FROM (SELECT doc_id, source, coalesce(list_position(names, source) - 1, {_N - 1}) AS queue FROM documents, k)),
blocks AS (SELECT *, r // 8 AS block, a[queue + 1] AS share FROM ranked, k),
placed AS (SELECT b.*, (block // share) * {_W} + p.at AS slot
  FROM blocks b JOIN period p ON p.queue = b.queue AND p.k = b.block % b.share)
SELECT doc_id, source, queue::INTEGER AS queue, block::BIGINT AS block, ((block * {_W}) // share)::BIGINT AS release,
  (((block + 1) * {_W} + share - 1) // share)::BIGINT AS due, slot::BIGINT AS slot,
  (row_number() OVER (ORDER BY slot, r) - 1)::BIGINT AS position FROM placed
""")
def op4_mixing(spark, sf_dir):
    """Place of every document in a mixture of the sources at their target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"), TARGETS, keep=["doc_id", "source"])


@query()
def op5_sharding(spark, sf_dir):
    """All documents in 16 contiguous shards of nearly equal bytes."""
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), 16)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query()
def op6_extraction(spark, sf_dir):
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query()
def op7_neighbours(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.filter(F.col("vec_id") % 50 == 0))


@query()
def op8_packing(spark, sf_dir):
    """All documents packed into windows of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file(VOCABULARY), end_id=1)


@query()
def op9_passages(spark, sf_dir):
    """Spans of documents that repeat a passage of more than 50 words, or a similar paragraph, of a smaller id."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op10_fingerprints(spark, sf_dir):
    """Fingerprint of every document and of its edited text."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query(maxscore.search_sql())
def op11_maxscore(spark, sf_dir):
    """The 20 best documents of every benchmark item by integer impacts of shared terms."""
    items = table(spark, sf_dir, "benchmark")
    return maxscore.search(maxscore.build_index(table(spark, sf_dir, "documents")), items)


@query(licenses.scan_sql())
def op12_licenses(spark, sf_dir):
    """License labels of every document from notices in place and counted phrases."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("notices")


@query()
def op13_alignment(spark, sf_dir):
    """Links between the tokens of a byte-level and a sentence-piece tokenizer in every document."""
    return alignment.align_documents(table(spark, sf_dir, "documents"))
