"""Vector tables, evaluation sets and corpora written to files and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.vectors import hash_embedding
from quarry.operators import catalog
from quarry.operators.extraction import chunk_id
from quarry.operators.ranking import sample_rows
from quarry.registry.catalog import query
from quarry.registry.documents import DOC_SQL, _cases, doc_table, line_chunks
from quarry.registry.graph import PART_SQL, part_documents
from quarry.registry.search import hash_vec_sql
from quarry.session import cut_lineage, shared_dir
from quarry.sources import files
from quarry.sources.versions import VersionedTable


def _vector_input(spark, sf):
    """Line chunks with their document's fields; every third one has lost its index."""
    rows = catalog.reindex_rows(catalog.with_group(doc_table(spark, sf)), line_chunks(spark, sf))
    index = F.when(F.col("document_id") % 3 != 0, F.col("chunk_index"))
    return rows.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("id"), "document_id", "content", "source", "group",
        "parent_group", "child_group", index.alias("chunk_index"), F.col("chunk_index").alias("position"), F.lit(1).alias("unknown"))


LINES_SQL = f"""{DOC_SQL}, l AS (SELECT document_id, parent_group, filename, unnest(string_split(text, chr(10))) AS content,
  unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM d)"""


@query("S6", f"""WITH {LINES_SQL} SELECT sha256(concat_ws('|', document_id, chunk_index)) AS id, document_id::VARCHAR AS document_id,
chunk_index::INTEGER AS chunk_index, parent_group AS parent, md5(left(content, 65000)) AS digest FROM l""")
def vector_table(spark, sf):
    """Chunk rows appended to the vector table in two parts, cut to its fields, and read back."""
    path, rows = shared_dir(spark, "vectors"), _vector_input(spark, sf)
    for part in (0, 1):
        files.append_vectors(rows.filter(F.col("document_id") % 2 == part), path)
    out = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(path)
    return out.select("id", "document_id", "chunk_index", F.coalesce(F.col("parent_group").cast("string"), F.lit("")).alias("parent"),
                      F.md5("content").alias("digest"))


@query("S9 S6", f"""WITH {LINES_SQL}, {hash_vec_sql('v', '(SELECT document_id || chr(0) || chunk_index AS k, content AS text FROM l)', 'k')},
n AS (SELECT id, count(*) AS filled, round(sum(w), 6) AS total FROM v GROUP BY id)
SELECT document_id::VARCHAR AS document_id, chunk_index::INTEGER AS chunk_index, md5(content) AS digest,
  coalesce(filled, 0) AS filled, coalesce(total, 0) AS total FROM l LEFT JOIN n ON n.id = document_id || chr(0) || chunk_index""")
def vector_rebuild(spark, sf):
    """The vector table rebuilt from documents and chunks: a stale part first, then all of it twice."""
    target = VersionedTable(spark, shared_dir(spark, "rebuilt"), files.VECTOR_FILES)
    # Ids are digests, which do not compress: they are made again from what stands beside them.
    rows = cut_lineage(_vector_input(spark, sf).drop("id", "unknown").sortWithinPartitions("content"), "vector-input")
    rows = rows.withColumns({"id": chunk_id(F.col("document_id"), F.col("position")), "unknown": F.lit(1)})
    stale = rows.filter(F.col("document_id") % 5 == 0).withColumn("content", F.lit("stale"))
    files.rebuild_vectors(stale, hash_embedding, target)
    for _ in range(2):
        out = files.rebuild_vectors(rows, hash_embedding, target)
    filled = F.filter("embedding", lambda v: v > 0)
    total = F.aggregate(filled, F.lit(0.0), lambda a, v: a + v)
    return out.select("document_id", "chunk_index", F.md5("content").alias("digest"), F.size(filled).cast("long").alias("filled"),
                      F.round(total, 6).alias("total"))


@query("S3 L3", """SELECT row_number() OVER (ORDER BY md5(query || '7'), query) - 1 AS case_no, * FROM (
SELECT 'what is in ' || doc_id AS query, md5(array_to_string(string_split(text, chr(10)), chr(1))) AS contexts,
  CASE WHEN quality = 1 THEN md5(text) ELSE md5('') END AS answer, doc_id::VARCHAR AS relevant_ids, source AS key_facts, lang
FROM documents JOIN labels USING (doc_id)) ORDER BY md5(query || '7'), query LIMIT 200""")
def eval_set_document(spark, sf):
    """A sample of 200 cases as one JSON document, read back case by case."""
    path = shared_dir(spark, "eval-set")
    order = [F.md5(F.concat("query", F.lit("7"))), F.col("query")]
    cases = sample_rows(_cases(spark, sf), 200, "query", "7")
    cases = cases.withColumn("case_no", F.row_number().over(Window.orderBy(*order)) - 1)
    files.write_eval_set(cases, path, "labelled")
    back = files.read_eval_set(spark, path)
    return back.select(
        F.col("case_no").cast("long").alias("case_no"), "query", F.md5(F.array_join("ground_truth_contexts", "\u0001")).alias("contexts"),
        F.md5("ground_truth_answer").alias("answer"), F.col("relevant_ids")[0].alias("relevant_ids"),
        F.col("key_facts")[0].alias("key_facts"), F.col("metadata")["lang"].alias("lang"))


@query("S8", f"""WITH {PART_SQL}, l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM doc)
SELECT trim(split_part(line, ': ', 1)) AS key, trim(substr(line, strpos(line, ': ') + 2)) AS value, count(*) AS n
FROM l WHERE contains(line, ': ') GROUP BY ALL""")
def corpus_fields(spark, sf):
    """`key: value` lines of a folder of text files."""
    path = shared_dir(spark, "corpus")
    part_documents(spark, sf).select("text").write.text(path)
    return files.corpus_lines(spark, path).groupBy("key", "value").agg(F.count("*").alias("n"))
