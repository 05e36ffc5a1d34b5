"""File sources and table sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.rows import unnest
from quarry.functions.text import safe_name, strip
from quarry.operators.chunking import chunk_arrays, chunk_rows
from quarry.operators.extraction import chunk_id
from quarry.session import cut_lineage, fits
from quarry.sources.versions import VersionedTable

# Stored length of each text field of the vector table.
FIELD_LENGTHS = {"content": 65000, "source": 500, "document_id": 120, "entity_name": 250,
                 "normalized_entity_name": 250, "group": 500, "parent_group": 250, "child_group": 250}
EMBED_ROWS = 32_768  # rows that a task embeds: 64 MB of vectors of 256 doubles
# Components of vectors differ from row to row: a dictionary of them takes time and saves nothing.
VECTOR_FILES = {"parquet.compression.codec.zstd.level": 5, "parquet.enable.dictionary#embedding.list.element": False}
SPREAD = 3  # tasks a core from which rows are left where they are


def decode_utf8(data: Column) -> Column:
    """Bytes as text; invalid bytes are dropped."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))


def parse_documents(df: DataFrame, data: str = "data", filename: str = "filename", mime: str = "mime",
                    max_chars: int | None = None, html_is_text: bool = False) -> DataFrame:
    """Adds text and warning; anything but plain text is unsupported.

    Texts are whole unless ``max_chars`` is given; then ``truncated`` tells
    which were cut.
    """
    kind = F.coalesce(F.col(mime), F.lit("application/octet-stream"))
    is_text = F.lower(F.col(filename)).endswith(".txt") | (
        kind.startswith("text/") & (F.lit(html_is_text) | (kind != "text/html")))
    out = (df.withColumn("text", F.when(is_text, decode_utf8(F.col(data))).otherwise(""))
           .withColumn("warning", F.when(~is_text, "unsupported")))
    if max_chars is None:
        return out
    return (out.withColumn("truncated", F.char_length("text") > max_chars)
            .withColumn("text", F.left("text", F.lit(max_chars))))


def read_files(spark: SparkSession, path: str, max_chars: int | None = None, streaming: bool = False) -> DataFrame:
    """Files of a folder as (path, filename, modified, text, warning)."""
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
                         F.col("modificationTime").alias("modified"), F.col("content").alias("data"),
                         F.lit(None).cast("string").alias("mime"))
    return parse_documents(files, max_chars=max_chars).drop("data", "mime")


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, key, value) of ``key: value`` lines below a folder."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").text(path)
    rows = unnest(text, F.split(strip(F.col("value")), "\n"), "line", "line_no",
                  [F.col("_metadata.file_name").alias("file")])
    parts = F.split("line", ": ", 2)
    return rows.filter(F.col("line").contains(": ")).select(
        "file", "line_no", strip(parts[0]).alias("key"), strip(parts[1]).alias("value"))


def ingest(documents: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 64):
    """(chunk rows, outcome rows) of parsed documents.

    ``documents`` has (document_id, filename, text, warning).  A document that
    gives no chunk is a failed row; it never stops the others.
    """
    # Both results read the chunks: the texts are cut once and written.
    arrays = cut_lineage(chunk_arrays(documents, "text", ["document_id", "filename", "warning"], strategy, size, overlap), "chunks")
    table = chunk_rows(arrays, "document_id")
    table = table.withColumn("id", chunk_id(F.col("document_id"), F.col("chunk_index")))
    outcome = arrays.select(
        "document_id", "filename", "chunk_count",
        F.when(F.col("chunk_count") > 0, "ready").otherwise("failed").alias("status"),
        F.when(F.col("chunk_count") > 0, "").otherwise(F.coalesce("warning", F.lit("empty"))).alias("message"))
    return table, outcome


def vector_rows(rows: DataFrame) -> DataFrame:
    """Rows cut to the field lengths of the vector table; unknown fields dropped.

    A missing chunk_index becomes the row's ``position`` in what is inserted, where that column is given.
    """
    if "position" in rows.columns:
        given = F.col("chunk_index") if "chunk_index" in rows.columns else F.lit(None)
        rows = rows.withColumn("chunk_index", F.coalesce(given.cast("int"), F.col("position").cast("int")))
    fields = ["id", *FIELD_LENGTHS, "chunk_index", "embedding"]
    cut = lambda c: F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(FIELD_LENGTHS[c])).alias(c)
    return rows.select(*[cut(c) if c in FIELD_LENGTHS else F.col(c) for c in fields if c in rows.columns])


def append_vectors(rows: DataFrame, path: str) -> None:
    """Append to the vector table, partitioned by parent group."""
    vector_rows(rows).write.mode("append").partitionBy("parent_group").parquet(path)


def rebuild_vectors(rows: DataFrame, embed: Callable[[Column], Column], target: VersionedTable) -> DataFrame:
    """Embed ``rows`` and put them in place of the rows of the same id.

    Readers of the table see the rows before or after, never in between, and
    a second run leaves the same rows.  A vector is much wider than its text,
    so tasks are cut by rows; where ``rows`` come in ``SPREAD`` tasks a core
    they stay there, as cutting them anew shuffles the texts.  In a task equal
    contents stand together, which the files' compression uses.  ``rows`` is
    read for its count, its keys and its texts: what is dear to compute should
    be staged.
    """
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    n = max(cores, -(-rows.count() // EMBED_ROWS))
    dealt = rows if parts >= min(n, SPREAD * cores) else rows.repartition(n)
    made = vector_rows(dealt.sortWithinPartitions("content").withColumn("embedding", embed(F.coalesce(F.col("content"), F.lit("")))))
    return target.upsert(made, "id", rows.select("id"))


def write_by_attribute(df: DataFrame, path: str, primary: str, name: str) -> None:
    """One folder per primary attribute with sanitised record names."""
    clean = df.withColumn("file_name", F.left(safe_name(F.col(name)), F.lit(80)))
    clean.write.mode("overwrite").partitionBy(primary).parquet(path)


# --- evaluation sets and reports ------------------------------------------------------

CASE_SCHEMA = ("query string, ground_truth_contexts array<string>, ground_truth_answer string, "
               "relevant_ids array<string>, key_facts array<string>, metadata map<string,string>")
CASE_COLUMNS = ("query", "ground_truth_contexts", "ground_truth_answer", "relevant_ids", "key_facts", "metadata")
SET_SCHEMA = ("name string, version string, description string, created_at string, "
              f"test_cases array<struct<{CASE_SCHEMA}>>")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Cases of one-document JSON evaluation sets (S3)."""
    doc = spark.read.option("multiLine", True).schema(SET_SCHEMA).json(path)
    return doc.select("name", F.posexplode("test_cases").alias("case_no", "c")).select("name", "case_no", "c.*")


def write_eval_set(cases: DataFrame, path: str, name: str, version: str = "1.0", description: str = "",
                   created_at: str = "", max_cases: int = 100_000) -> None:
    """An evaluation set as one JSON document (S3).

    ``cases`` has case_no and the columns of a case, in that order in the
    document.  One document is written by one task, so a set of more than
    ``max_cases`` is refused; :func:`write_cases` takes any number.
    """
    if not fits(cases, max_cases):
        raise ValueError(f"more than {max_cases} cases do not go into one document")
    case = F.struct(*[F.col(c) for c in CASE_COLUMNS])
    by_number = lambda a, b: F.when(a["case_no"] < b["case_no"], -1).when(a["case_no"] > b["case_no"], 1).otherwise(0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("case_no", case.alias("c"))), by_number), lambda s: s["c"])
    cases.agg(listed.alias("test_cases")).select(
        F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(description).alias("description"),
        F.lit(created_at).alias("created_at"), "test_cases").coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", False).json(path)


def write_cases(cases: DataFrame, path: str) -> None:
    """One case per line; any number of cases (S3)."""
    cases.write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(summary: DataFrame, per_query: DataFrame, path: str) -> None:
    """Summary and per-query tables of a report."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    per_query.write.mode("overwrite").json(f"{path}/per_query")


def read_report(spark: SparkSession, path: str, summary_schema, per_query_schema):
    return (spark.read.schema(summary_schema).json(f"{path}/summary"),
            spark.read.schema(per_query_schema).json(f"{path}/per_query"))
