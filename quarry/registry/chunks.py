"""Chunking and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import entity_name_from_filename
from quarry.operators.catalog import job_rollup
from quarry.operators.chunking import chunk_table
from quarry.registry.catalog import query, table
from quarry.sources import files

TEXT = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def fixed_sql(text: str, size: int, overlap: int) -> str:
    """List expression of fixed windows over a text expression."""
    step = size - overlap
    return (f"list_transform(range(0, greatest(0, ceil((length({text}) - {size}) / {step}.0)::INT) + 1), "
            f"lambda w: substr({text}, w * {step} + 1, {size}))")


def fold_sql(parts: str, sep: str, size: int) -> str:
    """List expression that greedily joins parts up to a size."""
    fits = f"length(CASE WHEN a.buf = '' THEN x ELSE a.buf || {sep} || x END) <= {size}"
    folded = f"""list_reduce({parts}, lambda a, x: CASE WHEN {fits}
      THEN {{'done': a.done, 'buf': CASE WHEN a.buf = '' THEN x ELSE a.buf || {sep} || x END}}
      ELSE {{'done': CASE WHEN a.buf = '' THEN a.done ELSE list_append(a.done, a.buf) END, 'buf': x}} END,
      {{'done': []::VARCHAR[], 'buf': ''}})"""
    return (f"list_transform([{folded}], lambda f: CASE WHEN f.buf = '' THEN f.done "
            f"ELSE list_append(f.done, f.buf) END)[1]")


def recursive_sql(size: int, overlap: int) -> str:
    """One CTE per separator; pieces stay in text order."""
    steps = ["p0 AS (SELECT doc_id, [t] AS ps FROM src)"]
    seps = ("chr(10) || chr(10)", "chr(10)", "'。'", "'. '", "' '")
    for i, sep in enumerate(seps):
        parts = f"list_filter(string_split(p, {sep}), lambda s: s = '' OR {TEXT.format('s')} <> '')"
        steps.append(f"""p{i + 1} AS (SELECT doc_id, flatten(list_transform(ps, lambda p:
          CASE WHEN length(p) <= {size} OR NOT contains(p, {sep}) THEN [p]
          WHEN len({parts}) = 0 THEN {fixed_sql('p', size, overlap)} ELSE {fold_sql(parts, sep, size)} END)) AS ps FROM p{i})""")
    steps.append(f"""final AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= {size} THEN [p]
          ELSE {fixed_sql('p', size, overlap)} END)) AS cs FROM p{len(seps)})""")
    return ", ".join(steps)


OUT = "SELECT doc_id, len(cs) AS chunk_count, unnest(range(0, len(cs)))::INT AS chunk_index, unnest(cs) AS content FROM final"


def _out(df):
    return df.select("doc_id", F.col("chunk_count").cast("long").alias("chunk_count"), "chunk_index", "content")


@query("C1 C4 W8", f"""WITH src AS (SELECT doc_id, {TEXT.format('text')} AS t FROM documents),
final AS (SELECT doc_id, {fixed_sql('t', 200, 40)} AS cs FROM src WHERE t <> '') {OUT}""")
def chunk_fixed(spark, sf):
    """Windows of 200 characters with 40 overlapping."""
    return _out(chunk_table(table(spark, sf, "documents"), "doc_id", "text", "fixed", 200, 40))


@query("C2", f"""WITH src AS (SELECT doc_id, {TEXT.format("replace(text, chr(10), chr(10) || chr(10))")} AS t FROM documents),
parts AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda s: {TEXT.format('s')}), lambda s: s <> '') AS ps FROM src WHERE t <> ''),
final AS (SELECT doc_id, {fold_sql('ps', 'chr(10) || chr(10)', 512)} AS cs FROM parts) {OUT}""")
def chunk_paragraph(spark, sf):
    """Lines set as paragraphs, merged up to 512 characters."""
    docs = table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return _out(chunk_table(docs, "doc_id", "text", "paragraph", 512))


@query("C3", f"""WITH src AS (SELECT doc_id, {TEXT.format('text')} AS t FROM documents WHERE {TEXT.format('text')} <> ''),
{recursive_sql(128, 16)} {OUT}""")
def chunk_recursive(spark, sf):
    """Recursive chunks of 128 characters."""
    return _out(chunk_table(table(spark, sf, "documents"), "doc_id", "text", "recursive", 128, 16))


def raw_files(spark, sf):
    """Documents as bytes with file names; French ones come as web pages."""
    docs = table(spark, sf, "documents")
    html = F.col("lang") == "fr"
    return docs.select(
        F.col("doc_id").alias("document_id"), F.col("text").cast("binary").alias("data"),
        F.concat(F.lit("note_"), F.col("doc_id").cast("string"), F.when(html, ".html").otherwise(".TXT")).alias("filename"),
        F.when(html, "text/html").alias("mime"), F.col("lang").alias("parent_group"), F.col("source").alias("child_group"))


@query("S1 S2 S6 P3 U3", f"""WITH src AS (SELECT doc_id, lang, {TEXT.format('text')} AS t FROM documents WHERE lang <> 'fr' AND {TEXT.format('text')} <> ''),
final AS (SELECT doc_id, lang, {fixed_sql('t', 512, 64)} AS cs FROM src),
rows AS (SELECT doc_id, lang, unnest(range(0, len(cs)))::INT AS chunk_index, unnest(cs) AS content FROM final)
SELECT doc_id::VARCHAR AS document_id, chunk_index, content, 'note_' || doc_id AS entity_name, 'note_' || doc_id AS normalized_entity_name,
lang AS parent_group, sha256(doc_id || '|' || chunk_index) AS id FROM rows""")
def ingest_chunks(spark, sf):
    """Bytes parsed, chunked and cut to the fields of the vector table."""
    parsed = files.parse_documents(raw_files(spark, sf))
    rows, _ = files.ingest(parsed, "fixed")
    meta = parsed.select("document_id", F.col("filename").alias("source"), "parent_group",
                         entity_name_from_filename(F.col("filename")).alias("entity_name"))
    meta = meta.withColumn("normalized_entity_name", F.lower("entity_name"))
    out = files.vector_rows(rows.join(meta, "document_id"))
    return out.select("document_id", "chunk_index", "content", "entity_name", "normalized_entity_name", "parent_group", "id")


@query("S11 A17", f"""WITH src AS (SELECT doc_id, source, lang, {TEXT.format('text')} AS t FROM documents),
o AS (SELECT source AS job_id, (lang = 'fr' OR t = '') AS bad FROM src)
SELECT job_id, count(*) AS total, count(*) AS processed, count(*) FILTER (NOT bad) AS success, count(*) FILTER (bad) AS failed,
CASE WHEN count(*) FILTER (bad) = 0 THEN 'ready' ELSE 'partial' END AS status FROM o GROUP BY 1""")
def job_outcomes(spark, sf):
    """Ingest outcomes rolled up per source."""
    _, outcome = files.ingest(files.parse_documents(raw_files(spark, sf)), "fixed")
    jobs = raw_files(spark, sf).select("document_id", F.col("child_group").alias("job_id"))
    return job_rollup(outcome.join(jobs, "document_id"))


@query("A17", """SELECT user_id AS job_id, count(*) AS total, count(*) AS processed, count(*) FILTER (event_type <> 'error') AS success,
count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'ready' ELSE 'partial' END AS status
FROM events GROUP BY 1""")
def event_job_rollup(spark, sf):
    """Events as job items: an error event is a failed item."""
    return job_rollup(table(spark, sf, "events").withColumnRenamed("user_id", "job_id"),
                      failed=F.col("event_type") == "error")
