"""Document tables, wiki records, sinks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import strip_markup
from quarry.operators import catalog, evaluation as ev, filters, matching, wiki
from quarry.operators.ranking import sample_chunks, sample_rows
from quarry.registry.catalog import query, table
from quarry.registry.graph import world
from quarry.session import shared_dir
from quarry.sources import files


def doc_table(spark, sf):
    """Documents with an old-style group path; src0 has no group."""
    d = table(spark, sf, "documents")
    group = F.when(F.col("source") == "src0", " ").otherwise(F.concat("lang", F.lit("/ "), "source"))
    return d.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("Note_"), F.col("doc_id").cast("string"),
                                                                   F.lit(".txt")).alias("filename"),
                    group.alias("group"), F.lit("").alias("parent_group"), F.lit("").alias("child_group"),
                    F.col("n_chars").alias("created_at"))


def line_chunks(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))


DOC_SQL = """d AS (SELECT doc_id AS document_id, 'Note_' || doc_id || '.txt' AS filename,
    CASE WHEN source = 'src0' THEN '' ELSE lang || ' / ' || source END AS "group",
    CASE WHEN source = 'src0' THEN '' ELSE lang END AS parent_group, CASE WHEN source = 'src0' THEN '' ELSE source END AS child_group,
    n_chars AS created_at, text FROM documents)"""


@query("A11 P2", f"""WITH {DOC_SQL} SELECT document_id, filename, "group", parent_group, child_group, created_at,
len(string_split(text, chr(10))) AS chunk_count FROM d""")
def document_listing(spark, sf):
    """Documents with normalised group and chunk count."""
    return catalog.document_listing(doc_table(spark, sf), line_chunks(spark, sf))


@query("A18 P2", f"""WITH {DOC_SQL} SELECT parent_group, string_agg(DISTINCT child_group, ',' ORDER BY child_group) AS children
FROM d WHERE parent_group <> '' GROUP BY 1""")
def group_tree(spark, sf):
    """Child groups per parent group."""
    return catalog.group_tree(doc_table(spark, sf)).select("parent_group", F.array_join("children", ",").alias("children"))


@query("J10", f"""WITH {DOC_SQL}, u AS (SELECT doc_id AS document_id, toxic FROM labels WHERE toxic = 1),
n AS (SELECT d.document_id, len(string_split(text, chr(10))) AS chunks,
  CASE WHEN toxic = 1 THEN 'held' ELSE parent_group END AS parent_group, CASE WHEN toxic = 1 THEN 'toxic' ELSE child_group END AS child_group
  FROM d LEFT JOIN u USING (document_id)),
g AS (SELECT *, CASE WHEN parent_group = '' THEN '' ELSE parent_group || ' / ' || child_group END AS "group" FROM n)
SELECT 'document' AS kind, "group", parent_group, child_group, count(*) AS n FROM g GROUP BY ALL
UNION ALL SELECT 'chunk', "group", parent_group, child_group, sum(chunks)::BIGINT FROM g GROUP BY ALL""")
def regroup(spark, sf):
    """Toxic documents and their chunks moved to another group."""
    docs = catalog.with_group(doc_table(spark, sf))
    rows = line_chunks(spark, sf).select("document_id").join(
        docs.select("document_id", "group", "parent_group", "child_group"), "document_id")
    updates = table(spark, sf, "labels").filter("toxic = 1").select(
        F.col("doc_id").alias("document_id"), F.lit("held").alias("new_parent"), F.lit("toxic").alias("new_child"))
    count = lambda df, kind: catalog.regroup(df, updates).groupBy("group", "parent_group", "child_group").agg(
        F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return count(docs, "document").unionByName(count(rows, "chunk")).select(
        "kind", "group", "parent_group", "child_group", "n")


@query("J9", """WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'chunk' AS kind, doc_id AS id, len(string_split(text, chr(10))) AS n, NULL::BIGINT AS provenance FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'vector', vec_id, 1, CASE WHEN vec_id IN (SELECT doc_id FROM gone) THEN NULL ELSE vec_id END FROM embeddings""")
def cascade_delete(spark, sf):
    """Chunks of deleted documents removed; vectors lose the reference."""
    gone = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    rows = catalog.delete_rows(line_chunks(spark, sf), gone, "document_id")
    rows = rows.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n")).select(
        F.lit("chunk").alias("kind"), "id", "n", F.lit(None).cast("long").alias("provenance"))
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("provenance"))
    vectors = catalog.clear_provenance(vectors, gone, "provenance").select(
        F.lit("vector").alias("kind"), F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("n"), "provenance")
    return rows.unionByName(vectors)


@query("S9 J1", """SELECT doc_id AS document_id, len(string_split(text, chr(10))) AS rows, min(n_chars) AS created_at
FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY ALL""")
def reindex_plan(spark, sf):
    """Chunk rows of documents that have no vector yet."""
    docs = catalog.with_group(doc_table(spark, sf))
    rows = catalog.reindex_rows(docs, line_chunks(spark, sf))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"))
    return catalog.reindex_missing(rows, vectors, "document_id").groupBy("document_id").agg(
        F.count("*").alias("rows"), F.min("created_at").alias("created_at"))


@query("S10 P6 O3", f"""WITH {DOC_SQL}, c AS (SELECT count(*) AS n, count(text) AS t FROM d)
SELECT f AS field, f IN ('content', 'document_id', 'group', 'parent_group', 'child_group') AS present,
CASE WHEN f IN ('content', 'document_id', 'group', 'parent_group', 'child_group') THEN n ELSE 0 END AS filled, n AS rows, true AS needs_recreate
FROM c, (SELECT unnest(['id', 'content', 'source', 'document_id', 'entity_name', 'normalized_entity_name', 'group', 'parent_group',
 'child_group', 'chunk_index', 'embedding']) AS f)""")
def schema_check(spark, sf):
    """Required fields of the vector table against the document table."""
    docs = catalog.with_group(doc_table(spark, sf)).join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")),
        "document_id")
    return catalog.schema_status(filters.project_available(docs, list(catalog.REQUIRED_FIELDS)))


@query("P9 P5", f"""WITH {DOC_SQL} SELECT 'group' AS view, document_id FROM d WHERE parent_group = 'en' AND child_group = 'src3' AND contains(lower(filename), 'note_1')
UNION ALL SELECT 'ungrouped', document_id FROM d WHERE parent_group = '' UNION ALL SELECT 'title', document_id FROM d WHERE contains(lower(filename), '_12')""")
def browse_filter(spark, sf):
    """Three browse views over the document table."""
    docs = catalog.with_group(doc_table(spark, sf))
    view = lambda df, name: df.select(F.lit(name).alias("view"), "document_id")
    return (view(filters.browse(docs, "en", "src3", title="NOTE_1"), "group")
            .unionByName(view(filters.browse(docs, ungrouped=True), "ungrouped"))
            .unionByName(view(filters.browse(docs, title="_12"), "title")))


@query("P10", """SELECT id, type, name FROM (SELECT 'supplier:' || s_suppkey AS id, 'supplier' AS type, s_name AS name FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer) WHERE contains(lower(name), 'er#00000001') ORDER BY type, name, id LIMIT 25""")
def entity_search(spark, sf):
    """First 25 entities whose name contains a text, ignoring case."""
    entities, _ = world(spark, sf)
    return filters.search_entities(entities, "ER#00000001", limit=25).select("id", "type", "name")


@query("P12", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL")
def guarded_sql(spark, sf):
    """A read-only statement over a registered view."""
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return filters.guarded_sql(spark, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity "
                                      "FROM lineitem GROUP BY l_returnflag, l_linestatus;")


# --- wiki records ---------------------------------------------------------------------

ATTRS = "火 水 草 光 恶 普通 电 冰 格斗 毒 地 飞行 超能 虫 岩 幽 龙 钢 机械 萌 幻 首领".split()


def spirit_records(spark, sf):
    """Parts as wiki records: two attributes and six stat fields."""
    p = table(spark, sf, "part")
    names = F.array(*[F.lit(a) for a in ATTRS])
    pick = lambda n: F.element_at(names, (n % len(ATTRS) + 1).cast("int"))
    attrs = F.concat(pick(F.col("p_partkey")), F.lit("/ "), pick(F.col("p_size")), F.lit("，"))
    return p.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", attrs.alias("attrs"))


ATTR_SQL = f"""n AS (SELECT {[*ATTRS]} AS names), a AS (SELECT part.*, names[p_partkey % 22 + 1] AS a1, names[p_size % 22 + 1] AS a2 FROM part, n)"""


def chart_sql():
    rows = ", ".join("('{}', {}, {}, {})".format(a, *[f"{x.split()}::VARCHAR[]" for x in rest])
                     for a, *rest in wiki.EFFECT_CHART)
    return f"chart(attribute, strong, resist, weak) AS (VALUES {rows})"


@query("J13", f"""WITH {ATTR_SQL}, {chart_sql()},
e AS (SELECT p_partkey, a1 AS attribute FROM a UNION SELECT p_partkey, a2 FROM a),
s AS (SELECT p_partkey, unnest(strong) AS x, 'strong' AS k FROM e JOIN chart USING (attribute) UNION SELECT p_partkey, unnest(resist), 'resist' FROM e JOIN chart USING (attribute)
      UNION SELECT p_partkey, unnest(weak), 'weak' FROM e JOIN chart USING (attribute))
SELECT p_partkey, coalesce(string_agg(x, ',' ORDER BY x) FILTER (k = 'strong'), '') AS strong, coalesce(string_agg(x, ',' ORDER BY x) FILTER (k = 'resist'), '') AS resist,
coalesce(string_agg(x, ',' ORDER BY x) FILTER (k = 'weak'), '') AS weak FROM s GROUP BY 1""")
def effectiveness(spark, sf):
    """Chart sets of every part's two attributes."""
    recs = spirit_records(spark, sf)
    out = wiki.effectiveness(recs, "p_partkey", wiki.split_attributes(F.col("attrs")), wiki.chart_table(spark))
    return out.select("p_partkey", *[F.array_join(c, ",").alias(c) for c in ("strong", "resist", "weak")])


@query("A14", """SELECT p_partkey, 2 * p_size + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END AS total,
CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 * p_size + p_partkey END AS strict FROM part""")
def stat_totals(spark, sf):
    """Stat totals of the parts; every third has a non-numeric field."""
    third = F.when(F.col("p_partkey") % 3 == 0, "unknown").otherwise(F.col("p_partkey").cast("string"))
    stats = (F.col("p_size"), F.col("p_size").cast("string"), third)
    return table(spark, sf, "part").select("p_partkey", wiki.stat_total(*stats).cast("long").alias("total"),
                                           wiki.strict_total(*stats).cast("long").alias("strict"))


@query("A13", f"""WITH {ATTR_SQL} SELECT a1 AS "primary", count(*) AS n FROM a GROUP BY ROLLUP (a1)""")
def primary_counts(spark, sf):
    """Parts per first attribute, with the total."""
    recs = spirit_records(spark, sf).withColumn(
        "primary", wiki.primary_attribute(wiki.split_attributes(F.col("attrs"))))
    return wiki.primary_counts(recs, "primary")


@query("S5 F22", f"""WITH {ATTR_SQL} SELECT a1 AS "primary", count(*) AS n, min('Brand_' || split_part(p_brand, '#', 2) || p_name) AS first_name FROM a GROUP BY 1""")
def partitioned_sink(spark, sf):
    """Parts written by first attribute and read back."""
    path = shared_dir(spark, "by-attribute")
    recs = spirit_records(spark, sf).withColumn(
        "primary", wiki.primary_attribute(wiki.split_attributes(F.col("attrs"))))
    name = F.concat(F.lit("Br<an>d_​"), F.split("p_brand", "#")[1], F.lit("?*"), "p_name")
    files.write_by_attribute(recs.select("primary", "p_partkey", name.alias("name")), path, "primary", "name")
    back = spark.read.parquet(path)
    return back.groupBy("primary").agg(F.count("*").alias("n"), F.min("file_name").alias("first_name"))


@query("F28", r"""SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages""")
def strip_markup_pages(spark, sf):
    """Digest of every page without its tags."""
    return table(spark, sf, "pages").select("page_id", F.md5(strip_markup(F.col("html"))).alias("digest"))


@query("F27", """WITH t AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]+>', '', 'g')) AS title FROM pages)
SELECT page_id, unnest(['网址', '编号', '标题']) AS key, unnest([url, page_id::VARCHAR || ' end', title]) AS value FROM t""")
def template_fields(spark, sf):
    """Page facts rendered as a template block and parsed back."""
    pages = table(spark, sf, "pages")
    title = F.regexp_replace(F.regexp_extract("html", r"<title>(.*?)</title>", 1), "<[^>]+>", "")
    block = F.concat(F.lit("intro\n{{宠物信息\n|标题=old\n| 网址 = "), "url", F.lit("\n|编号=<b>"),
                     F.col("page_id").cast("string"), F.lit("</b> end{{小|x}}\n|标题="), title, F.lit("\n}}\ntail }}"))
    return wiki.template_fields(pages.select("page_id", block.alias("text")), "page_id", "text")


@query("S7", """SELECT 'p' || event_id AS page, 'kind' AS key, 0 AS pos, event_type AS value FROM events
UNION ALL SELECT 'p' || event_id, 'props', 0, '[' || json_extract_string(props, '$.k') || ']' FROM events""")
def wiki_json_fields(spark, sf):
    """Events rendered as query answers with printouts and parsed back."""
    k = F.get_json_object("props", "$.k")
    js = F.concat(F.lit('{"p'), F.col("event_id").cast("string"), F.lit('": {"printouts": {"kind": [{"fulltext": "'),
                  "event_type", F.lit('", "exists": "1"}, "None"], "props": ["<desc_id='), k, F.lit('</>", ""]}}}'))
    return wiki.printout_fields(table(spark, sf, "events").select(js.alias("js")), "js")


@query("J16 O5 O2", """SELECT p_name || p_partkey AS name, 'brand' AS key, p_brand AS value, 0 AS source FROM part
UNION ALL SELECT p_name || p_partkey, 'type', p_type, 0 FROM part UNION ALL SELECT p_name || p_partkey, 'size', p_size::VARCHAR, 1 FROM part
UNION ALL SELECT p_name || p_partkey, 'brand', p_type, 1 FROM part""")
def merged_sources(spark, sf):
    """Two renderings of every part merged, first of equal pairs kept."""
    p = table(spark, sf, "part").withColumn("name", F.concat("p_name", F.col("p_partkey").cast("string")))
    row = lambda pos, key, value: F.struct(F.lit(pos).alias("pos"), F.lit(key).alias("key"), value.alias("value"))
    side = lambda *rows: p.select("name", F.explode(F.array(*rows)).alias("r")).select("name", "r.*")
    a = side(row(0, "brand", F.col("p_brand")), row(1, "type", F.col("p_type")), row(2, "note", F.lit("None")))
    b = side(row(0, "brand", F.col("p_brand")), row(1, "brand", F.col("p_type")), row(2, "type", F.col("p_type")),
             row(3, "size", F.col("p_size").cast("string")))
    return wiki.merge_sources(a, b).select("name", "key", "value", F.col("seq.source").alias("source"))


@query("O5", """SELECT key, event_id FROM (SELECT CASE WHEN event_type = 'view' THEN user_id::VARCHAR ELSE user_id || '_' || event_type END AS key, event_id,
row_number() OVER (PARTITION BY CASE WHEN event_type = 'view' THEN user_id::VARCHAR ELSE user_id || '_' || event_type END ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def deduped_feed(spark, sf):
    """First event per user and type; the type 'view' counts as no form."""
    e = table(spark, sf, "events").withColumn("form", F.when(F.col("event_type") != "view", F.col("event_type")))
    return wiki.dedupe_feed(e, "user_id", "form", [F.col("event_id")]).select("key", "event_id")


@query("E12 L5", f"""WITH {ATTR_SQL}, qa AS (SELECT 'f' || p_partkey AS source_file, p_partkey, unnest(['编号' || p_partkey || '的精灵是什么？', p_name || '的属性是什么？',
  CASE WHEN p_size % 2 = 0 THEN p_name || '的HP种族值是多少？' ELSE p_name || '的攻击种族值是多少？' END]) AS question,
  unnest([p_name, a1, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_partkey::VARCHAR END]) AS answer_ref,
  unnest(['factual', 'factual', 'numerical']) AS type, unnest([0, 1, 2]) AS pos FROM a)
SELECT * EXCLUDE (p_partkey, k) FROM (SELECT *, source_file || '#' || pos AS k FROM qa) ORDER BY md5(k || '0'), k LIMIT 100""")
def rule_questions(spark, sf):
    """Questions from part records, then a reproducible sample of 100."""
    recs = spirit_records(spark, sf).select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("source_file"), F.col("p_name").alias("name"),
        "p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("hp"),
        wiki.primary_attribute(wiki.split_attributes(F.col("attrs"))).alias("attributes"))
    qs = wiki.rule_questions(recs, {"id": "p_partkey", "attributes": "attributes", "hp": "hp", "attack": "p_partkey",
                                    "speed": "p_partkey", "evolution": "p_brand", "ability": "p_brand"})
    qs = qs.withColumn("k", F.concat("source_file", F.lit("#"), F.col("pos").cast("string")))
    return sample_rows(qs, 100, "k").drop("k")


# --- evaluation sets ------------------------------------------------------------------

def _cases(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(
        F.concat(F.lit("what is in "), F.col("doc_id").cast("string")).alias("query"),
        F.split("text", "\n").alias("ground_truth_contexts"),
        F.when(F.col("quality") == 1, F.col("text")).otherwise("").alias("ground_truth_answer"),
        F.array(F.col("doc_id").cast("string")).alias("relevant_ids"), F.array("source").alias("key_facts"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


CASES_SQL = """c AS (SELECT 'what is in ' || doc_id AS query, CASE WHEN quality = 1 THEN substr(text, 1, 40) ELSE '' END AS ground_truth_answer,
  doc_id::VARCHAR AS relevant_ids, source AS key_facts, lang, array_to_string(string_split(text, chr(10))[1:2], '|') AS contexts
  FROM documents JOIN labels USING (doc_id))"""


@query("S3 P7 P8 L3", f"""WITH {CASES_SQL}, e AS (SELECT * FROM c WHERE lang = 'en'), s AS (SELECT * FROM e ORDER BY md5(query || '7'), query LIMIT 50)
SELECT s.*, (SELECT bool_or(length(ground_truth_answer) > 0) FROM c) AS has_answer, true AS has_relevant_ids FROM s""")
def eval_set_roundtrip(spark, sf):
    """Cases of whole texts written one per line, read back, filtered by metadata and sampled.

    The check SQL shows two lines and 40 characters of each text; only the
    columns shown are cut, after reading.
    """
    path = shared_dir(spark, "cases")
    cases = _cases(spark, sf)
    files.write_cases(cases, path)
    back = files.read_cases(spark, path, cases.schema)
    flags = ev.testset_flags(back)
    picked = sample_rows(filters.metadata_equals(back, "lang", "en"), 50, "query", "7")
    return picked.select(
        "query", F.substring("ground_truth_answer", 1, 40).alias("ground_truth_answer"), F.array_join("relevant_ids", ",").alias("relevant_ids"),
        F.array_join("key_facts", ",").alias("key_facts"), F.col("metadata")["lang"].alias("lang"),
        F.array_join(F.slice("ground_truth_contexts", 1, 2), "|").alias("contexts"),
        flags.select("has_answer").scalar().alias("has_answer"),
        flags.select("has_relevant_ids").scalar().alias("has_relevant_ids"))


@query("S4 A5", """WITH m AS (SELECT event_id AS query_id, event_type AS metric, value / 250 AS value FROM events)
SELECT metric, round(avg(value), 6) AS mean, count(*) AS available, (SELECT count(*) FROM m) AS cases FROM m GROUP BY 1""")
def report_roundtrip(spark, sf):
    """Report tables written and read back."""
    from quarry.registry.evaluate import event_scores

    path, scores = shared_dir(spark, "report"), event_scores(spark, sf)
    summary = ev.metric_summary(scores)
    files.write_report(summary, scores, path)
    back, per_query = files.read_report(spark, path, summary.schema, scores.schema)
    return back.select("metric", "mean", "available", per_query.agg(F.count("*")).scalar().alias("cases"))


@query("E11 L4 S3", """WITH s AS (SELECT * FROM documents WHERE length(text) >= 100 ORDER BY md5(doc_id || 'seed'), doc_id LIMIT 60)
SELECT doc_id::VARCHAR AS chunk_id, pos, 'q' || pos || ' of ' || source AS query, lang AS ground_truth_answer, lang AS key_facts, 'llm_auto' AS method
FROM s, (SELECT unnest([0, 2]) AS pos)""")
def generated_cases(spark, sf):
    """Cases from rendered answers for a sample of long documents."""
    docs = sample_chunks(table(spark, sf, "documents"), 60, "doc_id", "text", 100, "seed")
    pair = lambda i, q: F.concat(F.lit(f'{{"question": "{q}'), F.lit("" if not q else f"{i} of "),
                                 F.lit("") if not q else F.col("source"), F.lit('", "answer": " '), "lang",
                                 F.lit(' ", "key_facts": ["'), "lang", F.lit('"]}'))
    raw = F.concat(F.lit('Sure.\n{"qa_pairs": ['), pair(0, "q"), F.lit(", "), pair(1, ""), F.lit(", "), pair(2, "q"),
                   F.lit(", "), pair(3, "q"), F.lit("]}"))
    cases = ev.cases_from_answers(docs.select("doc_id", raw.alias("raw")), "doc_id", "raw", 3)
    return cases.select("chunk_id", "pos", "query", "ground_truth_answer", F.array_join("key_facts", ",").alias("key_facts"),
                        F.col("metadata")["generation_method"].alias("method"))


# --- catalogue and similarity ---------------------------------------------------------

@query("V18 F5", r"""WITH n AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
t AS (SELECT side, id, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), ' '), lambda x: x <> ''))) AS toks FROM n),
p AS (SELECT d.id AS left_id, b.id AS right_id, len(list_intersect(d.toks, b.toks)) AS i, len(d.toks) AS x, len(b.toks) AS y
      FROM t d, t b WHERE d.side = 'd' AND b.side = 'b')
SELECT left_id, right_id, round(i / (x + y - i), 9) AS similarity FROM p WHERE i / (x + y - i) >= 0.3""")
def jaccard_pairs(spark, sf):
    """Documents and benchmark texts with token Jaccard of at least 0.3."""
    return matching.jaccard_pairs(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 0.3, "doc_id", "text",
                                  "item_id", "text").withColumn("similarity", F.round("similarity", 9))
