"""Knowledge-graph queries over rendered part records and the nation graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize_name
from quarry.operators import extraction as kg
from quarry.operators import graph
from quarry.operators.chunking import chunk_table
from quarry.registry.catalog import query, table
from quarry.session import cut_lineage, file_states, passing

# --- part records as `key: value` documents -------------------------------------------

PART_SQL = """p AS (
    SELECT p_partkey AS d, p_type AS t, p_brand AS b, p_size AS size, p_name AS pname,
      CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS w1,
      split_part(p_name, ' ', 2) AS w2, p_retailprice::VARCHAR AS price, p_name || ' ' || p_partkey AS subject,
      (1700000000 + p_size * 86400) AS created FROM part),
  doc AS (SELECT d, '# ' || pname || chr(10) || '精灵名称: ' || subject || chr(10) || '分类: hidden' || chr(10) ||
      '主属性: ' || t || chr(10) || '技能: ' || w1 || '、' || w2 || '，-' || chr(10) || '生命: HP ' || size || chr(10) ||
      '物攻: ' || price || chr(10) || '体型: ' || size || '~' || (100 - size) || chr(10) || '更新版本: ' || b || chr(10) ||
      '精灵描述: a ' || t || ' part' || chr(10) || 'sold as ' || b || chr(10) ||
      '属性: |特性=' || w2 || '|2属性=' || b || chr(10) || '重量: none；' AS text FROM p)"""

FACTS_SQL = PART_SQL + """,
  raw AS (
    SELECT d, created, subject, '主属性' AS predicate, 'attribute' AS ot, t AS obj, NULL AS vt, NULL::DOUBLE AS vn, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, 1 AS o FROM p
    UNION ALL SELECT d, created, subject, '副属性', 'attribute', b, NULL, NULL, NULL, NULL, 2 FROM p
    UNION ALL SELECT d, created, subject, '拥有技能', 'skill', w1, NULL, NULL, NULL, NULL, 3 FROM p
    UNION ALL SELECT d, created, subject, '拥有技能', 'skill', w2, NULL, NULL, NULL, NULL, 4 FROM p WHERE lower(w1) <> lower(w2)
    UNION ALL SELECT d, created, subject, '生命', NULL, NULL, 'HP ' || size, size, NULL, NULL, 5 FROM p
    UNION ALL SELECT d, created, subject, '物攻', NULL, NULL, price, price::DOUBLE, NULL, NULL, 6 FROM p
    UNION ALL SELECT d, created, subject, '体型', NULL, NULL, size || '~' || (100 - size), NULL, least(size, 100 - size), greatest(size, 100 - size), 7 FROM p
    UNION ALL SELECT d, created, subject, '重量', NULL, NULL, 'none', NULL, NULL, NULL, 8 FROM p
    UNION ALL SELECT d, created, subject, '更新版本', NULL, NULL, b, NULL, NULL, NULL, 9 FROM p),
  facts AS (SELECT *, lower(subject) AS sk, lower(obj) AS ok FROM raw)"""

ENT_SQL = FACTS_SQL + """,
  nodes AS (SELECT d, created, 'spirit' AS type, lower(subject) AS key, subject AS name FROM p
            UNION ALL SELECT d, created, ot, ok, first(obj ORDER BY o) FROM facts WHERE obj IS NOT NULL GROUP BY ALL),
  ents AS (SELECT sha256(type || '|' || key) AS id, type, key, last(name ORDER BY created, d) AS name,
           first(d ORDER BY created, d) AS src FROM nodes GROUP BY type, key),
  rels AS (SELECT sha256(concat_ws('|', d, sha256('spirit|' || sk), predicate,
             coalesce(sha256(ot || '|' || ok), ''), coalesce(vt, ''))) AS id,
           sha256('spirit|' || sk) AS sid, predicate, sha256(ot || '|' || ok) AS oid, vt, vn, lo, hi, d FROM facts)"""


def part_documents(spark, sf) -> DataFrame:
    """Every part rendered as a document of labelled lines."""
    return as_documents(table(spark, sf, "part"))


def as_documents(p: DataFrame) -> DataFrame:
    word = F.split("p_name", " ")
    w1 = F.when(F.col("p_partkey") % 2 == 0, F.upper(word[0])).otherwise(word[0])
    w2 = F.coalesce(F.get(word, F.lit(1)), F.lit(""))
    s = lambda c: F.col(c).cast("string")
    line = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    text = F.concat_ws(
        "\n", line("# ", s("p_name")), line("精灵名称: ", s("p_name"), " ", s("p_partkey")), F.lit("分类: hidden"),
        line("主属性: ", s("p_type")), line("技能: ", w1, "、", w2, "，-"), line("生命: HP ", s("p_size")),
        line("物攻: ", s("p_retailprice")), line("体型: ", s("p_size"), "~", (100 - F.col("p_size")).cast("string")),
        line("更新版本: ", s("p_brand")), line("精灵描述: a ", s("p_type"), " part"), line("sold as ", s("p_brand")),
        line("属性: |特性=", w2, "|2属性=", s("p_brand")), F.lit("重量: none；"))
    return p.select(F.col("p_partkey").alias("document_id"), text.alias("text"),
                    F.concat(F.lit("part_"), s("p_partkey"), F.lit(".txt")).alias("filename"),
                    F.timestamp_seconds(1700000000 + F.col("p_size") * 86400).alias("created_at"))


def _rows(spark, sf):
    return kg.field_rows(part_documents(spark, sf), "document_id", "text", "filename")


_STORED: dict = {}


def _graph(spark, sf):
    """Entities and relations of the part documents, written once for each session and state of the table."""
    key = spark.sparkContext.applicationId, file_states(table(spark, sf, "part"))
    if key not in _STORED or _STORED[key][0].sparkSession is not spark:
        with passing(spark) as keep:  # fields and facts go when both tables are written
            _STORED[key] = tuple(keep(t) for t in kg.store_graph(*kg.build_graph(part_documents(spark, sf), kg.mapping_table(spark))))
    return _STORED[key]


@query("K1 K2 W9 F1 F9", f"""WITH {PART_SQL}, f AS (
SELECT d, subject, unnest([{{'k': '精灵名称', 'v': subject}}, {{'k': '主属性', 'v': t}}, {{'k': '技能', 'v': w1 || '、' || w2 || '，-'}},
  {{'k': '生命', 'v': 'HP ' || size}}, {{'k': '物攻', 'v': price}}, {{'k': '体型', 'v': size || '~' || (100 - size)}},
  {{'k': '更新版本', 'v': b}}, {{'k': '精灵描述', 'v': 'a ' || t || ' part sold as ' || b}}, {{'k': '特性', 'v': w2}},
  {{'k': '2属性', 'v': b}}, {{'k': '重量', 'v': 'none'}}]) AS e FROM p)
SELECT d AS document_id, subject, e.k AS key, e.v AS value FROM f""")
def kg_field_parse(spark, sf):
    """Field rows of the rendered part documents."""
    return _rows(spark, sf).filter("key IS NOT NULL").select("document_id", "subject", "key", "value")


@query("K3 A4 F7 F8", f"""WITH {FACTS_SQL} SELECT d AS document_id, subject, predicate, ot AS object_type, obj AS object,
vt AS value_text, vn AS value_number, lo AS value_min, hi AS value_max FROM facts""")
def kg_facts(spark, sf):
    """Facts of the rendered part documents."""
    return kg.extract_facts(_rows(spark, sf), kg.mapping_table(spark)).select(
        "document_id", "subject", "predicate", "object_type", "object", "value_text", "value_number",
        "value_min", "value_max")


@query("A3 K5 T6", f"""WITH {ENT_SQL} SELECT e.id, e.type, key AS normalized_name, e.name, src AS source_document_id,
CASE WHEN e.type = 'spirit' THEN '体型=' || size || '~' || (100 - size) || ';更新版本=' || b || ';重量=none' ELSE '' END AS properties
FROM ents e LEFT JOIN p ON e.type = 'spirit' AND p.d = e.src""")
def kg_entities(spark, sf):
    """Entities of all part documents after the upsert (text properties printed)."""
    entities, _ = _graph(spark, sf)
    kept = F.filter(F.map_entries("properties"), lambda e: e["key"].isin("体型", "更新版本", "重量"))
    printed = F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return entities.select("id", "type", "normalized_name", "name", "source_document_id", printed.alias("properties"))


@query("K5 J2", f"""WITH {ENT_SQL} SELECT r.id, s.name AS subject_name, r.predicate, o.name AS object_name, vt AS value_text,
sha256(r.d || '|0') AS source_chunk_id, 1.0::DOUBLE AS confidence
FROM rels r JOIN ents s ON s.id = r.sid LEFT JOIN ents o ON o.id = r.oid""")
def kg_triples(spark, sf):
    """Relations of all part documents joined with their entities."""
    entities, relations = _graph(spark, sf)
    return graph.triples(relations, entities).select("id", "subject_name", "predicate", "object_name", "value_text",
                                                     "source_chunk_id", "confidence")


@query("A1", f"""WITH {ENT_SQL}, c AS (SELECT 'entity' AS kind, type AS name FROM ents UNION ALL SELECT 'relation', predicate FROM rels)
SELECT kind, name, count(*) AS n FROM c GROUP BY GROUPING SETS ((kind, name), (kind))""")
def kg_stats(spark, sf):
    """Entity and relation counts by type and predicate, with totals."""
    return graph.graph_stats(*_graph(spark, sf))


@query("A19 K4 K7", f"""WITH {ENT_SQL}, n AS (SELECT d, count(*) AS e FROM nodes GROUP BY 1), r AS (SELECT d, count(*) AS r FROM facts GROUP BY 1)
SELECT d AS document_id, e AS entities, r AS relations, 'spirit_description' AS candidate_fields, 'a ' || t || ' part sold as ' || b AS candidate
FROM n JOIN r USING (d) JOIN p USING (d)""")
def kg_doc_stats(spark, sf):
    """Entities, relations and free-text candidates per document."""
    # Each is read several times below: texts are parsed and facts taken from them once.
    mapping, rows = kg.mapping_table(spark), cut_lineage(_rows(spark, sf), "fields")
    candidates = kg.text_candidates(rows, mapping)
    stats = kg.document_stats(rows, cut_lineage(kg.extract_facts(rows, mapping), "facts"), candidates)
    return stats.join(candidates, "document_id").select(
        "document_id", "entities", "relations", F.array_join("candidate_fields", ",").alias("candidate_fields"),
        F.col("text").alias("candidate"))


@query("J1 W8", """SELECT doc_id AS document_id, md5(text) AS digest, len(string_split(text, chr(10))) AS chunks FROM documents""")
def kg_document_text(spark, sf):
    """Documents cut into lines and joined back from the chunk table."""
    docs = table(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").alias("document_id"),
                         F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return kg.document_text(chunks).select("document_id", F.md5("text").alias("digest")).join(counts, "document_id")


# --- context retrieval ----------------------------------------------------------------

QUESTIONS_SQL = ENT_SQL + r""",
  q AS (SELECT DISTINCT b || ' ' || t || ' 技能' AS query_id, b || ' ' || t || ' 技能' AS text FROM p),
  terms AS (SELECT DISTINCT query_id, unnest(list_append(regexp_extract_all(text, '[\p{L}\p{N}_]+'),
            regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g'))) AS term FROM q),
  t2 AS (SELECT * FROM terms WHERE length(term) >= 2),
  cand AS (SELECT q.query_id, e.id, e.name, e.type, e.src, contains(text, e.name) AS inq,
      e.name IN ('精灵', '技能', '属性', '图鉴', '知识', '资料', '哪些', '什么', '一下') AS stop,
      e.type IN ('spirit', 'skill', 'attribute') AS bonus, e.name = text AS exact
    FROM q JOIN ents e ON (contains(text, e.name) AND e.type IN ('spirit', 'skill', 'attribute', 'bloodline_skill', 'skill_stone') AND length(e.name) >= 2)
      OR EXISTS (SELECT 1 FROM t2 WHERE t2.query_id = q.query_id AND contains(lower(e.name), lower(t2.term)))),
  ment0 AS (SELECT *, CASE WHEN stop THEN -999 ELSE exact::INT * 3 + CASE WHEN inq THEN 2 + least(length(name), 8) ELSE 0 END + bonus::INT END AS score FROM cand),
  ment AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(name) DESC, id) AS er FROM ment0) WHERE er <= 30),
  touch AS (SELECT e.id AS eid, r.id AS rid, row_number() OVER (PARTITION BY e.id ORDER BY r.id) AS rn
            FROM (SELECT DISTINCT id FROM ment) e JOIN rels r ON r.sid = e.id OR r.oid = e.id),
  bye AS (SELECT query_id, rid, er FROM ment JOIN touch ON eid = ment.id WHERE rn <= 80),
  byp AS (SELECT query_id, rid, 1000000 AS er FROM (SELECT query_id, rid, row_number() OVER (PARTITION BY query_id ORDER BY rid) AS rn
          FROM (SELECT DISTINCT query_id, r.id AS rid FROM t2 JOIN rels r ON contains(lower(predicate), lower(term)))) WHERE rn <= 80),
  rk AS (SELECT query_id, rid, row_number() OVER (PARTITION BY query_id ORDER BY e, rid) - 1 AS rank
         FROM (SELECT query_id, rid, min(er) AS e FROM (SELECT * FROM bye UNION ALL SELECT * FROM byp) GROUP BY ALL)),
  sc0 AS (SELECT rk.query_id, rk.rid, rank, text, s.name AS sn, predicate, coalesce(o.name, vt, '') AS onm, d,
            s.name || ' --' || predicate || '--> ' || coalesce(o.name, vt, '') AS fact
          FROM rk JOIN rels r ON r.id = rid JOIN ents s ON s.id = sid LEFT JOIN ents o ON o.id = oid JOIN q ON q.query_id = rk.query_id),
  part_terms AS (SELECT query_id, rid, sum(0.25 * contains(sn, term)::INT + 0.35 * contains(onm, term)::INT + 0.3 * contains(predicate, term)::INT) AS pt
                 FROM sc0 JOIN t2 USING (query_id) GROUP BY ALL),
  sc AS (SELECT *, 1.0 / (1 + rank * 0.2) + CASE WHEN contains(text, sn) THEN 1.2 ELSE 0 END + CASE WHEN onm <> '' AND contains(text, onm) THEN 1.4 ELSE 0 END
      + CASE WHEN contains(text, predicate) THEN 1.1 ELSE 0 END + pt
      + CASE predicate WHEN '主属性' THEN 0.4 WHEN '副属性' THEN 0.35 WHEN '拥有技能' THEN 0.45 ELSE 0 END
      + CASE predicate WHEN '拥有技能' THEN 0.6 ELSE 0 END + 0.15 AS rel FROM sc0 JOIN part_terms USING (query_id, rid))"""


def part_questions(spark, sf) -> DataFrame:
    """One question per brand and type that occurs."""
    text = F.concat_ws(" ", "p_brand", "p_type", F.lit("技能"))
    return table(spark, sf, "part").select(text.alias("query_id"), text.alias("text")).distinct()


@query("J6 V13", f"""WITH {QUESTIONS_SQL} SELECT query_id, id, name, type, inq AS in_query, score, er AS entity_rank FROM ment""")
def kg_mentions(spark, sf):
    """Entities mentioned by each question, best first."""
    entities, _ = _graph(spark, sf)
    return graph.mentions(part_questions(spark, sf), entities, graph.MENTION_LIMIT).select(*MENTION_COLUMNS)


MENTION_COLUMNS = ["query_id", "id", "name", "type", "in_query", "score", "entity_rank"]
# The same without the limits of 30 entities and 80 relations.
WHOLE_SQL = QUESTIONS_SQL.replace("WHERE er <= 30", "").replace("WHERE rn <= 80", "")


@query("J6 V13", f"""WITH {WHOLE_SQL} SELECT query_id, id, name, type, inq AS in_query, score, er AS entity_rank, true AS complete FROM ment""")
def kg_mentions_all(spark, sf):
    """All entities mentioned by each question, best first."""
    entities, _ = _graph(spark, sf)
    return graph.mentions(part_questions(spark, sf), entities, None).select(*MENTION_COLUMNS, "complete")


@query("J7 V12 F20 F4", f"""WITH {QUESTIONS_SQL} SELECT query_id, rid AS rel_id, rank AS rel_rank, fact, round(rel, 6) AS relevance FROM sc""")
def kg_relevance(spark, sf):
    """Relations of each question with rank, printed fact and relevance."""
    entities, relations = _graph(spark, sf)
    questions = part_questions(spark, sf)
    matched = cut_lineage(graph.mentions(questions, entities, graph.MENTION_LIMIT), "matched")
    ranked = cut_lineage(graph.query_relations(questions, matched, relations, graph.EDGE_LIMIT), "ranked")
    return graph.scored_relations(questions, ranked, relations, entities).select(
        "query_id", "rel_id", "rel_rank", "fact", F.round("relevance", 6).alias("relevance"))


@query("J7 V12 F20 F4", f"""WITH {WHOLE_SQL} SELECT query_id, rid AS rel_id, rank AS rel_rank, true AS complete, round(rel, 6) AS relevance FROM sc""")
def kg_relevance_all(spark, sf):
    """All relations of each question, with rank and relevance."""
    return graph.scored_mentions(part_questions(spark, sf), *_graph(spark, sf)).select(
        "query_id", "rel_id", "rel_rank", "complete", F.round("relevance", 6).alias("relevance"))


LINES_SQL = """,
  lines AS (SELECT query_id, d, sum(rel) AS part, 0 AS br, min(rank) AS posn, fact AS line FROM sc GROUP BY query_id, d, fact
            UNION ALL SELECT query_id, src, CASE WHEN inq THEN 1.5 ELSE 0.6 END, 1, er, '命中实体：' || name || '（' || type || '）' FROM ment),
  ds AS (SELECT query_id, d AS id, round(sum(part), 9) AS kg, list_slice(list(line ORDER BY br, posn, line), 1, 24) AS facts FROM lines GROUP BY ALL),
  topd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kg DESC, id) AS rank FROM ds) WHERE rank <= 5),
  ctx AS (SELECT query_id, rank, 'kg:' || id AS id, id AS document_id, kg, least(1.0, kg / 4) AS score,
     '## 知识图谱命中事实' || chr(10) || '- ' || array_to_string(facts, chr(10) || '- ') || chr(10) || chr(10) || '## 来源片段' || chr(10) ||
     array_to_string(list_transform(range(0, least(3, ceil(length(text) / 64.0)::INT)), lambda i: substr(text, i * 64 + 1, 64)), chr(10)) AS content
     FROM topd JOIN doc ON doc.d = topd.id)"""
CONTEXT_SQL, WHOLE_CONTEXT_SQL = QUESTIONS_SQL + LINES_SQL, WHOLE_SQL + LINES_SQL


@query("V14 A12 W7", f"""WITH {CONTEXT_SQL} SELECT query_id, rank, id, document_id, round(score, 6) AS score, round(kg, 6) AS kg_score,
content, 'part_' || document_id || '.txt' AS source FROM ctx""")
def kg_context(spark, sf):
    """Printed graph context of each question from its five best documents."""
    return part_context(spark, sf).select("query_id", "rank", "id", "document_id", F.round("score", 6).alias("score"),
                                          F.round("kg_score", 6).alias("kg_score"), "content", "source")


def part_chunks(spark, sf):
    return chunk_table(part_documents(spark, sf), "document_id", "text", "fixed", 64, 0)


def part_context(spark, sf, k=5, edge_limit=graph.EDGE_LIMIT, mention_limit=graph.MENTION_LIMIT):
    entities, relations = _graph(spark, sf)
    return graph.graph_context(part_questions(spark, sf), entities, relations, part_chunks(spark, sf),
                               part_documents(spark, sf), k, edge_limit, mention_limit)


@query("V14 A12 W7", f"""WITH {WHOLE_CONTEXT_SQL} SELECT query_id, rank, id, document_id, round(score, 6) AS score, round(kg, 6) AS kg_score,
content, true AS complete FROM ctx""")
def kg_context_all(spark, sf):
    """Graph context of each question from all its entities and relations."""
    return part_context(spark, sf, 5, None, None).select(
        "query_id", "rank", "id", "document_id", F.round("score", 6).alias("score"), F.round("kg_score", 6).alias("kg_score"),
        "content", "complete")


# --- customer and supplier graph ------------------------------------------------------

WORLD_SQL = """
  went AS (SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer),
  wrel AS (SELECT 'n' || n_nationkey AS id, 'nation:' || n_nationkey AS s, 'part of' AS p, 'region:' || n_regionkey AS o, NULL AS vt FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'supplier:' || s_suppkey, 'located in', 'nation:' || s_nationkey, NULL FROM supplier
    UNION ALL SELECT 'c' || c_custkey, 'customer:' || c_custkey, 'located in', 'nation:' || c_nationkey, NULL FROM customer
    UNION ALL SELECT 'm' || c_custkey, 'customer:' || c_custkey, 'buys ' || c_mktsegment, NULL, c_mktsegment FROM customer)"""


def world(spark, sf):
    """(entities, relations) of regions, nations, suppliers and customers."""
    region, nation, supplier, customer = (table(spark, sf, t) for t in ("region", "nation", "supplier", "customer"))
    key = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))

    def ent(df, kind, id_col, name):
        return df.select(key(kind, id_col).alias("id"), F.lit(kind).alias("type"),
                         F.lower(normalize_name(F.col(name))).alias("normalized_name"), F.col(name).alias("name"),
                         F.lit(None).cast("string").alias("source_document_id"))

    def rel(df, prefix, kind, id_col, predicate, obj=None, value=None):
        null = F.lit(None).cast("string")
        return df.select(
            F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("id"), key(kind, id_col).alias("subject_id"),
            predicate.alias("predicate"), (null if obj is None else obj).alias("object_id"),
            (null if value is None else value).alias("value_text"),
            *[F.lit(None).cast("double").alias(c) for c in ("value_number", "value_min", "value_max")],
            null.alias("source_document_id"), F.lit(1.0).alias("confidence"), F.lit("rule").alias("extractor"))

    entities = [ent(region, "region", "r_regionkey", "r_name"), ent(nation, "nation", "n_nationkey", "n_name"),
                ent(supplier, "supplier", "s_suppkey", "s_name"), ent(customer, "customer", "c_custkey", "c_name")]
    relations = [
        rel(nation, "n", "nation", "n_nationkey", F.lit("part of"), key("region", "n_regionkey")),
        rel(supplier, "s", "supplier", "s_suppkey", F.lit("located in"), key("nation", "s_nationkey")),
        rel(customer, "c", "customer", "c_custkey", F.lit("located in"), key("nation", "c_nationkey")),
        rel(customer, "m", "customer", "c_custkey", F.concat(F.lit("buys "), "c_mktsegment"),
            value=F.col("c_mktsegment"))]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(entities), union(relations)


HOP_SQL = f"""WITH {WORLD_SQL},
ends AS (SELECT id, s AS node FROM wrel UNION SELECT id, o FROM wrel WHERE o IS NOT NULL),
root AS (SELECT id AS query_id, id AS node FROM went WHERE type IN ('region', 'nation', 'supplier')),
h1 AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rn FROM root JOIN ends USING (node)) WHERE rn <= 120),
n1 AS (SELECT DISTINCT query_id, node FROM h1 JOIN ends USING (id) WHERE node <> query_id),
h2a AS (SELECT DISTINCT query_id, id FROM n1 JOIN ends USING (node)),
h2b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rn FROM h2a ANTI JOIN h1 USING (query_id, id)),
used AS (SELECT query_id, count(*) AS n FROM h1 GROUP BY 1),
h AS (SELECT query_id, id, 1 AS hop FROM h1 UNION ALL SELECT query_id, id, 2 FROM h2b JOIN used USING (query_id) WHERE rn <= 120 - n)
SELECT query_id, wrel.id AS rel_id, hop, s AS source, coalesce(o, 'value:' || wrel.id) AS target, coalesce(t.name, vt) AS target_name,
coalesce(t.type, 'value') AS target_type, p AS predicate FROM h JOIN wrel USING (id) LEFT JOIN went t ON t.id = o"""


@query("J3 J4", HOP_SQL)
def kg_khop(spark, sf):
    """Two-hop neighbourhood of every region, nation and supplier, found by name."""
    entities, relations = world(spark, sf)
    names = entities.filter(F.col("type") != "customer").select(F.col("id").alias("query_id"), "name")
    roots = graph.find_roots(names, entities).select("query_id", "id")
    return graph.neighbourhood(roots, entities, relations, 2, graph.NEIGHBOUR_LIMIT).drop("complete")


@query("J3 J4", f"""SELECT *, true AS complete FROM ({HOP_SQL.replace(" WHERE rn <= 120 - n", "").replace(" WHERE rn <= 120", "")})""")
def kg_khop_all(spark, sf):
    """Two-hop neighbourhood of every region, nation and supplier, whole."""
    entities, relations = world(spark, sf)
    names = entities.filter(F.col("type") != "customer").select(F.col("id").alias("query_id"), "name")
    return graph.neighbourhood(graph.find_roots(names, entities).select("query_id", "id"), entities, relations, 2)


@query("K8 P10", f"""WITH {WORLD_SQL}, q AS (SELECT n_name AS text FROM nation UNION SELECT lower(c_mktsegment) FROM customer),
eh AS (SELECT text, id, name, row_number() OVER (PARTITION BY text ORDER BY type, name, id) AS rank FROM q JOIN went ON contains(lower(name), lower(text))),
rh AS (SELECT text, wrel.id, row_number() OVER (PARTITION BY text ORDER BY wrel.id) AS rank, e.name || ' --' || p || '--> ' || coalesce(vt, '') AS label
       FROM q JOIN wrel ON contains(lower(p), lower(text)) JOIN went e ON e.id = s WHERE text NOT IN (SELECT text FROM eh))
SELECT text AS query_id, 'entity' AS mode, rank, id, name AS label FROM eh WHERE rank <= 20
UNION ALL SELECT text, 'relation', rank, id, label FROM rh WHERE rank <= 20""")
def kg_search(spark, sf):
    """Nation names find entities; market segments only find relations."""
    entities, relations = world(spark, sf)
    text = (table(spark, sf, "nation").select(F.col("n_name").alias("text"))
            .unionByName(table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("text"))).distinct())
    return graph.graph_search(text.select(F.col("text").alias("query_id"), "text"), entities, relations)


# --- enrichment -----------------------------------------------------------------------

@query("K6 F10 F12", """WITH p AS (SELECT p_partkey AS d, p_name, p_brand, p_type, p_size FROM part),
i AS (SELECT d, p_name, unnest(range(0, least(12, p_size))) AS pos, p_brand, p_type, p_size FROM p)
SELECT d AS document_id, 'skill' AS type, 'obj' || (pos % 3) AS name, sha256('spirit|' || lower(p_name)) AS subject_id,
CASE WHEN pos % 2 = 0 THEN 'evolves to' ELSE 'has effect' END AS predicate,
CASE pos % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 ELSE round(p_size / 100, 6) END AS confidence, 'seen in ' || p_brand AS evidence
FROM i WHERE pos % 5 <> 4""")
def kg_enrich_merge(spark, sf):
    """Parts rendered as fenced model answers, merged as relations."""
    item = lambda i: F.concat(
        F.lit('{"predicate": "'), F.when(i % 5 == 4, "").when(i % 2 == 0, " evolves to").otherwise("has effect；"),
        F.lit('", "object": "obj'), (i % 3).cast("string"), F.lit('", "object_type": "skill", "confidence": '),
        F.when(i % 4 == 0, "7").when(i % 4 == 1, '"high"').otherwise((F.col("p_size") / 100).cast("string")),
        F.lit(', "evidence": "seen in '), F.col("p_brand"), F.lit('"}'))
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), item), ", ")
    raw = F.concat(F.lit('```json\nHere: {"relations": ['), items, F.lit("]}\n```"))
    answers = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), "p_name", raw.alias("raw"))
    nodes, relations = kg.merge_enrichment(answers, "document_id", "p_name", "raw")
    objects = kg.upsert_entities(nodes, ["document_id", "pos"]).select(F.col("id").alias("object_id"), "type", "name")
    return relations.join(objects, "object_id").select(
        F.col("source_document_id").alias("document_id"), "type", "name", "subject_id", "predicate",
        F.round("confidence", 6).alias("confidence"), F.col("properties")["evidence"].alias("evidence"))


@query("J8 P5 O3", """SELECT doc_id AS document_id, n_chars AS created_at FROM documents
WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def pending_enrichment(spark, sf):
    """Documents of one category without a model-made relation."""
    from quarry.functions.text import in_category

    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("n_chars").alias("created_at"),
        F.concat_ws(" / ", "lang", "source").alias("group"))
    made = table(spark, sf, "labels").select(
        F.col("doc_id").alias("source_document_id"), F.when(F.col("quality") == 1, "llm").otherwise("rule").alias("extractor"))
    mine = docs.filter(in_category(F.lit(""), F.col("group"), "en"))
    return kg.pending_enrichment(mine, made).select("document_id", "created_at")
