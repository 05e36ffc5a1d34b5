"""Parsing, query text, citations and whole retrieval plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import parsing as ps, text as tx
from quarry.functions.vectors import hash_embedding
from quarry.operators import context, dense, fusion, lexical
from quarry.operators.ranking import top_k
from quarry.plans import retrieval as plan
from quarry.plans.scoring import score_in_batches
from quarry.registry.catalog import query, table
from quarry.registry.search import HASH_COSINE_SQL, bm25_sql, normal_texts, top_sql
from quarry.session import cut_lineage


@query("P11", r"""WITH k AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+|[a-zA-Z0-9]+'), lambda t: length(t) > 1
AND lower(t) NOT IN ('什么', '怎么', '如何', '为什么', '多少', '哪些', '哪个', '可以', '帮我', '请问', '一下', '这个')) AS ks FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(ks[1:8], ' ') AS keywords FROM k""")
def query_keywords(spark, sf):
    """First eight keywords of every user message."""
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(tx.keywords(F.col("text")), " ").alias("keywords"))


@query("F4 F1", r"""WITH n AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\{\{[^}]+\}\}', '', 'g'), '''''''', ''), '^\s+|\s+$', '', 'g'),
 '^[|=：:，,;；]+|[|=：:，,;；]+$', '', 'g'), '\s+', ' ', 'g') AS t FROM (SELECT conv_id, turn, '|' || text || ' {{x}} :' AS text FROM conversations WHERE role = 'user')),
m AS (SELECT conv_id, turn, t, list_append(regexp_extract_all(t, '[\p{L}\p{N}_]+'), regexp_replace(t, '[^\p{L}\p{N}_]+', '', 'g')) AS ts FROM n)
SELECT conv_id, turn, md5(t) AS name_digest, (SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(ts) AS x, generate_subscripts(ts, 1) AS i) WHERE x <> '' GROUP BY x)) AS terms FROM m""")
def query_terms(spark, sf):
    """Normalised text and ordered distinct terms of every user message."""
    c = table(spark, sf, "conversations").filter("role = 'user'")
    c = c.select("conv_id", "turn", tx.normalize_name(F.concat(F.lit("|"), "text", F.lit(" {{x}} :"))).alias("t"))
    return c.select("conv_id", "turn", F.md5("t").alias("name_digest"),
                    F.array_join(tx.query_terms(F.col("t")), " ").alias("terms"))


# --- model output ---------------------------------------------------------------------

@query("F10", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_id % 3 <> 2 AS parsed FROM events""")
def json_lenient(spark, sf):
    """Event properties wrapped in fences or prose; every third is broken."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    raw = (F.when(F.col("event_id") % 3 == 0, fenced)
           .when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done")))
           .otherwise(F.concat(F.lit("{broken "), "event_type")))
    obj = ps.json_object(raw)
    return table(spark, sf, "events").select("event_id", ps.json_field(obj, "k").alias("k"), obj.isNotNull().alias("parsed"))


@query("F11 F12 F13 F14", r"""WITH a AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations WHERE role = 'assistant'),
s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '[。；;]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM a)
SELECT conv_id, turn, least(1.0, n / 100) AS score, CASE turn % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'not at all' WHEN 2 THEN 'yes' ELSE 'yes' END AS label,
turn % 4 <> 3 AS parsed, CASE turn % 3 WHEN 0 THEN 'a|' || n WHEN 1 THEN 'first point|second point' ELSE '' END AS list,
CASE WHEN len(parts) > 0 THEN md5(array_to_string(list_transform(parts, lambda x: x || '。'), '|')) ELSE md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) END AS claims FROM s""")
def judge_parse(spark, sf):
    """Assistant messages rendered as judge answers: number, label, list, claims."""
    a = table(spark, sf, "conversations").filter("role = 'assistant'")
    n = F.length("text").cast("string")
    score = F.concat(F.lit("Score: "), (F.length("text") / 100).cast("string"), F.lit("/1"))
    t4, t3 = F.col("turn") % 4, F.col("turn") % 3
    raw = F.when(t4 == 0, " NO ").when(t4 == 1, "it is Not At All so").when(t4 == 2, "Yes.").otherwise("hm")
    listed = (F.when(t3 == 0, F.concat(F.lit('here ["a", '), n, F.lit("] end")))
              .when(t3 == 1, "1. first point\n- second point\nx").otherwise("1. only one point"))
    label = ps.best_label(raw, ["yes", "no", "not at all"])
    return a.select(
        "conv_id", "turn", ps.number_or(score, low=0.0, high=1.0).alias("score"), label["label"].alias("label"),
        label["parsed"].alias("parsed"), F.array_join(ps.json_string_list(listed), "|").alias("list"),
        F.md5(F.array_join(ps.sentence_claims(F.col("text")), "|")).alias("claims"))


def transcripts(spark, sf):
    """Messages rendered as agent steps."""
    t = F.col("turn") % 4
    head = F.concat(F.lit("Thought: consider "), F.col("conv_id").cast("string"))
    raw = (F.when(t == 0, F.concat(head, F.lit("\nAction: search\nAction Input: {\"q\": {\"n\": "), F.col("turn").cast("string"), F.lit("}}\n")))
           .when(t == 1, F.concat(head, F.lit("\nfinal answer: "), "text"))
           .when(t == 2, F.concat(head, F.lit("\nAction: calc\nAction Input: {bad}")))
           .otherwise(F.concat(F.lit("action: look\nAction Input: 12\n\nrest "), "role")))
    return table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))


@query("F15", r"""SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN 'consider ' || conv_id END AS thought, CASE turn % 4 WHEN 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END AS final_answer,
turn % 4 = 1 AS done, CASE turn % 4 WHEN 0 THEN 'search' WHEN 2 THEN 'calc' WHEN 3 THEN 'look' END AS action,
CASE turn % 4 WHEN 0 THEN '{"q": {"n": ' || turn || '}}' WHEN 2 THEN '{}' WHEN 3 THEN '12' END AS action_input, CASE turn % 4 WHEN 2 THEN 'Action Input 不是合法 JSON' END AS parse_error FROM conversations""")
def transcript_fields(spark, sf):
    """Fields of rendered agent steps."""
    return transcripts(spark, sf).select("conv_id", "turn", ps.transcript_fields(F.col("raw")).alias("f")).select("conv_id", "turn", "f.*")


@query("F16", """WITH i AS (SELECT conv_id, turn, role, length(text) AS n, unnest(range(0, 1 + turn % 3)) AS pos FROM conversations)
SELECT conv_id, turn, pos::INT AS pos, CASE WHEN pos = 1 THEN 'task_1' ELSE 't' || pos END AS id, CASE WHEN pos = 0 THEN role ELSE '' END AS title,
'' AS description, CASE WHEN pos = 2 THEN 'tool_call' ELSE 'reasoning' END AS action_type, CASE WHEN pos = 2 THEN 'len' || n END AS tool_name FROM i""")
def plan_rows(spark, sf):
    """Sub-tasks of rendered plans."""
    first = F.concat(F.lit('{"id": "t0", "title": "'), "role", F.lit('"}'))
    third = F.concat(F.lit('{"id": "t2", "action_type": "TOOL_CALL", "tool_name": "len'), F.length("text").cast("string"), F.lit('"}'))
    items = F.slice(F.array(first, F.lit("{}"), third), 1, (F.col("turn") % 3 + 1).cast("int"))
    raw = F.concat(F.lit('Plan:\n{"subtasks": ["note", '), F.array_join(items, ", "), F.lit("]}"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return ps.plan_rows(c, "raw", "conv_id", "turn")


@query("F17", """WITH r AS (SELECT doc_id, quality, toxic, doc_id % 4 AS m, doc_id % 130 AS q FROM labels)
SELECT doc_id, CASE WHEN m = 3 THEN 50 ELSE least(100, q) END::INT AS quality, m <> 3 AND quality = 1 AS complete, m <> 3 AND toxic = 1 AS hallucination,
CASE WHEN m = 3 THEN 50 ELSE least(100, q) END < 60 AS warn, (m = 3 OR quality = 0 OR toxic = 1) AS retry, m = 3 AS parse_error FROM r""")
def review_flags(spark, sf):
    """Review decisions from labels rendered as review answers."""
    flag = lambda c: F.when(F.col(c) == 1, "true").otherwise("false")
    js = F.concat(F.lit('{"quality_score": '), (F.col("doc_id") % 130).cast("string"), F.lit(', "is_complete": '), flag("quality"),
                  F.lit(', "likely_hallucination": '), flag("toxic"), F.lit("}"))
    raw = F.when(F.col("doc_id") % 4 == 3, "no json").when(F.col("doc_id") % 4 == 2, F.concat(F.lit("ok "), js)).otherwise(js)
    return table(spark, sf, "labels").select("doc_id", ps.review_flags(raw).alias("f")).select("doc_id", "f.*")


# --- contexts and citations -----------------------------------------------------------

def _hits(spark, sf, k=5):
    docs = table(spark, sf, "documents")
    # Staged hits have a known size: where they are few, they travel to the texts and no text is shuffled.
    hits = cut_lineage(lexical.bm25_topk(docs, table(spark, sf, "benchmark"), k), "hits")
    return hits.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")


HITS_SQL = f"{bm25_sql()}, hits AS (SELECT t.*, d.text AS content FROM ({top_sql('scored', 5)}) t JOIN documents d ON d.doc_id = t.id)"


@query("F21", f"""WITH {HITS_SQL} SELECT query_id, string_agg('[' || rank || '] ' || substr(content, 1, 500), chr(10) || chr(10) ORDER BY rank) AS chat,
string_agg(substr(content, 1, 300), chr(10) ORDER BY rank) AS eval, md5(string_agg('[' || rank || '] (id=' || id || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS prompt,
string_agg('[' || rank || '] (相关度=' || printf('%.2f', score) || ')' || chr(10) || substr(content, 1, 300), chr(10) || chr(10) ORDER BY rank) AS tool FROM hits GROUP BY 1""")
def context_blocks(spark, sf):
    """Context blocks of the five BM25 hits in all four styles."""
    out = context.context_blocks(_hits(spark, sf), "chat", "eval", "tool", "prompt")
    return out.withColumn("prompt", F.md5("prompt"))


@query("J11", f"""WITH {HITS_SQL}, m AS (SELECT item_id AS query_id, [3, item_id % 7, 1, 99] AS ns FROM benchmark),
d AS (SELECT query_id, min(i) AS i, n FROM (SELECT query_id, unnest(ns) AS n, generate_subscripts(ns, 1) AS i FROM m) GROUP BY query_id, n),
p AS (SELECT query_id, n, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS pos FROM d)
SELECT query_id, pos::INT AS pos, n::INT AS index, id, substr(content, 1, 200) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END AS snippet
FROM p JOIN hits USING (query_id) WHERE hits.rank = n""")
def citations(spark, sf):
    """Citations of rendered answers over the BM25 hits."""
    n = (F.col("item_id") % 7).cast("string")
    answer = F.concat(F.lit("see [3], ["), n, F.lit("] and [1] but not [99] or [x] [3]"))
    answers = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), answer.alias("answer"))
    return context.citations(answers, _hits(spark, sf))


# --- retrieval plans ------------------------------------------------------------------

def bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def keyword_search(spark, sf):
    index = lexical.bm25_index(table(spark, sf, "documents"))
    return lambda q, k: lexical.bm25_topk(index, q, k, query_id="query_id")


def vector_search(spark, sf):
    docs = normal_texts(table(spark, sf, "documents"), "doc_id")
    return lambda q, k: dense.dense_topk(docs, q.select("query_id", hash_embedding(F.col("text")).alias("vec")), k,
                                         "cosine", "id", "vec", "query_id", "vec")


@query("V7 V8", f"""WITH {HASH_COSINE_SQL}, {bm25_sql()}, v AS ({top_sql('hcos', 5)}), k AS ({top_sql('scored', 5)}),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, id, rank FROM v UNION ALL SELECT query_id, id, rank FROM k) GROUP BY ALL),
h AS ({top_sql('f', 5)})
SELECT 'hybrid' AS mode, query_id, id, rank, round(score, 6) AS score FROM h UNION ALL SELECT 'vector', query_id, id, rank, round(score, 6) FROM v
UNION ALL SELECT 'keyword', query_id, id, rank, round(score, 6) FROM k""")
def mode_switch(spark, sf):
    """The three retrieval modes side by side."""
    q = bench_queries(spark, sf)
    # Each list is made once and read by the modes that need it.
    v = cut_lineage(vector_search(spark, sf)(q, 5), "vector-hits")
    k = cut_lineage(keyword_search(spark, sf)(q, 5), "keyword-hits")
    run = lambda mode: plan.retrieve(q, lambda *_: v, lambda *_: k, mode, 5).select(
        F.lit(mode).alias("mode"), "query_id", "id", "rank", F.round("score", 6).alias("score"))
    return run("hybrid").unionByName(run("vector")).unionByName(run("keyword"))


VARIANTS_SQL = r"""vq AS (SELECT item_id, 'o' AS v, text FROM benchmark UNION ALL SELECT item_id, 'r', 'the ' || text FROM benchmark
    UNION ALL SELECT item_id, 'h', substr(text || ' ' || text, 1, 200) FROM benchmark
    UNION ALL SELECT item_id, 'k', array_to_string(list_filter(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+|[a-zA-Z0-9]+'), lambda t: length(t) > 1)[1:8], ' ') FROM benchmark),
  vb AS (SELECT item_id || v AS item_id, text FROM vq WHERE text <> '')"""
MULTI_SQL = f"""{VARIANTS_SQL}, {bm25_sql(queries='vb')}, hv AS ({top_sql('scored', 15)}),
  f AS (SELECT regexp_replace(query_id, '[a-z]$', '')::BIGINT AS query_id, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, max(score) AS score FROM hv GROUP BY ALL),
  fused AS ({top_sql('f', 15, 'rrf DESC, id')})"""


def variant_queries(spark, sf):
    return bench_queries(spark, sf).select(
        "query_id", "text", F.concat(F.lit(" the "), "text").alias("rewritten"),
        F.concat_ws(" ", "text", "text").alias("hypothetical"))


@query("V10 L6 P11", f"""WITH {MULTI_SQL} SELECT query_id, id, rank, round(rrf, 9) AS rrf_score, round(score, 6) AS score FROM fused WHERE rank <= 5""")
def multi_query(spark, sf):
    """Original, rewritten, hypothetical and keyword variants searched in one job."""
    out = plan.multi_query(variant_queries(spark, sf), keyword_search(spark, sf), 5)
    return out.select("query_id", "id", "rank", F.round("rrf_score", 9).alias("rrf_score"), F.round("score", 6).alias("score"))


@query("V11 V16 P4 U2", f"""WITH {MULTI_SQL}, n AS (SELECT query_id, count(*) AS n FROM fused GROUP BY 1),
r AS (SELECT fused.query_id, fused.id, CASE WHEN n <= 5 THEN score ELSE coalesce(greatest(0, 1 - (id % 40) / 20) FILTER_HERE, score) END AS final_score FROM fused JOIN n USING (query_id))
SELECT query_id, id, rank, round(final_score, 6) AS final_score FROM ({top_sql('r', 5, 'final_score DESC, id')}) WHERE final_score >= 0.15""".replace(
    "coalesce(greatest(0, 1 - (id % 40) / 20) FILTER_HERE, score)", "CASE WHEN id % 3 = 0 THEN score ELSE greatest(0, 1 - (id % 40) / 20) END"))
def rerank_join(spark, sf):
    """Fused hits reordered by an external score; every third document has none."""
    q = variant_queries(spark, sf)
    given = table(spark, sf, "documents").filter("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("id"), fusion.distance_score((F.col("doc_id") % 40) / 10).alias("rerank_score"))
    score = lambda hits: hits.select("query_id", "id").join(given, "id")
    fused = plan.multi_query(q, keyword_search(spark, sf), 5, score)
    out = fusion.min_score(fused.withColumn("score", F.col("final_score")))
    return out.select("query_id", "id", "rank", F.round("final_score", 6).alias("final_score"))


PLAN_SQL = f"""{bm25_sql()}, g0 AS (SELECT item_id AS query_id, doc_id AS id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY quality DESC, toxic, doc_id) AS rank
    FROM benchmark b JOIN (SELECT doc_id, quality, toxic, doc_id % 60 AS k FROM labels) l ON l.k = b.item_id),
  plan AS (SELECT query_id, doc_id FROM g0 WHERE rank <= 8),
  ins AS (SELECT scored.* FROM scored SEMI JOIN plan ON plan.query_id = scored.query_id AND plan.doc_id = scored.id),
  pl AS (SELECT *, true AS planned FROM ({top_sql('ins', 5)})),
  rest AS (SELECT * FROM scored WHERE query_id NOT IN (SELECT query_id FROM pl)),
  vec AS (SELECT * FROM pl UNION ALL SELECT *, false FROM ({top_sql('rest', 5)}))"""


def planned_hits(spark, sf):
    """Graph hits: the labelled documents whose id leaves the query's id modulo 60."""
    labels = table(spark, sf, "labels").withColumn("query_id", F.col("doc_id") % 60)
    hits = labels.join(bench_queries(spark, sf).select("query_id"), "query_id").select(
        "query_id", F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), "quality", "toxic")
    ranked = top_k(hits, ["query_id"], [F.col("quality").desc(), F.col("toxic"), F.col("id")], 50)
    return ranked.withColumn("score", 1.0 / F.col("rank"))


def _planned(spark, sf, k=5):
    """Planned BM25 hits; one pass over the documents for the index, one for the planned ones."""
    docs, queries = table(spark, sf, "documents"), bench_queries(spark, sf)
    index = lexical.bm25_index(docs)
    of = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"))
    return plan.planned_search(
        queries, plan.planned_documents(planned_hits(spark, sf)), of, lambda pairs: lexical.bm25_pairs(index, docs, pairs, queries),
        lambda q, n: lexical.bm25_topk(index, q, n, query_id="query_id"), k)


@query("J5 V6", f"""WITH {PLAN_SQL} SELECT query_id, id, rank, planned, round(score, 6) AS score FROM vec""")
def planned_filter_search(spark, sf):
    """BM25 restricted to planned documents, unrestricted where that finds nothing."""
    return _planned(spark, sf).select("query_id", "id", "rank", "planned", F.round("score", 6).alias("score"))


@query("V15 J5 V9", f"""WITH {PLAN_SQL}, u AS (SELECT query_id, id, rank, 1.25 AS w, 1.0 / rank AS score, 0 AS br, 'knowledge_graph' AS src FROM g0 WHERE rank <= 5
  UNION ALL SELECT query_id, id, rank, 1.0, score, 1, 'vector_bm25' FROM vec),
f AS (SELECT query_id, id::VARCHAR AS key, round(sum(w / (60 + rank)), 12) AS rrf, max(score) AS own, string_agg(src, '+' ORDER BY br) AS sources FROM u GROUP BY ALL)
SELECT query_id, key, rank, sources, round(rrf, 9) AS rrf_score, round(greatest(own, least(1.0, rrf * 20)), 6) AS score FROM ({top_sql('f', 5, 'rrf DESC, key')})""")
def graph_hybrid(spark, sf):
    """Graph branch fused with the planned vector branch."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"))
    out = plan.graph_hybrid(planned_hits(spark, sf), _planned(spark, sf), documents, 5)
    return out.select("query_id", "key", "rank", F.array_join("sources", "+").alias("sources"),
                      F.round("rrf_score", 9).alias("rrf_score"), F.round("score", 6).alias("score"))


# --- batched model calls --------------------------------------------------------------

def _length_scorer():
    """Stands in for a model: share of letters per text."""
    return lambda part: [round(sum(c.isalpha() for c in t) / max(1, len(t)), 6) for t in part["text"]]


@query("U1 U4", r"""SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text), 6) AS share FROM documents""")
def batched_scoring(spark, sf):
    """Share of letters per document by a batched scorer."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return score_in_batches(d, _length_scorer, ["text"], "share", "double", 32, 0.0).select("doc_id", "share")
