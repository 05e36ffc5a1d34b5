"""Search queries: lexical, dense, fused."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import normalize_text
from quarry.functions.vectors import hash_embedding
from quarry.operators import dense, fusion, lexical
from quarry.operators.filters import metadata_filter
from quarry.registry.catalog import query, table

# --- pieces shared by the check SQL -------------------------------------------------

WORDS = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t))"
SPARSE = r"regexp_extract_all(lower({}), '[a-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]')"


def tokens_sql(expr: str, pattern: str = WORDS) -> str:
    return pattern.format(expr)


def bm25_sql(docs: str = "documents", queries: str = "benchmark", keep: str = "", keep_on: str = "") -> str:
    """Common table expressions that end in ``scored(query_id, id, score)``."""
    return f"""
    dt AS (SELECT doc_id AS id, {tokens_sql('text')} AS toks FROM {docs}),
    dl AS (SELECT id, len(toks) AS dl FROM dt),
    tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM dt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    qt AS (SELECT item_id AS query_id, term, count(*) AS qtf
           FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM {queries}) GROUP BY ALL),
    scored AS (
      SELECT query_id, tf.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) *
             (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.id = tf.id CROSS JOIN tot
      GROUP BY query_id, tf.id)"""


def sparse_sql(docs: str = "documents", queries: str = "benchmark") -> str:
    def vec(name, src, key):
        return f"""{name} AS (
          SELECT id, term, tf * 2.5 / (tf + 1.5) * ln(1 + total / tf) AS w FROM (
            SELECT id, term, total, count(*) AS tf FROM (
              SELECT {key} AS id, unnest(toks) AS term, len(toks) AS total
              FROM (SELECT {key}, {tokens_sql('text', SPARSE)} AS toks FROM {src})) GROUP BY ALL))"""

    return f"""{vec('dv', docs, 'doc_id')}, {vec('qv', queries, 'item_id')},
    sscored AS (SELECT qv.id AS query_id, dv.id, round(sum(qv.w * dv.w), 9) AS score
                FROM qv JOIN dv USING (term) GROUP BY ALL)"""


def top_sql(src: str, k: int, by: str = "score DESC, id") -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}) AS rank FROM {src}) "
            f"WHERE rank <= {k}")


# Hashed adjacent-character counts of every text, unit length.
def hash_vec_sql(name: str, src: str, key: str) -> str:
    return rf"""{name}_n AS (
      SELECT {key} AS id, string_split(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '') AS t
      FROM {src}),
    {name}_c AS (
      SELECT id, (unicode(p[1]) * 31 + unicode(p[2])) % 256 AS b, count(*) AS n
      FROM (SELECT id, unnest(list_zip(t[:-2], t[2:])) AS p FROM {name}_n WHERE len(t) > 1) GROUP BY ALL),
    {name}_l AS (SELECT id, sqrt(sum(n * n)) AS len FROM {name}_c GROUP BY id),
    {name} AS (SELECT id, b, n / len AS w FROM {name}_c JOIN {name}_l USING (id))"""


CENTROIDS_SQL = """
    cen AS (SELECT label AS query_id, pos, avg(v) AS v FROM (
              SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
            GROUP BY ALL),
    q AS (SELECT query_id, list(v ORDER BY pos) AS vec FROM cen GROUP BY query_id),
    c AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vec FROM embeddings)"""

COSINE_SQL = CENTROIDS_SQL + """,
    cos AS (SELECT query_id, id, round(list_cosine_similarity(q.vec, c.vec), 9) + 0.0 AS score FROM q, c)"""
L2_SQL = """
    l2 AS (SELECT query_id, id, round(pow(list_distance(q.vec, c.vec), 2), 9) + 0.0 AS score FROM q, c)"""


def label_centroids(embeddings):
    """One query vector per label: the mean of its vectors."""
    parts = embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # One short array (the vector dimension) per label.
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return means.groupBy(F.col("label").alias("query_id")).agg(vec.alias("vec"))


# --- lexical ------------------------------------------------------------------------

@query("V6 A2 J12 L1", f"""WITH {bm25_sql()}, top AS ({top_sql('scored', 5)})
SELECT query_id, rank, id AS doc_id, round(score, 6) AS score, text FROM top JOIN documents ON doc_id = id""")
def bm25_topk(spark, sf):
    """Top-5 documents per benchmark text by BM25; text joined back after ranking."""
    docs = table(spark, sf, "documents")
    hits = lexical.bm25_topk(docs, table(spark, sf, "benchmark"), 5)
    return (hits.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
            .select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "text"))


@query("A2 F3", f"""WITH t AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
per AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM documents) AS n_docs, sum(n)::BIGINT AS n_tokens,
        round(sum(n) / (SELECT count(*) FROM documents), 6) AS avg_len FROM per)
SELECT term, df, n_docs, n_tokens, avg_len FROM f CROSS JOIN tot""")
def corpus_term_stats(spark, sf):
    """Document frequency of every term with corpus totals."""
    docs = table(spark, sf, "documents")
    totals = lexical.corpus_totals(docs, "text")
    return lexical.corpus_terms(docs, "doc_id", "text").select(
        "term", "df", totals.select("n_docs").scalar().alias("n_docs"),
        totals.select("n_tokens").scalar().alias("n_tokens"),
        F.round(totals.select("avg_len").scalar(), 6).alias("avg_len"))


@query("V3 F2", f"""WITH {sparse_sql()} SELECT query_id, id, rank, round(score, 6) AS score FROM ({top_sql('sscored', 5)})""")
def sparse_tf_topk(spark, sf):
    """Top-5 documents per benchmark text by sparse inner product."""
    hits = lexical.sparse_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 5)
    return hits.withColumn("score", F.round("score", 6))


@query("P1 V6", f"""WITH en AS (SELECT * FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')),
{bm25_sql('en')} SELECT query_id, id, rank, round(score, 6) AS score FROM ({top_sql('scored', 3)})""")
def metadata_filtered_search(spark, sf):
    """BM25 over the documents of one group and three sources."""
    docs = table(spark, sf, "documents").withColumn("group", F.col("lang"))
    docs = metadata_filter(docs, {"group": "en", "sources": ["src1", "src2", "src3"], "entity_name": " "})
    return lexical.bm25_topk(docs, table(spark, sf, "benchmark"), 3).withColumn("score", F.round("score", 6))


# --- dense --------------------------------------------------------------------------

def _dense_table(hits):
    return hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("V1 V17 L1", f"""WITH {COSINE_SQL} SELECT query_id, id, rank, round(score, 6) AS score FROM ({top_sql('cos', 10)})""")
def dense_cosine_topk(spark, sf):
    """Ten nearest vectors to every label centroid by cosine."""
    emb = table(spark, sf, "embeddings")
    return _dense_table(dense.dense_topk(emb, label_centroids(emb), 10, "cosine"))


@query("V2", f"""WITH {CENTROIDS_SQL}, {L2_SQL}
SELECT query_id, id, rank, round(score, 6) AS score FROM ({top_sql('l2', 10, 'score, id')})""")
def dense_l2_topk(spark, sf):
    """Ten nearest vectors to every label centroid by squared distance."""
    emb = table(spark, sf, "embeddings")
    return _dense_table(dense.dense_topk(emb, label_centroids(emb), 10, "l2"))


@query("V4")
def ivf_recall(spark, sf):
    """Recall@10 of cell search against exact search, per label centroid."""
    emb = table(spark, sf, "embeddings")
    queries = label_centroids(emb)
    exact = dense.dense_topk(emb, queries, 10).select("query_id", "id")
    index = dense.CellIndex.build(emb, n_cells=32)
    found = index.search(queries, 10, n_probe=8).select("query_id", "id")
    hit = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query("V4", f"""WITH {COSINE_SQL} SELECT query_id, id, rank, round(score, 6) AS score FROM ({top_sql('cos', 10)})""")
def ivf_all_cells(spark, sf):
    """A stored cell index, half of it added after the fit, with every cell probed: the exact list."""
    emb = table(spark, sf, "embeddings")
    first = F.pmod(F.xxhash64("vec_id"), F.lit(2)) == 0
    index = dense.CellIndex.build(emb.filter(first), n_cells=32).add(emb.filter(~first))
    return _dense_table(index.search(label_centroids(emb), 10, n_probe=32))


# --- fusion -------------------------------------------------------------------------

@query("V8 W1 O1", f"""WITH {COSINE_SQL}, {L2_SQL},
a AS ({top_sql('cos', 20)}), b AS ({top_sql('l2', 20, 'score, id')}),
u AS (SELECT query_id, id, rank, score FROM a UNION ALL SELECT query_id, id, rank, 1 - score / 2 FROM b),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS rrf, max(score) AS best, count(*) AS n_lists FROM u GROUP BY ALL)
SELECT query_id, id, rank, n_lists, round(rrf, 9) AS rrf_score, round(best, 6) AS best_score
FROM ({top_sql('f', 10, 'rrf DESC, id')})""")
def rrf_fusion(spark, sf):
    """Reciprocal-rank fusion of a cosine and a distance list."""
    emb = table(spark, sf, "embeddings")
    queries = label_centroids(emb)
    cos = dense.dense_topk(emb, queries, 20, "cosine")
    l2 = dense.dense_topk(emb, queries, 20, "l2").withColumn("score", 1 - F.col("score") / 2)
    stacked = fusion.union_lists({"cosine": cos, "l2": l2}, ["query_id", "id", "rank", "score"])
    return fusion.rrf(stacked, 10).select(
        "query_id", "id", "rank", "n_lists", F.round("rrf_score", 9).alias("rrf_score"),
        F.round("best_score", 6).alias("best_score"))


@query("V9 O2", f"""WITH {COSINE_SQL}, {L2_SQL},
a AS ({top_sql('cos', 10)}), b AS ({top_sql('l2', 10, 'score, id')}),
u AS (SELECT query_id, id, label, rank, score, 1.25 AS w, 0 AS br, 'knowledge_graph' AS src FROM a JOIN c USING (id)
      UNION ALL SELECT query_id, id, label, rank, 1 - score / 2, 1.0, 1, 'vector_bm25' FROM b JOIN c USING (id)),
k AS (SELECT *, CASE WHEN label % 2 = 0 THEN 'doc' || label ELSE id::VARCHAR END AS key FROM u),
f AS (SELECT query_id, key, round(sum(w / (60 + rank)), 12) AS rrf,
      first(id ORDER BY score DESC, br, rank) AS id, max(score) AS own,
      string_agg(DISTINCT src, '+' ORDER BY src) AS sources FROM k GROUP BY ALL)
SELECT query_id, key, id, rank, sources, round(rrf, 9) AS rrf_score, round(greatest(own, least(1.0, rrf * 20)), 6) AS score
FROM ({top_sql('f', 5, 'rrf DESC, key')})""")
def weighted_rrf(spark, sf):
    """Weighted fusion of two branches; even labels share one document id."""
    emb = table(spark, sf, "embeddings")
    queries = label_centroids(emb)
    doc = emb.select(F.col("vec_id").alias("id"),
                     F.when(F.col("label") % 2 == 0, F.concat(F.lit("doc"), F.col("label"))).alias("document_id"))
    cos = dense.dense_topk(emb, queries, 10, "cosine").join(doc, "id").withColumn("source", F.lit("knowledge_graph"))
    l2 = (dense.dense_topk(emb, queries, 10, "l2").withColumn("score", 1 - F.col("score") / 2)
          .join(doc, "id").withColumn("source", F.lit("vector_bm25")))
    return fusion.fuse_branches(cos, l2, 5).select(
        "query_id", "key", "id", "rank", F.array_join("sources", "+").alias("sources"),
        F.round("rrf_score", 9).alias("rrf_score"), F.round("score", 6).alias("score"))


def text_vectors(df, id_col):
    return df.select(F.col(id_col).alias("id"), hash_embedding(F.col("text")).alias("vec"))


def normal_texts(df, id_col):
    """As :func:`text_vectors`, for searches that embed the texts where they scan them."""
    return df.select(F.col(id_col).alias("id"), normalize_text(F.col("text")).alias("vec"))


HASH_COSINE_SQL = f"""{hash_vec_sql('dh', 'documents', 'doc_id')}, {hash_vec_sql('qh', 'benchmark', 'item_id')},
    hcos AS (SELECT q.item_id AS query_id, d.doc_id AS id, round(coalesce(s, 0), 9) AS score
             FROM (SELECT qh.id AS qid, dh.id AS did, sum(qh.w * dh.w) AS s FROM qh JOIN dh USING (b) GROUP BY ALL)
             RIGHT JOIN (benchmark q CROSS JOIN documents d) ON qid = q.item_id AND did = d.doc_id)"""


@query("V5 F6 V1 V3", f"""WITH {HASH_COSINE_SQL}, {sparse_sql()},
d AS ({top_sql('hcos', 50)}), s AS ({top_sql('sscored', 50)}),
f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id,
      round(0.7 * coalesce((1 + d.score) / 2, 0) + 0.3 * coalesce(0.5 + atan(s.score) / pi(), 0), 9) AS score
      FROM d FULL JOIN s ON d.query_id = s.query_id AND d.id = s.id)
SELECT query_id, id, rank, round(score, 6) AS score FROM ({top_sql('f', 10)})""")
def hybrid_weighted(spark, sf):
    """Dense (hash embedding) and sparse candidates fused 0.7 / 0.3."""
    return _dense_table(_hybrid(spark, sf, 50, 10))


def _hybrid(spark, sf, candidates, k):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    d = dense.dense_topk(normal_texts(docs, "doc_id"), text_vectors(bench, "item_id"), candidates,
                         "cosine", "id", "vec", "id", "vec")
    s = lexical.sparse_topk(docs, bench, candidates)
    return fusion.weighted_hybrid(d, s, k)
