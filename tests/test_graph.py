"""Graph operators without a limit, against the whole result, and the mark of a limit."""

import re
import uuid

from quarry.operators import graph
from quarry.registry import graph as registered
from quarry.session import cut_lineage
from tests.oracle import connect, rows_of

SF = "/root/testdata/sf0.001"


def star(spark, n):
    """A hub with n leaves, and a pair apart."""
    names = ["hub", "one", "two"] + [f"leaf{i}" for i in range(n)]
    entities = spark.createDataFrame([(x, "spirit", x, x, 7) for x in names],
                                     "id string, type string, normalized_name string, name string, source_document_id long")
    edges = [(f"r{i:03}", f"leaf{i}", "hub") for i in range(n)] + [("x", "one", "two")]
    relations = spark.createDataFrame(
        [(i, s, "in", o, None, None, None, None, 7, 1.0, "rule") for i, s, o in edges],
        "id string, subject_id string, predicate string, object_id string, value_text string, value_number double,"
        "value_min double, value_max double, source_document_id long, confidence double, extractor string")
    return entities, relations


def test_relations_of_a_hub_are_whole(spark):
    _, relations = star(spark, 200)
    queries = spark.createDataFrame([("h", "hub"), ("o", "one")], "query_id string, text string")
    matched = spark.createDataFrame([("h", "hub", 1), ("o", "one", 1)], "query_id string, id string, entity_rank int")
    count = lambda df: {(r.query_id, r.complete): r["count"] for r in df.groupBy("query_id", "complete").count().collect()}
    assert count(graph.query_relations(queries, matched, relations)) == {("h", True): 200, ("o", True): 1}
    assert count(graph.query_relations(queries, matched, relations, 80)) == {("h", False): 80, ("o", True): 1}
    assert count(graph.query_relations(queries, matched, relations, 200)) == {("h", True): 200, ("o", True): 1}


def test_neighbourhood_of_a_hub_is_whole(spark):
    entities, relations = star(spark, 200)
    roots = spark.createDataFrame([("h", "hub"), ("l", "leaf0"), ("o", "one")], "query_id string, id string")
    count = lambda limit: {(r.query_id, r.hop, r.complete): r["count"] for r in graph.neighbourhood(
        roots, entities, relations, 2, limit).groupBy("query_id", "hop", "complete").count().collect()}
    assert count(None) == {("h", 1, True): 200, ("l", 1, True): 1, ("l", 2, True): 199, ("o", 1, True): 1}
    assert count(120) == {("h", 1, False): 120, ("l", 1, False): 1, ("l", 2, False): 119, ("o", 1, True): 1}
    assert count(200) == count(None)


def test_relevance_without_limit_matches_sql_without_limit(spark):
    con = connect(SF)
    sql = registered.QUESTIONS_SQL
    whole = re.sub(r"WHERE rn <= 80", "WHERE true", sql)
    assert whole != sql
    entities, relations = registered._graph(spark, SF)
    questions = registered.part_questions(spark, SF)
    matched = cut_lineage(graph.mentions(questions, entities), "matched")
    ranked = graph.query_relations(questions, matched, relations)
    cur = con.execute(f"WITH {whole} SELECT query_id, rid AS rel_id, rank AS rel_rank FROM rk")
    got = ranked.select("query_id", "rel_id", "rel_rank")
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())
    assert ranked.filter("not complete").count() == 0


def test_facts_are_taken_from_the_texts_once(spark):
    """Relations and entities read staged facts; no plan of theirs takes facts from field rows again."""
    from quarry.operators import extraction as kg

    documents = spark.createDataFrame([(1, "精灵名称: a 1\n主属性: x\n技能: s、t\n生命: 5", "a.txt")],
                                      "document_id long, text string, filename string").selectExpr("*", "timestamp_seconds(0) AS created_at")
    entities, relations = kg.build_graph(documents, kg.mapping_table(spark))
    for table in (entities, relations):
        assert "Window" not in table._jdf.queryExecution().toString()
    assert relations.count() == 4 and entities.count() == 4


def test_document_stats_read_staged_fields_and_facts(spark):
    """The statistics join several readings of the same rows, and none parses the texts anew."""
    from quarry.registry.graph import kg_doc_stats

    stats = kg_doc_stats(spark, "/root/testdata/sf0.001")
    assert "Window" not in stats._jdf.queryExecution().toString()


def test_answers_are_parsed_once(spark):
    """Entities and relations of model answers read written items; neither parses the JSON again."""
    from quarry.operators import extraction as kg

    raw = '{"relations": [{"predicate": "p", "object": "o", "confidence": 2, "evidence": "e"}, {"predicate": "", "object": "x"}]}'
    answers = spark.createDataFrame([(1, "a", raw), (2, "b", None)], "document_id long, name string, raw string")
    nodes, relations = kg.merge_enrichment(answers, "document_id", "name", "raw")
    for table in (kg.upsert_entities(nodes, ["document_id", "pos"]), relations):
        assert "json" not in table._jdf.queryExecution().toString().lower()
    assert [(r.predicate, r.confidence) for r in relations.collect()] == [("p", 1.0)]
    assert [r.key for r in nodes.collect()] == ["o"]


def exchanged(df):
    """Rows with a column of the query that cross a shuffle of the plan."""
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_pairs_of_relations_do_not_travel(spark, monkeypatch):
    """Relevance without limits: lists of hits are shuffled, not (query, relation) pairs; ranges, blocks and ties are whole."""
    monkeypatch.setattr(graph, "QUERY_BLOCK", 2)
    monkeypatch.setattr(graph, "PART_PAIRS", 150)
    entities, relations = star(spark, 200)
    queries = spark.createDataFrame([(q, f"hub one {q}") for q in "abcde"], "query_id string, text string")
    matched = spark.createDataFrame([(q, x, r) for q in "abcde" for x, r in (("hub", 2), ("leaf7", 1), ("one", 3))],
                                    "query_id string, id string, entity_rank int")
    asked = graph.numbered(queries)
    ranked = graph.ranked_relations(asked, matched, relations, entities)
    pairs = graph.scored_pairs(ranked, asked).select("query_id", "rel_id", "rel_rank", "subject_name", "object_name")
    assert not any("query_id" in line or "q#" in line for line in exchanged(pairs))
    want = ["r007"] + [f"r{i:03}" for i in range(200) if i != 7] + ["x"]
    rows = sorted((r.query_id, r.rel_rank, r.rel_id) for r in pairs.collect())
    assert rows == [(q, i, x) for q in "abcde" for i, x in enumerate(want)]
    assert {(r.rel_id, r.subject_name, r.object_name) for r in pairs.collect()} >= {("x", "one", "two"), ("r003", "leaf3", "hub")}


def test_a_relation_without_known_subject_keeps_its_rank(spark):
    entities, relations = star(spark, 3)
    queries = spark.createDataFrame([("a", "hub")], "query_id string, text string")
    matched = spark.createDataFrame([("a", "hub", 1)], "query_id string, id string, entity_rank int")
    asked = graph.numbered(queries)
    ranked = graph.ranked_relations(asked, matched, relations, entities.filter("id <> 'leaf1'"))
    got = [(r.rel_id, r.rel_rank) for r in graph.scored_pairs(ranked, asked).orderBy("rel_rank").collect()]
    assert got == [("r000", 0), ("r002", 2)]


def test_nothing_matched_ranks_nothing(spark):
    entities, relations = star(spark, 3)
    queries = spark.createDataFrame([("a", "zz")], "query_id string, text string")
    matched = spark.createDataFrame([], "query_id string, id string, entity_rank int")
    asked = graph.numbered(queries)
    assert graph.scored_pairs(graph.ranked_relations(asked, matched, relations, entities), asked).collect() == []
    assert graph.query_relations(queries, matched, relations).collect() == []


def test_context_sums_pairs_where_their_document_is(spark):
    """Best documents without limits: no shuffle deals scored pairs, and scores equal those of all scored facts."""
    from pyspark.sql import functions as F

    entities, relations = star(spark, 30)
    relations = relations.withColumn("source_document_id", F.length("subject_id").cast("long"))
    queries = spark.createDataFrame([("a", "hub leaf3 in"), ("b", "one")], "query_id string, text string")
    matched = cut_lineage(graph.mentions(queries, entities, None), "matched")
    asked = graph.numbered(queries)
    ranked = graph.ranked_relations(asked, matched, relations, entities)
    best = graph.best_documents(ranked, asked, matched, 10)
    dealt = exchanged(best)
    assert any("document_id" in line for line in dealt) and not any(
        "query_id" in line and "document_id" in line for line in dealt)
    want = graph.document_scores(graph.scored_pairs(ranked, asked), matched)
    key = lambda df: {(r.query_id, r.document_id): round(r.kg_score, 6) for r in df.collect()}
    assert key(best) == key(want) and len(key(want)) >= 3


def test_whole_neighbourhood_of_triangles_loops_and_several_roots(spark, monkeypatch):
    """Each edge within two hops once, whatever its ends; pairs of the second hop cross no shuffle."""
    import random

    monkeypatch.setattr(graph, "EDGE_BLOCK", 3)
    pick = random.Random(3)
    nodes = [f"n{i}" for i in range(14)]
    edges = [(f"r{i:03}", pick.choice(nodes), pick.choice([*nodes, None])) for i in range(40)]
    entities = spark.createDataFrame([(x, "spirit", x, x, 7) for x in nodes],
                                     "id string, type string, normalized_name string, name string, source_document_id long")
    relations = spark.createDataFrame(
        [(i, s, "in", o, "text" if int(i[1:]) % 2 else None, None, None, None, 7, 1.0, "rule") for i, s, o in edges],
        "id string, subject_id string, predicate string, object_id string, value_text string, value_number double,"
        "value_min double, value_max double, source_document_id long, confidence double, extractor string")
    rooted = [(f"q{i}", nodes[i]) for i in range(10)] + [("q0", nodes[5]), ("q1", nodes[1]), ("none", "nowhere")]
    roots = spark.createDataFrame(rooted, "query_id string, id string")
    want = set()
    for q in {q for q, _ in rooted}:
        mine = {x for p, x in rooted if p == q}
        first = {i for i, s, o in edges if s in mine or o in mine}
        around = {x for i, s, o in edges if i in first for x in (s, o) if x}
        for i, s, o in edges:
            if (i in first or s in around or o in around) and (o or int(i[1:]) % 2):
                want.add((q, i, 1 if i in first else 2, s, o or f"value:{i}"))
    found = graph.neighbourhood(roots, entities, relations, 2)
    rows = [(r.query_id, r.rel_id, r.hop, r.source, r.target) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # What follows the join of nodes and edges neither makes pairs distinct nor shuffles them.
    plan = found._jdf.queryExecution().executedPlan().toString()
    joined = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "SortMergeJoin [node" in joined and "HashAggregate(keys=[query_id" not in joined.split("SortMergeJoin [node")[0]


def test_relevance_takes_from_a_pair_only_what_needs_both(spark):
    """Bonus by predicate and extractor stand below the pairs; the sum is that of V12."""
    assert "主属性" not in str(graph.relevance()) and "llm" not in str(graph.relevance())
    rows = spark.createDataFrame([("fire cat", "拥有技能", None, "burn", "llm", 0.5, 2)],
                                 "subject_name string, predicate string, object_name string, value_text string,"
                                 "extractor string, confidence double, rel_rank int")
    asked = spark.createDataFrame([("a", " fire burn 技能 x")], "query_id string, text string")
    got = graph._with_sides(rows).crossJoin(graph._with_terms(asked)).select(graph.relevance().alias("r")).first().r
    # Terms fire, burn, 技能 and, joined, fireburn技能x; the object stands in the query.
    assert round(got, 9) == round(1 / 1.4 + 1.4 + 0.25 + 0.35 + 0.3 + 0.45 + 0.6 + 0.025, 9)


def staged_hits(monkeypatch):
    """Sizes of the lists of hits that are staged from here on."""
    from pyspark.sql import functions as F

    sizes, stage = [], graph.cut_lineage

    def noted(df, purpose="cut"):
        out = stage(df, purpose)
        if "hits" in out.columns:
            sizes.append(out.agg(F.sum(F.size("hits"))).first()[0] or 0)
        return out

    monkeypatch.setattr(graph, "cut_lineage", noted)
    return sizes


def test_pairs_of_relations_are_not_written(spark, monkeypatch):
    """Lists of hits are staged for entities and predicates, never for relations."""
    sizes = staged_hits(monkeypatch)
    entities, relations = star(spark, 100)
    queries = spark.createDataFrame([(q, f"hub one {q}") for q in "abcde"], "query_id string, text string")
    pairs = graph.scored_mentions(queries, entities, relations)
    assert pairs.count() == 5 * 101
    assert 0 < max(sizes) < 5 * 100


def test_context_in_runs_leaves_no_pairs_behind(spark, monkeypatch, tmp_path):
    """Runs of queries give the same context as one run, and only the best documents stay on the disk."""
    from pyspark.sql import functions as F

    entities, relations = star(spark, 30)
    relations = relations.withColumn("source_document_id", F.length("subject_id").cast("long"))
    queries = spark.createDataFrame([("a", "hub leaf3 in"), ("b", "one"), ("c", "two hub"), ("d", "zz")], "query_id string, text string")
    documents = spark.createDataFrame([(i, f"{i}.txt") for i in range(9)], "document_id long, filename string")
    chunks = documents.select("document_id", F.lit(0).alias("chunk_index"), F.lit("text").alias("content"))
    rows = lambda: sorted(graph.graph_context(queries, entities, relations, chunks, documents, 2).collect())
    monkeypatch.setattr("quarry.session.shared_dir", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    want = rows()
    before = {p.name for p in tmp_path.iterdir()}
    monkeypatch.setattr(graph, "CONTEXT_PAIRS", 31)
    assert rows() == want and {r.query_id for r in want} == {"a", "b", "c"}
    kinds = lambda names: sorted(n.rsplit("-", 1)[0] for n in names)
    assert kinds(before) == ["top", "whole"]
    assert kinds({p.name for p in tmp_path.iterdir()} - before) == ["top"] * 4 + ["whole"]
