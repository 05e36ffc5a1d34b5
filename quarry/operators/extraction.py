"""Text table to triples: fields, facts, entities, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.parsing import clamped_float, json_items, json_object, json_strings
from quarry.functions.rows import unnest
from quarry.functions.text import (first_number, lines, name_key, normalize_name, number_range, number_text, split_items,
                                   strip)
from quarry.operators.ranking import first_rows, ordered_texts
from quarry.session import cut_lineage

SUBJECT_TYPE = "spirit"
NAME_LABEL = "精灵名称"
CONTINUED = ("精灵描述", "特性描述", "进化条件", "图鉴课题")
SKIPPED_PREFIX = "分类"

# Field label, predicate (property name for numbers and texts), object type, kind.
FIELD_MAPPING = (
    ("生命", "life", None, "number"),
    ("物攻", "physical_attack", None, "number"),
    ("魔攻", "magic_attack", None, "number"),
    ("物防", "physical_defense", None, "number"),
    ("魔防", "magic_defense", None, "number"),
    ("速度", "speed", None, "number"),
    ("主属性", "主属性", "attribute", "entity"),
    ("2属性", "副属性", "attribute", "entity"),
    ("属性", "属性", "attribute", "entity"),
    ("精灵阶段", "精灵阶段", "stage", "entity"),
    ("精灵形态", "精灵形态", "form", "entity"),
    ("分布地区", "分布地区", "region", "entity"),
    ("精灵类型", "精灵类型", "spirit_type", "entity"),
    ("地区形态名称", "地区形态名称", "form", "entity"),
    ("技能", "拥有技能", "skill", "entity"),
    ("血脉技能", "拥有血脉技能", "bloodline_skill", "entity"),
    ("可学技能石", "可学技能石", "skill_stone", "entity"),
    ("图鉴课题", "图鉴课题", "task", "entity"),
    ("技能解锁等级", "技能解锁等级", "level", "entity"),
    ("体型", "体型", None, "range"),
    ("重量", "重量", None, "range"),
    ("是否有异色", "是否有异色", None, "literal"),
    ("更新版本", "更新版本", None, "literal"),
    ("宠物立绘形态", "宠物立绘形态", None, "literal"),
    ("特性描述", "feature_description", None, "text"),
    ("精灵描述", "spirit_description", None, "text"),
    ("进化条件", "evolution_condition", None, "text"),
)


def mapping_table(spark: SparkSession, mapping=FIELD_MAPPING) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(mapping)]
    return spark.createDataFrame(rows, "field_no int, key string, predicate string, object_type string, kind string")


FIELD_LINE = r"^([^:：]{1,24})[:：]\s*(.*)$"
# Marks put before a field line and before a line that continues it.
RECORD, TAIL = "\u0001", "\u0002"


def _records(text: Column) -> Column:
    """Field lines, each with the lines below it that are no fields.

    The first element holds the lines above the first field.
    """
    hidden = lambda s: normalize_name(F.regexp_extract(s, FIELD_LINE, 1)).startswith(SKIPPED_PREFIX)
    kept = F.filter(F.transform(lines(text), strip), lambda s: (s != "") & ~s.startswith("<")
                    & ~s.startswith("[[File:") & ~hidden(s))
    marked = F.transform(kept, lambda s: F.concat(F.when(s.rlike(FIELD_LINE), RECORD).otherwise(TAIL), s))
    return F.split(F.array_join(marked, ""), RECORD)


def _pairs(parts: Column) -> Column:
    """(key, value) of every ``k=v`` part whose sides are not empty."""
    def pair(p):
        kv = F.split(p, "=", 2)
        return F.struct(normalize_name(kv[0]).alias("key"), normalize_name(kv[1]).alias("value"))

    return F.filter(F.transform(F.filter(parts, lambda p: p.contains("=")), pair),
                    lambda e: (e["key"] != "") & (e["value"] != ""))


def field_values(df: DataFrame, id_col: str, text_col: str, filename_col: str) -> DataFrame:
    """Rows (document_id, title, seq, key, value) of ``key: value`` text (K1).

    Texts are cut into records in place and exploded; nothing is shuffled.
    Every document also yields one row without a key.
    """
    text = F.col(text_col)
    heading = F.get(F.filter(F.transform(lines(text), strip), lambda s: s.startswith("#")), F.lit(0))
    stem = F.regexp_replace(F.regexp_replace(F.col(filename_col), r"^[0-9a-fA-F-]{36}_", ""), r"\.[^.]+$", "")
    title = F.when(heading.isNotNull(), normalize_name(F.regexp_replace(heading, "^#+", ""))).otherwise(
        F.coalesce(normalize_name(stem), F.lit("")))
    # The title is computed below the explode, once per document.
    rows = df.select(F.col(id_col).alias("document_id"), title.alias("title"), text.alias("text"))
    rows = unnest(rows, _records(F.col("text")), "record", "i", ["document_id", "title"])
    part = F.split("record", TAIL)
    rows = rows.select(
        "document_id", "title", "i", normalize_name(F.regexp_extract(part[0], FIELD_LINE, 1)).alias("key"),
        strip(F.regexp_extract(part[0], FIELD_LINE, 2)).alias("raw"), F.slice(part, 2, F.size(part)).alias("tail"))
    whole = F.when(F.col("key").isin(*CONTINUED), F.aggregate(
        "tail", normalize_name(F.col("raw")), lambda acc, s: normalize_name(F.concat(acc, F.lit("\n"), s)))
    ).otherwise(normalize_name(F.col("raw")))
    none = F.lit(None).cast("string")
    entries = (F.when(F.col("i") == 0, F.array(F.struct(none.alias("key"), none.alias("value"))))
               .when(F.col("raw").startswith("|") & F.col("raw").contains("="), _pairs(F.split("raw", r"\|")))
               .otherwise(F.array(F.struct("key", whole.alias("value")))))
    rows = unnest(rows, entries, "e", "j", ["document_id", "title", "i"])
    rows = rows.select("document_id", "title", "i", "j", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    # "a|k=v" keeps its head under the key and hands the pairs on, after all own values.
    parts = F.split("value", r"\|")
    head = F.array(F.struct("key", normalize_name(parts[0]).alias("value")))
    mixed = F.when(F.col("value").contains("|") & F.col("value").contains("="), F.concat(
        F.when(strip(parts[0]) != "", head).otherwise(F.slice(head, 1, 0)),
        _pairs(F.slice(parts, 2, F.size(parts))))).otherwise(F.array(F.struct("key", "value")))
    rows = unnest(rows, mixed, "e", "p", ["document_id", "title", "i", "j", F.col("key").alias("own_key")])
    moved = F.coalesce((F.col("e.key") != F.col("own_key")) | (F.col("p") > 0), F.lit(False))
    return rows.select("document_id", "title", F.struct(moved.alias("moved"), "i", "j", "p").alias("seq"),
                       F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def field_rows(df: DataFrame, id_col: str, text_col: str, filename_col: str) -> DataFrame:
    """Non-empty field values with subject and a first-of-its-key flag (K1, K2).

    Subject: the name field, else the first heading, else the file name.  Both
    windows share one shuffle by document.
    """
    rows = field_values(df, id_col, text_col, filename_col).filter("key IS NULL OR value <> ''")
    doc = W.partitionBy("document_id")
    named = F.min_by(F.col("value"), F.when(F.col("key") == NAME_LABEL, F.col("seq"))).over(doc)
    rows = rows.withColumn("subject", F.coalesce(named, "title"))
    at = F.row_number().over(W.partitionBy("document_id", "key").orderBy("seq"))
    return rows.withColumn("first_of_key", at == 1).drop("title")


def extract_facts(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts of the field rows, first of equal ones per document (K3, A4)."""
    r = rows.filter("subject <> ''").join(F.broadcast(mapping), "key")  # the mapping is a fixed table
    single = (F.col("kind") == "entity") | F.col("first_of_key")
    r = r.filter(single & (F.col("kind") != "text"))
    items = F.when(F.col("kind") == "entity", F.filter(split_items(F.col("value")),
                                                       lambda s: (s != "-") & ~s.contains("="))
                   ).otherwise(F.array(F.lit(None).cast("string")))
    r = unnest(r, items, "object", "item_no")
    kind = F.col("kind")
    span = number_range(F.col("value"))
    facts = r.select(
        "document_id", "subject", name_key(F.col("subject")).alias("subject_key"),
        F.when(kind == "number", F.col("key")).otherwise(F.col("predicate")).alias("predicate"),
        "object_type", "object", name_key(F.col("object")).alias("object_key"),
        F.when(kind != "entity", F.col("value")).alias("value_text"),
        F.when(kind == "number", first_number(F.col("value"))).alias("value_number"),
        F.when(kind == "range", span["low"]).alias("value_min"),
        F.when(kind == "range", span["high"]).alias("value_max"),
        F.when(kind == "number", F.col("predicate")).when(kind != "entity", F.col("key")).alias("property"),
        "kind", F.struct("field_no", "seq", "item_no").alias("seq"))
    facts = facts.filter((F.col("kind") != "number") | F.col("value_number").isNotNull())
    return first_rows(facts, ["document_id", "predicate", "object_type", "object_key", "value_text",
                              "value_number", "value_min", "value_max"], [F.col("seq")])


def text_candidates(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Free-text fields left for later enrichment (K4)."""
    r = rows.filter("subject <> ''").join(F.broadcast(mapping.filter("kind = 'text'")), "key")
    return r.groupBy("document_id", "subject", F.col("predicate").alias("field")).agg(
        strip(F.array_join(ordered_texts(F.col("seq"), F.col("value")), "\n")).alias("text"))


def entity_id(type_: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", type_, key), 256)


def document_nodes(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(document_id, type, key, name, properties) of every document (K3)."""
    subjects = rows.filter("key IS NULL AND subject <> ''").select("document_id", "subject")
    prop = F.when(F.col("kind") == "number", number_text(F.col("value_number"))).otherwise(F.col("value_text"))
    props = (facts.filter(F.col("property").isNotNull()).select("document_id", "property", prop.alias("v"))
             .groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
                 F.struct("property", "v")))).alias("properties")))
    top = subjects.join(props, "document_id", "left").select(
        "document_id", F.lit(SUBJECT_TYPE).alias("type"), name_key(F.col("subject")).alias("key"),
        F.col("subject").alias("name"),
        F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))
    objects = (facts.filter(F.col("object").isNotNull())
               .groupBy("document_id", F.col("object_type").alias("type"), F.col("object_key").alias("key"))
               .agg(F.min_by("object", "seq").alias("name"))
               .withColumn("properties", F.create_map().cast("map<string,string>")))
    return top.unionByName(objects)


def upsert_entities(nodes: DataFrame, seq: list[str]) -> DataFrame:
    """One entity per (type, key) from node rows in ``seq`` order (A3).

    The last name wins, later properties overwrite earlier ones, the first
    source document stays.  All three are aggregates with map-side partials,
    so an entity found in a third of the documents costs no more than others.
    """
    order = F.struct(*seq)
    core = nodes.groupBy("type", "key").agg(
        F.max_by("name", order).alias("name"),
        F.min_by("source_document_id", F.when(F.col("source_document_id").isNotNull(), order)).alias("source_document_id"))
    props = (nodes.select("type", "key", order.alias("_seq"), F.explode("properties").alias("p", "v"))
             .groupBy("type", "key", "p").agg(F.max_by("v", "_seq").alias("v"))
             .groupBy("type", "key").agg(F.map_from_entries(F.array_sort(
                 F.collect_list(F.struct("p", "v")))).alias("properties")))
    return core.join(props, ["type", "key"], "left").select(
        entity_id(F.col("type"), F.col("key")).alias("id"), "type", F.col("key").alias("normalized_name"), "name",
        F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
        "source_document_id")


def condense_nodes(nodes: DataFrame, seq: list[str]) -> DataFrame:
    """Node rows that give the same entities as ``nodes``, with any other rows besides.

    Of each (type, key) its first and its last row stay, and of each property
    the row that sets it last, with that property alone.
    """
    order, columns = F.struct(*seq), [c for c in nodes.columns if c not in ("type", "key", "properties")]
    row = F.struct(*columns)
    ends = nodes.groupBy("type", "key").agg(
        F.max_by(row, order).alias("last"),
        F.min_by(row, F.when(F.col("source_document_id").isNotNull(), order)).alias("first"))
    ends = ends.select("type", "key", F.explode(F.array_distinct(F.array("last", "first"))).alias("row")).filter("row is not null")
    bare = ends.select("type", "key", "row.*", F.create_map().cast("map<string,string>").alias("properties"))
    props = nodes.select("type", "key", row.alias("row"), order.alias("_seq"), F.explode("properties").alias("p", "v"))
    props = props.groupBy("type", "key", "p").agg(F.max_by(F.struct("row", "v"), "_seq").alias("set"))
    return bare.unionByName(props.select("type", "key", "set.row.*", F.create_map("p", "set.v").alias("properties")))


RELATION_COLUMNS = ["id", "subject_id", "predicate", "object_id", "value_text", "value_number", "value_min",
                    "value_max", "properties", "source_document_id", "source_chunk_id", "confidence", "extractor"]


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("|", document_id.cast("string"), index.cast("string")), 256)


def relation_table(facts: DataFrame) -> DataFrame:
    """Relations with provenance from deduplicated facts (K5)."""
    blank_if_null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    subject = entity_id(F.lit(SUBJECT_TYPE), F.col("subject_key"))
    obj = F.when(F.col("object").isNotNull(), entity_id(F.col("object_type"), F.col("object_key")))
    rel = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), subject, F.col("predicate"),
                             F.coalesce(obj, F.lit("")), blank_if_null("value_text")), 256)
    return facts.select(
        rel.alias("id"), subject.alias("subject_id"), "predicate", obj.alias("object_id"), "value_text",
        "value_number", "value_min", "value_max", F.create_map().cast("map<string,string>").alias("properties"),
        F.col("document_id").alias("source_document_id"),
        chunk_id(F.col("document_id"), F.lit(0)).alias("source_chunk_id"),
        F.lit(1.0).alias("confidence"), F.lit("rule").alias("extractor"))


def document_text(chunks: DataFrame) -> DataFrame:
    """Document text joined from its chunks in order."""
    return chunks.groupBy("document_id").agg(
        F.array_join(ordered_texts(F.col("chunk_index"), F.col("content")), "\n").alias("text"))


def build_graph(documents: DataFrame, mapping: DataFrame, created_col: str = "created_at"):
    """(entities, relations) of a document table (K5).

    ``documents`` has (document_id, text, filename, created_at).  The field
    rows and the facts are written once to the shared folder: entities,
    properties and relations all read them, and texts are parsed and facts
    taken from them a single time.
    """
    rows = cut_lineage(field_rows(documents, "document_id", "text", "filename"), "fields")
    facts = cut_lineage(extract_facts(rows, mapping), "facts")
    nodes = document_nodes(rows, facts).join(documents.select("document_id", created_col), "document_id")
    nodes = nodes.withColumn("source_document_id", F.col("document_id"))
    return upsert_entities(nodes, [created_col, "document_id"]), relation_table(facts)


def store_graph(entities: DataFrame, relations: DataFrame):
    """Write both tables once (clear and rebuild) and read them back (K5)."""
    return cut_lineage(entities, "entities"), cut_lineage(relations, "relations")


def document_stats(rows: DataFrame, facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities, relations and candidate fields per document."""
    nodes = document_nodes(rows, facts).groupBy("document_id").agg(F.count("*").alias("entities"))
    rels = facts.groupBy("document_id").agg(F.count("*").alias("relations"))
    texts = candidates.groupBy("document_id").agg(F.array_sort(F.collect_set("field")).alias("candidate_fields"))
    return (nodes.join(rels, "document_id", "left").join(texts, "document_id", "left").select(
        "document_id", "entities", F.coalesce("relations", F.lit(0)).alias("relations"),
        F.coalesce("candidate_fields", F.array().cast("array<string>")).alias("candidate_fields")))


def merge_enrichment(answers: DataFrame, id_col: str, subject_col: str, raw_col: str, max_relations: int = 12):
    """(nodes, relations) from model JSON, at most ``max_relations`` items each (K6).

    Answers are parsed once: the items are written, and both tables read them.
    """
    items = F.slice(json_items(json_object(F.col(raw_col)), "relations"), 1, max_relations)
    rows = unnest(answers, items, "item", "pos", [F.col(id_col).alias("document_id"),
                                                   F.col(subject_col).alias("subject")])
    rows = rows.select("document_id", "subject", "pos", json_strings(
        F.col("item"), "predicate", "object", "object_type", "confidence", "evidence").alias("f"))
    field = lambda n: F.col(f"f.{n}")
    or_blank = lambda n: normalize_name(F.coalesce(field(n), F.lit("")))
    kind = normalize_name(F.coalesce(F.nullif(field("object_type"), F.lit("")), F.lit("concept")))
    rows = rows.select(
        "document_id", "subject", "pos", or_blank("predicate").alias("predicate"), or_blank("object").alias("object"),
        F.when(kind == "", "concept").otherwise(kind).alias("object_type"),
        clamped_float(field("confidence"), 0.65).alias("confidence"),
        F.left(F.coalesce(field("evidence"), F.lit("")), F.lit(500)).alias("evidence"),
    ).filter("predicate <> '' AND object <> ''")
    rows = cut_lineage(rows, "answers")
    subject = entity_id(F.lit(SUBJECT_TYPE), name_key(F.col("subject")))
    obj = entity_id(F.col("object_type"), name_key(F.col("object")))
    relations = rows.select(
        F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.lit("llm"), F.col("pos").cast("string"),
                           subject, F.col("predicate"), obj), 256).alias("id"),
        subject.alias("subject_id"), "predicate", obj.alias("object_id"),
        F.lit(None).cast("string").alias("value_text"),
        *[F.lit(None).cast("double").alias(c) for c in ("value_number", "value_min", "value_max")],
        F.create_map(F.lit("evidence"), F.col("evidence")).alias("properties"),
        F.col("document_id").alias("source_document_id"),
        chunk_id(F.col("document_id"), F.lit(0)).alias("source_chunk_id"),
        "confidence", F.lit("llm").alias("extractor"))
    empty = F.create_map().cast("map<string,string>")
    nodes = rows.select("document_id", "pos", F.col("object_type").alias("type"),
                        name_key(F.col("object")).alias("key"), F.col("object").alias("name"),
                        empty.alias("properties"), F.col("document_id").alias("source_document_id"))
    return nodes, relations


def pending_enrichment(documents: DataFrame, relations: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents without a model-made relation, oldest first."""
    done = relations.filter("extractor = 'llm'").select(F.col("source_document_id").alias("document_id")).distinct()
    left = documents.join(done, "document_id", "left_anti").orderBy("created_at", "document_id")
    return left.limit(limit) if limit else left
