"""Wiki records: template fields, attribute chart, totals, merged sources, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.rows import unnest
from quarry.functions.text import strip, strip_markup
from quarry.operators.ranking import first_rows

STAT_FIELDS = ("生命", "物攻", "魔攻", "物防", "魔防", "速度")

# Attribute, strong against, resists, weak to.
EFFECT_CHART = (
    ("火", "草 虫 冰 机械", "火 水 岩", "水 岩 地"),
    ("水", "火 岩 地", "水 草 电", "草 电"),
    ("草", "水 岩 地", "草 电 地", "火 虫 冰 飞行"),
    ("光", "恶 幽", "光 幻", "草 幽"),
    ("恶", "光 幻 超能", "恶 幽", "光 格斗"),
    ("普通", "", "", "格斗"),
    ("电", "水 飞行", "电", "地"),
    ("冰", "草 地 飞行 龙", "冰", "火 格斗 岩 钢"),
    ("格斗", "普通 冰 岩 钢 恶", "虫 岩", "飞行 超能 虫"),
    ("毒", "草 虫", "毒 草 格斗", "地 超能"),
    ("地", "火 电 毒 岩 钢", "岩 毒", "水 草 冰"),
    ("飞行", "草 格斗 虫", "地 格斗 草", "电 冰 岩"),
    ("超能", "格斗 毒", "超能", "虫 幽 恶"),
    ("虫", "草 超能 恶", "草 地 格斗", "火 飞行 岩 毒"),
    ("岩", "火 冰 飞行 虫", "普通 火 飞行 毒", "水 草 格斗 地 钢"),
    ("幽", "超能 光", "普通 幽 毒", "恶 光"),
    ("龙", "龙", "火 水 草 电", "冰 龙"),
    ("钢", "冰 岩", "普通 草 虫 岩 冰 飞行 超能 龙 钢", "火 格斗 地"),
    ("机械", "冰 岩 钢", "普通 草 电 飞行 超能 虫 岩 冰 龙 钢 机械", "火 水 格斗 地"),
    ("萌", "恶 幽 格斗", "普通 萌", "恶 幽"),
    ("幻", "光", "光 幻 恶", "幽"),
    ("首领", "普通 火 水 草 电 冰 格斗 毒 地 飞行 超能 虫 岩 幽 龙 钢 恶 光 幻 萌 机械", "普通",
     "普通 火 水 草 电 冰 格斗 毒 地 飞行 超能 虫 岩 幽 龙 钢 恶 光 幻 萌 机械"),
)


def chart_table(spark: SparkSession, chart=EFFECT_CHART) -> DataFrame:
    rows = [(a, *[x.split() for x in rest]) for a, *rest in chart]
    return spark.createDataFrame(
        rows, "attribute string, strong array<string>, resist array<string>, weak array<string>")


def effectiveness(df: DataFrame, id_col: str, attributes: Column, chart: DataFrame) -> DataFrame:
    """Sorted union of chart sets over a record's attributes.

    The chart is a fixed small table, so each record is looked up in place and
    the sets (at most the chart's attributes) merge per record.
    """
    each = unnest(df, attributes, "attribute", keep=[id_col]).withColumn("attribute", strip(F.col("attribute")))
    hit = each.join(F.broadcast(chart), "attribute")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return hit.groupBy(id_col).agg(union("strong"), union("resist"), union("weak"))


def split_attributes(c: Column) -> Column:
    """Attributes of a slash or comma list, in source order, distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[/,，]"), strip), lambda a: a != ""))


def primary_attribute(attributes: Column) -> Column:
    return F.coalesce(F.get(attributes, F.lit(0)), F.lit("未知"))


def primary_counts(df: DataFrame, column: str) -> DataFrame:
    """Records per primary attribute and in total."""
    return df.groupBy(F.col(column).alias("primary")).agg(F.count("*").alias("n")).unionByName(
        df.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("primary"), "n")).orderBy(
        F.col("n").desc(), "primary")


def stat_total(*stats: Column) -> Column:
    """Sum of the numeric fields; others count 0."""
    total = F.lit(0)
    for s in stats:
        total = total + F.coalesce(s.cast("string").try_cast("int"), F.lit(0))
    return total


def strict_total(*stats: Column) -> Column:
    """Sum of the fields, 0 if any is not numeric (A14 variant)."""
    total = F.lit(0)
    for s in stats:
        total = total + s.cast("string").try_cast("int")
    return F.coalesce(total, F.lit(0))


# How template blocks begin, the preferred one first.
TEMPLATES = (r"宠物信息/精灵", r"宠物信息\s*\|", r"(?:宠物信息|精灵信息)[/\n|]")


def template_fields(df: DataFrame, id_col: str, text_col: str, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """(id, key, value) of ``|key=value`` pairs in the first block of the first template that occurs."""
    found = [F.regexp_extract(text_col, r"(\{\{" + t + r"[\s\S]*?\n\}\})", 1) for t in templates]
    block = F.coalesce(*[F.nullif(f, F.lit("")) for f in found])
    pair = r"\|\s*([^=|\n]+?)\s*=\s*([\s\S]*?)(?=\n\||\n\}\})"
    keys, values = (F.regexp_extract_all(block, F.lit(pair), i) for i in (1, 2))
    rows = unnest(df, F.arrays_zip(keys.alias("k"), values.alias("v")), "kv", "pos", [id_col])
    value = F.regexp_replace(strip(strip_markup(F.col("kv.v"))), r"\{\{[^}]+\}\}", "")
    rows = rows.select(id_col, "pos", strip(F.col("kv.k")).alias("key"), value.alias("value"))
    # A repeated key keeps its last value.
    return first_rows(rows, [id_col, "key"], [F.col("pos").desc()]).drop("pos")


def merge_sources(*sources: DataFrame) -> DataFrame:
    """(name, key, value, pos) records of several sources, first of equal pairs."""
    stacked = None
    for i, df in enumerate(sources):
        part = df.select("name", "key", "value", F.struct(F.lit(i).alias("source"), "pos").alias("seq"))
        stacked = part if stacked is None else stacked.unionByName(part)
    kept = stacked.filter("value <> '' AND value <> 'None'")
    return kept.groupBy("name", "key", "value").agg(F.min("seq").alias("seq"))


def prefer_first(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One value per column, the left side's where it has one."""
    r = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return left.select(key, *columns).join(r, key, "full").select(
        key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) for c in columns])


def dedupe_feed(df: DataFrame, id_col: str, form_col: str, order: list[Column]) -> DataFrame:
    """First record per id and form."""
    key = F.concat_ws("_", F.col(id_col).cast("string"), F.nullif(F.col(form_col), F.lit("")))
    return first_rows(df.withColumn("key", key), ["key"], order)


def printout_fields(df: DataFrame, json_col: str) -> DataFrame:
    """(page, key, pos, value) of a query answer's printouts."""
    # A value is a string, a number or an object with `fulltext`; all read as text.
    pages = F.from_json(json_col, "map<string, struct<printouts: map<string, array<string>>>>")
    rows = df.select(F.explode_outer(pages).alias("page", "p")).filter("page IS NOT NULL")
    rows = rows.select("page", F.explode_outer("p.printouts").alias("key", "vals")).filter("key IS NOT NULL")
    rows = unnest(rows, "vals", "raw", "pos", ["page", "key"])
    full = F.when(F.col("raw").startswith("{"), F.coalesce(F.get_json_object("raw", "$.fulltext"), F.col("raw")))
    value = F.replace(F.replace(F.coalesce(full, F.col("raw")), F.lit("<desc_id="), F.lit("[")), F.lit("</>"), F.lit("]"))
    return rows.select("page", "key", "pos", value.alias("value")).filter("value <> '' AND value <> 'None'")


def rule_questions(records: DataFrame, fields: dict[str, str], max_questions: int = 3) -> DataFrame:
    """Templated questions per record, first ``max_questions`` that apply.

    ``records`` has (source_file, name) and one column per entry of ``fields``
    (id, attributes, hp, attack, speed, evolution, ability).
    """
    f = {k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in fields.items()}
    name = F.col("name")
    has_id = (f["id"] != "") & (name != "")

    def q(cond, text, answer, kind):
        return F.when(cond, F.struct(text.alias("question"), answer.alias("answer_ref"), F.lit(kind).alias("type")))

    # Question templates and their order.
    options = F.array(
        q(has_id, F.concat(F.lit("编号"), f["id"], F.lit("的精灵是什么？")), name, "factual"),
        q(has_id & (f["attributes"] != ""), F.concat(name, F.lit("的属性是什么？")), f["attributes"], "factual"),
        q(f["hp"] != "", F.concat(name, F.lit("的HP种族值是多少？")), f["hp"], "numerical"),
        q(f["attack"] != "", F.concat(name, F.lit("的攻击种族值是多少？")), f["attack"], "numerical"),
        q(f["speed"] != "", F.concat(name, F.lit("的速度是多少？")), f["speed"], "numerical"),
        q((f["evolution"] != "") & ~f["evolution"].isin("主线赠送", "御三家", "-"),
          F.concat(name, F.lit("的进化条件是什么？")), f["evolution"], "factual"),
        q(F.length(f["ability"]) > 5, F.concat(name, F.lit("有什么特性？")), F.left(f["ability"], F.lit(100)),
          "descriptive"))
    kept = F.slice(F.filter(options, lambda x: x.isNotNull()), 1, max_questions)
    return unnest(records, kept, "q", "pos", ["source_file"]).select(
        "source_file", "pos", "q.question", "q.answer_ref", "q.type")
