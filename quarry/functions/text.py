"""Text columns: normalisation, tokens, query terms, labels, formatting.

Every function takes and returns Columns, so the work stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# White space as Unicode defines it, line ends, word characters.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]+"
CJK = r"[一-鿿]"


# The same white space as single characters.
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203),
                                8232, 8233, 8239, 8287, 12288]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def collapse_space(c: Column) -> Column:
    """Runs of white space as one space each.  A pattern of all of it is tried at every character, one of two spaces is not."""
    return F.regexp_replace(F.translate(c, SPACE_CHARS, " " * len(SPACE_CHARS)), "  +", " ")


def normalize_text(c: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return collapse_space(F.lower(strip(c)))


def normalize_name(c: Column) -> Column:
    """Entity name without wiki residue, edge punctuation and extra space (F1)."""
    c = F.regexp_replace(c, r"\[\[File:[^\]]+\]\]", "")
    c = F.regexp_replace(c, r"\{\{[^}]+\}\}", "")
    c = strip(F.replace(c, F.lit("'''"), F.lit("")))
    c = F.regexp_replace(c, r"^[|=：:，,;；]+|[|=：:，,;；]+$", "")
    return collapse_space(c)


def name_key(c: Column) -> Column:
    return F.lower(normalize_name(c))


def word_tokens(c: Column) -> Column:
    """Lower-cased word tokens in text order."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({WORD})"), 1), F.lower)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def sparse_tokens(c: Column) -> Column:
    """Latin words and single CJK characters, then CJK bigrams (F2)."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(f"([a-z0-9_]+|{CJK})"), 1)

    def bigrams(cjk: Column) -> Column:
        return F.transform(F.slice(cjk, 2, F.greatest(F.size(cjk), F.lit(1))), lambda t, i: F.concat(F.get(cjk, i), t))

    # What stands in a lambda more than once is evaluated once; a token from "一" on is a CJK character.
    return _once(tokens, lambda ts: F.concat(ts, _once(F.filter(ts, lambda t: t >= "一"), bigrams)))


def query_terms(c: Column) -> Column:
    """Word runs of a query plus its compact form, ordered and distinct."""
    runs = F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)
    compact = F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "")
    return F.filter(F.array_distinct(F.concat(runs, F.array(compact))), lambda t: t != "")


# Words that carry no search meaning.
KEYWORD_STOPWORDS = (
    "的", "是", "了", "吗", "呢", "什么", "怎么", "如何", "为什么",
    "多少", "哪些", "哪个", "可以", "帮我", "请问", "一下", "这个",
)


def keywords(c: Column, limit: int = 8) -> Column:
    """First ``limit`` CJK or Latin runs that are no stopwords."""
    runs = F.regexp_extract_all(c, F.lit(r"([一-鿿]+|[a-zA-Z0-9]+)"), 1)
    kept = F.filter(
        runs, lambda t: (F.length(t) > 1) & ~F.lower(t).isin(*KEYWORD_STOPWORDS)
    )
    return F.slice(kept, 1, limit)


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def split_items(c: Column) -> Column:
    """Items of a list value, normalised, blanks dropped (F8)."""
    items = F.split(normalize_name(c), "[,、，；]")
    return F.filter(F.transform(items, normalize_name), lambda s: s != "")


def first_nonempty(values: Column) -> Column:
    """First non-empty string of an array, '' when there is none."""
    return F.coalesce(F.get(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))), F.lit(0)),
                      F.lit(""))


NUMBER = r"(-?\p{Nd}+(?:\.\p{Nd}+)?)"


def ascii_digits(c: Column) -> Column:
    """Full-width and Arabic-Indic digits as 0-9."""
    return F.translate(c, "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


def number_text(c: Column) -> Column:
    """A double as plain decimal text between 1e-4 and 1e16, as in 20000000.0."""
    plain = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(c)
    long = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(long, plain).otherwise(c.cast("string"))


def first_number(c: Column) -> Column:
    """First decimal number in the text, NULL when there is none."""
    return ascii_digits(F.regexp_extract(c, NUMBER, 1)).try_cast("double")


def number_range(c: Column) -> Column:
    """STRUCT<low, high> of the first one or two numbers."""
    nums = F.transform(F.regexp_extract_all(c, F.lit(NUMBER), 1), lambda x: ascii_digits(x).cast("double"))
    a = F.get(nums, F.lit(0))
    b = F.coalesce(F.get(nums, F.lit(1)), a)
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def strip_markup(c: Column) -> Column:
    """Text without tags."""
    return F.regexp_replace(c, "<[^>]+>", "")


def safe_name(c: Column) -> Column:
    """Printable name without control characters and path characters."""
    return strip(F.regexp_replace(c, r'[\p{C}<>:"/\\|?*]', ""))


def score_band(c: Column) -> Column:
    """high from 0.8, mid from 0.5, else low."""
    return F.when(c >= 0.8, "high").when(c >= 0.5, "mid").otherwise("low")


def approx_tokens(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def is_hex_trace_id(c: Column) -> Column:
    """32 hexadecimal digits."""
    return c.rlike("^[0-9a-fA-F]{32}$")


def trim_string(c: Column, limit: int = 4000) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("...[truncated]"))).otherwise(c)


def trim_payload(m: Column, max_chars: int = 4000, max_keys: int = 80) -> Column:
    """First ``max_keys`` entries of a MAP<STRING,STRING>, long values cut."""
    kept = F.map_from_entries(F.slice(F.map_entries(m), 1, max_keys))
    return F.transform_values(kept, lambda _, v: trim_string(v, max_chars))


def trim_list(a: Column, max_chars: int = 4000, max_items: int = 50) -> Column:
    """First ``max_items`` strings of an array, long ones cut."""
    return F.transform(F.slice(a, 1, max_items), lambda v: trim_string(v, max_chars))


def trim_nested(c: Column, kind: DataType, max_chars: int = 4000, max_items: int = 50, max_keys: int = 80) -> Column:
    """A payload of type ``kind`` with strings, lists and maps cut at every depth.

    The expression follows the type, so values stay in the JVM.  Map keys are
    whole; a struct keeps its first ``max_keys`` fields; null stays null.
    """
    inner = lambda v, t: trim_nested(v, t, max_chars, max_items, max_keys)
    if isinstance(kind, StringType):
        return trim_string(c, max_chars)
    if isinstance(kind, ArrayType):
        return F.transform(F.slice(c, 1, max_items), lambda v: inner(v, kind.elementType))
    if isinstance(kind, MapType):
        kept = F.map_from_entries(F.slice(F.map_entries(c), 1, max_keys))
        return F.transform_values(kept, lambda _, v: inner(v, kind.valueType))
    if isinstance(kind, StructType):
        fields = [inner(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields[:max_keys]]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    return c


def file_stem(name: Column) -> Column:
    """File name without folders and last extension."""
    base = F.regexp_replace(name, r"^.*/", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def entity_name_from_filename(name: Column) -> Column:
    """Normalised file stem (P3); its key is ``lower`` of it."""
    return normalize_name(file_stem(F.when(F.coalesce(name, F.lit("")) == "", "unnamed").otherwise(name)))


def group_path(group: Column, parent: Column, child: Column) -> Column:
    """STRUCT<path, parent, child> from either form of a group."""
    g, p, c = (strip(F.coalesce(x, F.lit(""))) for x in (group, parent, child))
    parts = F.split(g, "/", 2)
    from_path = (p == "") & (g != "")
    two = from_path & g.contains("/")
    parent_ = F.when(two, strip(parts[0])).when(from_path, g).otherwise(p)
    child_ = F.when(two, strip(F.get(parts, F.lit(1)))).otherwise(c)
    child_ = F.when(parent_ == "", "").otherwise(child_)
    path = (F.when(parent_ == "", "")
            .when(child_ != "", F.concat(parent_, F.lit(" / "), child_))
            .otherwise(parent_))
    return F.struct(path.alias("path"), parent_.alias("parent"), child_.alias("child"))


def in_category(parent: Column, group: Column, category: str) -> Column:
    """Parent or group is the category, or the group lies below it (P5)."""
    return (parent == category) | (group == category) | group.startswith(f"{category} /")


# Ordered rules (pattern of words, intent, sub-intent, confidence).
MATH_PATTERN = r"\p{Nd}+\s*[-+*/%^]\s*\p{Nd}+"
INTENT_RULES = (
    (("计算", "等于", "加", "减", "乘", "除", "平方", "开方"), "任务", "计算", 0.9),
    (("搜索", "查一下", "帮我找", "search"), "任务", "搜索", 0.85),
    (("sql", "数据库", "统计", "查询表"), "任务", "数据库", 0.85),
    (("知识库", "文档", "资料里", "已上传"), "问答", "知识问答", 0.85),
    (("是什么", "有哪些", "哪些", "多少", "技能", "属性", "精灵", "图鉴"), "问答", "知识问答", 0.75),
)
# Keyword lists per sub-intent, in the order in which ties are decided.
INTENT_KEYWORDS = (
    ("问答", "知识问答", ("什么", "是什么", "为什么", "如何", "怎么", "哪些", "多少", "谁",
                       "解释", "含义", "属性", "技能", "精灵", "图鉴")),
    ("问答", "闲聊", ("你好", "谢谢", "再见", "聊天")),
    ("任务", "搜索", ("搜索", "查一下", "帮我找", "search")),
    ("任务", "计算", ("计算", "等于", "算", "加", "减")),
    ("任务", "数据库", ("sql", "查询", "表", "统计")),
    ("文档", "上传", ("上传", "文档", "pdf")),
    ("文档", "总结", ("总结", "摘要", "概括")),
)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def intent(c: Column, rules=INTENT_RULES, keyword_lists=INTENT_KEYWORDS) -> Column:
    """STRUCT<intent, sub_intent, confidence, numbers> by ordered rules."""
    q = F.lower(strip(c))

    def label(root, sub, conf):
        return F.struct(F.lit(root).alias("intent"), F.lit(sub).alias("sub_intent"),
                        conf.cast("double").alias("confidence"))

    ruled = None
    for i, (words, root, sub, conf) in enumerate(rules):
        cond = _any_word(q, words)
        if i == 0:
            cond = q.rlike(MATH_PATTERN) | cond
        out = label(root, sub, F.lit(conf))
        ruled = F.when(cond, out) if ruled is None else ruled.when(cond, out)

    hits = F.array(*[
        F.struct(
            reduce(lambda a, b: a + b, [q.contains(w.lower()).cast("int") for w in words]).alias("hits"),
            F.lit(-i).alias("order"), F.lit(root).alias("root"), F.lit(sub).alias("sub"))
        for i, (root, sub, words) in enumerate(keyword_lists)
    ])
    best = F.array_max(hits)
    by_hits = F.struct(
        best["root"].alias("intent"), best["sub"].alias("sub_intent"),
        F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.12) * best["hits"]).alias("confidence"))
    weak = F.when(q.contains("?") | q.contains("？"), F.lit(0.35)).otherwise(F.lit(0.25))
    picked = ruled.otherwise(F.when(best["hits"] > 0, by_hits).otherwise(label("问答", "知识问答", weak)))
    numbers = F.slice(F.regexp_extract_all(c, F.lit(r"([-+]?\p{Nd}*\.\p{Nd}+|\p{Nd}+)"), 1), 1, 5)
    return F.struct(picked["intent"].alias("intent"), picked["sub_intent"].alias("sub_intent"),
                    picked["confidence"].alias("confidence"), numbers.alias("numbers"))


def cascade_intent(query: Column, rule: Column, model: Column, threshold: float = 0.55) -> Column:
    """Choose between a rule label and a model label.

    ``rule`` and ``model`` are STRUCT<intent, sub_intent, confidence>; ``model``
    may be NULL.  The model is asked only where the rule is unsure.
    """
    clamped = F.greatest(F.lit(0.0), F.least(F.coalesce(model["confidence"], F.lit(0.0)), F.lit(1.0)))
    keep_rule = ((rule["confidence"] >= 0.8) | model.isNull()
                 | (F.length(strip(query)) <= 3) | (clamped < rule["confidence"]))
    conf = F.when(keep_rule, rule["confidence"]).otherwise(clamped)
    return F.struct(
        F.when(keep_rule, rule["intent"]).otherwise(F.coalesce(model["intent"], F.lit("未知"))).alias("intent"),
        F.when(keep_rule, rule["sub_intent"]).otherwise(F.coalesce(model["sub_intent"], F.lit("未知"))).alias("sub_intent"),
        conf.alias("confidence"),
        F.when(keep_rule, "rule").otherwise("model").alias("chosen"),
        (conf < threshold).alias("needs_clarification"))


def format_fact(subject: Column, predicate: Column, obj: Column, value_text: Column,
                value_number: Column, value_min: Column, value_max: Column) -> Column:
    """``subject --predicate--> target`` with literal fallbacks."""
    bound = lambda c: F.when(c.isNull() | (c == 0.0), "").otherwise(number_text(c))
    span = F.when(value_min.isNotNull() | value_max.isNotNull(),
                  F.concat(bound(value_min), F.lit("~"), bound(value_max)))
    target = F.coalesce(obj, value_text, number_text(value_number), span, F.lit(""))
    return F.when(subject.isNull(), "").otherwise(
        strip(F.concat(subject, F.lit(" --"), predicate, F.lit("--> "), target)))
