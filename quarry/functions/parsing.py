"""Lenient parsing of model output columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.rows import unnest
from quarry.functions.text import LINE_END, strip


def _is_json(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False)) & F.try_parse_json(c).isNotNull()


def json_object(c: Column) -> Column:
    """JSON text of the object in ``c``, NULL when none can be parsed.

    Code fences are removed; if the whole text is no JSON, the widest
    ``{...}`` is tried.
    """
    text = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?", ""), r"```\s*$", ""))
    wide = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(_is_json(text), text).when(_is_json(wide), wide)


def json_field(obj: Column, name: str) -> Column:
    return F.get_json_object(obj, f"$.{name}")


def json_strings(item: Column, *names: str) -> Column:
    """STRUCT of the named fields as text, from one parse."""
    return F.from_json(item, ", ".join(f"`{n}` string" for n in names))


def json_items(obj: Column, name: str) -> Column:
    """Objects of a JSON array field, each as JSON text; other items dropped."""
    items = F.from_json(F.get_json_object(obj, f"$.{name}"), "array<string>")
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda s: s.startswith("{"))


def json_string_list(c: Column) -> Column:
    """String list from JSON, from the first ``[...]``, or from list lines."""

    def parsed(s):
        return F.when(_is_json(s) & s.startswith("["), F.from_json(s, "array<string>"))

    whole = strip(c)
    first = F.regexp_extract(c, r"(?s)(\[.*?\])", 1)

    def clean(line):
        line = strip(F.regexp_replace(strip(line), r"^\d+[.)、]\s*", ""))
        return strip(F.regexp_replace(line, r"^[-*]\s*", ""))

    listed = F.filter(F.transform(F.split(c, LINE_END), clean), lambda s: F.length(s) > 3)
    listed = F.when(F.size(listed) >= 2, listed).otherwise(F.array().cast("array<string>"))
    return F.coalesce(parsed(whole), parsed(first), listed)


def number_or(c: Column, default: float = 0.5, low: float | None = None, high: float | None = None) -> Column:
    """First unsigned number of the text, else ``default``, optionally clamped."""
    n = F.coalesce(F.regexp_extract(c, r"([0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(default))
    if low is not None:
        n = F.greatest(F.lit(low), n)
    if high is not None:
        n = F.least(F.lit(high), n)
    return n


def clamped_float(c: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    """Text as a number, else ``default``, clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("double"), F.lit(default))))


def best_label(c: Column, labels: list[str]) -> Column:
    """STRUCT<label, parsed>: exact, else longest contained, else the first label."""
    raw = F.lower(strip(c))
    exact = F.coalesce(*[F.when(raw == lab.lower(), F.lit(lab)) for lab in labels])
    contained = F.array_max(F.filter(
        F.array(*[F.struct(F.lit(len(lab)).alias("n"), F.lit(-i).alias("order"), F.lit(lab).alias("label"),
                           raw.contains(lab.lower()).alias("hit")) for i, lab in enumerate(labels)]),
        lambda s: s["hit"]))
    found = F.coalesce(exact, contained["label"])
    return F.struct(F.coalesce(found, F.lit(labels[0])).alias("label"), found.isNotNull().alias("parsed"))


def sentence_claims(c: Column) -> Column:
    """Claims by sentence end, each closed by a full stop."""
    parts = F.filter(F.transform(F.split(c, "[。；;]"), strip), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.concat(s, F.lit("。")))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(c)))


def transcript_fields(c: Column) -> Column:
    """Thought, action, input and answer of one agent step."""
    thought = F.regexp_extract(c, r"(?is)Thought:\s*(.+?)(?=\n(?:Action:|Final Answer:)|\z)", 1)
    done = c.rlike(r"(?is)Final Answer:\s*.+")
    has_final = c.rlike(r"(?i)Final Answer:\s*")
    answer = F.regexp_extract(c, r"(?is)Final Answer:\s*(.+)\z", 1)
    action = F.regexp_extract(c, r"(?i)Action:\s*(\S+)", 1)
    strict = F.regexp_extract(c, r"Action Input:\s*(\{[\s\S]*\})", 1)
    loose = strip(F.regexp_extract(c, r"(?i)Action Input:\s*([\s\S]+?)(?=\n\n|\z)", 1))
    raw_input = F.when(strict != "", strict).when(loose != "", loose)
    ok = _is_json(raw_input)
    live = ~has_final
    return F.struct(
        F.nullif(strip(thought), F.lit("")).alias("thought"),
        F.when(done, strip(answer)).alias("final_answer"),
        done.alias("done"),
        F.when(live, F.nullif(action, F.lit(""))).alias("action"),
        F.when(live & raw_input.isNotNull(), F.when(ok, raw_input).otherwise("{}")).alias("action_input"),
        F.when(live & raw_input.isNotNull() & ~ok,
               F.when(strict != "", "Action Input 不是合法 JSON").otherwise("无法解析 Action Input")).alias("parse_error"))


def plan_rows(df, text_col: str, *keep: str):
    """One row per sub-task of a plan with defaults filled in (F16)."""
    obj = json_object(F.col(text_col))
    rows = unnest(df, json_items(obj, "subtasks"), "item", "pos", keep)
    rows = rows.select(*keep, "pos", json_strings(
        F.col("item"), "id", "title", "description", "action_type", "tool_name").alias("f"))
    get = lambda name: F.col(f"f.{name}")
    return rows.select(
        *keep, "pos",
        F.coalesce(get("id"), F.concat(F.lit("task_"), F.col("pos"))).alias("id"),
        F.coalesce(get("title"), F.lit("")).alias("title"),
        F.coalesce(get("description"), F.lit("")).alias("description"),
        F.lower(F.coalesce(get("action_type"), F.lit("reasoning"))).alias("action_type"),
        get("tool_name").alias("tool_name"))


def review_flags(c: Column, min_quality: int = 60) -> Column:
    """Quality, warn and retry flags of a review answer."""
    obj = json_object(c)
    parsed = obj.isNotNull() & F.coalesce(obj.startswith("{"), F.lit(False))
    score = json_field(obj, "quality_score")
    quality = (F.when(~parsed, F.lit(50))
               .when(score.isNull(), F.lit(0))
               .otherwise(F.coalesce(score.try_cast("double").cast("int"), F.lit(50))))
    quality = F.greatest(F.lit(0), F.least(F.lit(100), quality))
    complete = parsed & F.coalesce(json_field(obj, "is_complete") == "true", F.lit(False))
    invented = parsed & F.coalesce(json_field(obj, "likely_hallucination") == "true", F.lit(False))
    return F.struct(
        quality.alias("quality"), complete.alias("complete"), invented.alias("hallucination"),
        (quality < min_quality).alias("warn"), (invented | ~complete).alias("retry"),
        (~parsed).alias("parse_error"))


def citation_numbers(c: Column) -> Column:
    """Distinct ``[n]`` markers in first-mention order."""
    nums = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), 1), lambda s: s.try_cast("int"))
    return F.array_distinct(F.filter(nums, lambda n: n.isNotNull()))
