"""Column functions on hand-made inputs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import parsing as ps
from quarry.functions import text as tx
from quarry.functions import vectors as vx
from quarry.operators import chunking as ch


def one(spark, column, *values, names=None):
    names = names or [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], names).select(column.alias("x")).first()["x"]


def chunk(spark, text, strategy, size, overlap=0):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [r["content"] for r in ch.chunk_table(df, "id", "text", strategy, size, overlap).orderBy("chunk_index").collect()]


def test_fixed_windows(spark):
    assert [len(c) for c in chunk(spark, "A" * 250, "fixed", 100, 20)] == [100, 100, 90]
    assert ch.clamp(10, 0) == (32, 0) and ch.clamp(100, 150) == (100, 99) and ch.clamp(100, -5) == (100, 0)


def test_paragraphs(spark):
    got = chunk(spark, "A" * 200 + "\n\n" + "B" * 200, "paragraph", 50)
    assert [len(c) for c in got] == [200, 200]
    assert chunk(spark, "Para 1.\n\nPara 2.", "paragraph", 100) == ["Para 1.\n\nPara 2."]


def test_empty_and_long(spark):
    for strategy in ("fixed", "paragraph", "recursive"):
        assert chunk(spark, "  \n", strategy, 100) == []
    assert chunk(spark, "X" * 1000, "recursive", 100, 20) == chunk(spark, "X" * 1000, "fixed", 100, 20)


def test_recursive_against_brute_force(spark):
    def brute(text, size, seps):
        if len(text) <= size:
            return [text]
        for i, sep in enumerate(seps):
            if sep in text:
                out, buf = [], ""
                for part in [p for p in text.split(sep) if p.strip() or p == ""]:
                    joined = buf + sep + part if buf else part
                    if len(joined) <= size:
                        buf = joined
                        continue
                    out += brute(buf, size, seps[i + 1:]) if buf else []
                    buf = part
                out += brute(buf, size, seps[i + 1:]) if buf else []
                return out or windows(text, size)
        return windows(text, size)

    def windows(text, size):
        return [text[i:i + size] for i in range(0, max(1, len(text)), size)]

    import random
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bb", " ", "\n", "\n\n", ". ", "。", "ccccccc"]) for _ in range(rng.randint(1, 90))).strip()
             for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: list(r["chunks"]) for r in ch.chunk_arrays(df, "text", ["id"], "recursive", 32, 0).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (brute(t, 32, ["\n\n", "\n", "。", ". ", " "]) if t else []), t


def test_tokens(spark):
    assert one(spark, tx.sparse_tokens(F.col("c0")), "AI知识库") == ["ai", "知", "识", "库", "知识", "识库"]
    assert one(spark, tx.word_tokens(F.col("c0")), "It's É_1 好") == ["it", "s", "é_1", "好"]
    assert one(spark, tx.query_terms(F.col("c0")), "a b a") == ["a", "b", "aba"]


def test_numbers(spark):
    assert one(spark, tx.number_range(F.col("c0")), "1.03~1.35").asDict() == {"low": 1.03, "high": 1.35}
    assert one(spark, tx.number_range(F.col("c0")), "5").asDict() == {"low": 5.0, "high": 5.0}


def test_group_path(spark):
    g = one(spark, tx.group_path(F.col("c0"), F.col("c1"), F.col("c2")), "a/b/c", "", "")
    assert tuple(g) == ("a / b/c", "a", "b/c")
    assert tuple(one(spark, tx.group_path(F.col("c0"), F.col("c1"), F.col("c2")), "", "", "x")) == ("", "", "")


def test_intent(spark):
    label = lambda q: tuple(one(spark, tx.intent(F.col("c0")), q))[:3]
    assert label("计算 123 + 456") == ("任务", "计算", 0.9)
    assert label("上传一个PDF文档") == ("问答", "知识问答", 0.85)
    assert label("xyzzy")[2] == 0.25 and label("xyz?")[2] == 0.35


def test_jaccard(spark):
    j = lambda a, b: one(spark, vx.token_jaccard(F.split("c0", ",", -1), F.split("c1", ",", -1)), a, b)
    assert abs(j("a,b", "b,c") - 1 / 3) < 1e-12
    empty = F.array().cast("array<string>")
    assert one(spark, vx.token_jaccard(empty, empty), "x") == 1.0


def test_best_label_and_lists(spark):
    got = one(spark, ps.best_label(F.col("c0"), ["相关", "不相关"]), "不相关。")
    assert got["label"] == "不相关" and got["parsed"]
    assert not one(spark, ps.best_label(F.col("c0"), ["yes", "no"]), "?")["parsed"]
    assert one(spark, ps.json_string_list(F.col("c0")), 'x ["a", "b"] y') == ["a", "b"]


def test_transcript(spark):
    f = one(spark, ps.transcript_fields(F.col("c0")), "Thought: t\nFinal Answer: 42")
    assert f["thought"] == "t" and f["final_answer"] == "42" and f["done"]


def test_plan_and_review(spark):
    df = spark.createDataFrame([('{"subtasks":[{"id":"t1"}]}',)], "raw string")
    row = ps.plan_rows(df, "raw").first()
    assert (row["id"], row["title"], row["action_type"]) == ("t1", "", "reasoning")
    review = '{"quality_score": 40, "is_complete": true, "likely_hallucination": false}'
    flags = one(spark, ps.review_flags(F.col("c0")), review)
    assert flags["warn"] and not flags["retry"]
    assert one(spark, ps.review_flags(F.col("c0")), review.replace("40", "400"))["quality"] == 100


def test_white_space_of_all_kinds_collapses_as_by_pattern(spark):
    odd = "".join(f"a{chr(c)}b{chr(c)} c \n" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(t,) for t in (odd, " a  b\t\nc　 d\x85", "", "  ", None, "知 😀​ x")], "t string")
    same = tx.collapse_space(F.col("t")).eqNullSafe(F.regexp_replace("t", f"{tx.SPACE}+", " "))
    assert df.filter(~same).count() == 0
    # one pass of a simple pattern: the class of all white space is not tried at every character
    assert tx.SPACE not in str(tx.collapse_space(F.col("t")))


def test_sparse_tokens_are_cut_out_once(spark):
    rows = [("AI知识库 x_1 再见",), ("知",), ("",), (None,), ("É 好a好",)]
    df = spark.createDataFrame(rows, "t string").select(tx.sparse_tokens(F.col("t")).alias("k"))
    assert [r.k for r in df.collect()] == [["ai", "知", "识", "库", "x_1", "再", "见", "知识", "识库", "库再", "再见"], ["知"], [], None,
                                           ["好", "a", "好", "好好"]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_hash_vectors_read_the_bytes():
    """Equal to the plain rule on characters of one to four bytes."""
    texts = ["", "a", "ab", "知识库 é😀x", "ÿ\x7f\x80", None, "é"]
    want = np.zeros((len(texts), 256))
    for row, t in zip(want, texts, strict=True):
        for a, b in zip((t or "")[:-1], (t or "")[1:], strict=True):
            row[(ord(a) * 31 + ord(b)) % 256] += 1
        row /= np.sqrt((row * row).sum()) or 1.0
    array = pa.array(["skipped", *texts])[1:]
    assert np.array_equal(vx.hash_vectors(array), want) and np.array_equal(vx.hash_vectors(array.cast(pa.large_string())), want)
    # no text becomes a Python string
    assert "to_pylist" not in vx.hash_vectors.__code__.co_names
