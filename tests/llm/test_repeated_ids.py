"""Rows that share an id go by their own texts only."""

import numpy as np

import corpus_pipeline
from quarry.llm import partenum

WORDS = [f"w{i}" for i in range(400)]


def text(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect())


def test_one_of_each_by_own_text(spark):
    a, b, c, d = (text(60, s) for s in range(4))
    docs = [(1, a), (1, b), (2, a + " more"), (3, b), (4, c), (5, c + " more"), (5, d), (5, d), (6, None), (6, ""), (6, ""),
            (None, a), (None, a)]
    df = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, _part string").repartition(3)
    want = sorted([(1, a), (1, b), (4, c), (5, d), (6, ""), (6, ""), (-1, a), (-1, a)])
    got = partenum.one_of_each(df)
    assert rows(got) == want and got.columns == df.columns


def test_passages_are_cut_from_their_own_row(spark):
    shared, own = text(80, 7), text(100, 9)
    docs = [(1, shared), (2, own + " " + shared + " end"), (2, text(150, 8))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = corpus_pipeline.passages_stage(spark, df, "")
    assert rows(got) == sorted([(1, shared), (2, own + " end"), (2, text(150, 8))]) and got.columns == df.columns
