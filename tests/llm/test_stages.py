"""Stages of the pipeline, each against a plain version on its own input."""

import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_llm import SF, ids_of


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_duplicates_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    given = sorted((r.doc_id, r.text) for r in docs.collect())
    sets, root = [shingles(t) for _, t in given], list(range(len(given)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    want = Counter(x for i, x in enumerate(given) if find(i) == i)
    assert rows(corpus_pipeline.near_duplicates_stage(spark, docs, SF)) == want and len(want) < len(given)


def test_mixing_and_packing_stages_keep_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    assert rows(corpus_pipeline.mixing_stage(spark, docs, SF)) == rows(docs)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter({r.doc_id: len(ids_of(r.text, 1)) for r in docs.collect()})
    got = Counter()
    for r in corpus_pipeline.packing_stage(spark, docs, SF).collect():
        got[r.doc_id] += r.length
    assert got == want
