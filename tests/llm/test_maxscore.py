"""Ranked search against a plain version and the check SQL."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import maxscore
from quarry.llm.queries import QUERIES, SQL, table
from tests.oracle import connect, rows_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    """(item, rank, doc, score) for lists of (id, text)."""
    terms = lambda t: Counter(w.translate(LOWER) for w in WORD.findall(t or ""))
    held = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(1, total)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, n in terms(text).items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(out):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in out.collect()], key=str)


@pytest.fixture(scope="module")
def random_docs():
    rng = np.random.default_rng(4)
    chance = 1 / np.arange(1, 301)
    texts = [" ".join(f"w{i}" for i in rng.choice(300, rng.integers(0, 60), p=chance / chance.sum())) for _ in range(700)]
    return [(i, t) for i, t in enumerate(texts)], [(i, texts[int(rng.integers(700))]) for i in range(25)]


@pytest.mark.parametrize("k", [1, 5, 20, 1000])
def test_random(spark, monkeypatch, random_docs, k):
    monkeypatch.setattr(maxscore, "SHARD_DOCS", 16)
    docs, items = random_docs
    index = maxscore.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    out = maxscore.search(index, spark.createDataFrame(items, "item_id long, text string"), k)
    assert got(out) == plain(docs, items, k)


def test_odd(spark):
    texts = [None, "", " .,;", "a", "A a b", "İstanbul straße ÀÉ", "x " * 30_000 + "y", "y", "y", "the cat", "the dog", "the the the",
             "cat dog", "é \x00 nul", "CAT-dog_7 7"]
    docs = [*enumerate(texts), (9, "the cat"), (None, "cat"), (None, None), (4, "b")]
    items = [(1, "the cat the dog"), (2, None), (3, ""), (None, "cat cat"), (5, "y x x"), (5, "y"), (6, "unknown"), (7, "istanbul À àÉ 7")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, ids string, row int").repartition(3)
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, rank string, doc_id int")
    index = maxscore.build_index(d)
    for block in (maxscore.BLOCK_TERMS, 3):  # items in one and in several blocks
        assert got(maxscore.search(index, q, block_terms=block)) == plain(docs, items, 20)
    assert maxscore.search(index, q.limit(0)).collect() == []
    assert maxscore.search(maxscore.build_index(d.limit(0)), q).collect() == []


def test_documents(spark):
    df = QUERIES["op11_maxscore"](spark, SF)
    con = connect(SF)
    cur = con.execute(SQL["op11_maxscore"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_bounds_of_pairs():
    """A pair's bound holds for every document and is below the sum of both maxima where no document has both at their best."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        gains, times = rng.integers(0, 50, (30, 2)) * rng.integers(0, 2, (30, 2)), rng.integers(1, 4, 2)
        both = (gains > 0).all(1)
        joint = gains[both].sum(1).max() if both.any() else 0
        bound, alone = maxscore.unit_bounds(gains.max(0), times, np.array([joint]))
        won = (gains * times).sum(1)
        assert (won <= bound[0]).all() and (won[~both] <= alone[0]).all()
        assert bound[0] <= (gains.max(0) * times).sum()


def test_lists_that_cannot_win_are_not_read(spark, random_docs):
    """With a threshold above all that a shard can give, and with one that only the rarest term reaches."""
    index = maxscore.build_index(spark.createDataFrame(random_docs[0], "doc_id long, text string").coalesce(1))
    items = spark.createDataFrame([(0, "w0 w1 w250")], "item_id long, text string")
    block = maxscore._Block(maxscore.item_terms(items, "item_id", "text").toArrow())
    totals = index.selectExpr("sum(n_docs)", "sum(n_terms)").first()
    block.weigh(maxscore._frequencies(index, block), totals[0])
    batch = maxscore.impact_lists(index, block, *totals).toArrow().to_batches()[0]
    read = []

    class Watched(maxscore._Shard):
        def postings(self, p):
            docs, gains = super().postings(p)
            read.append(len(docs))
            return docs, gains

    shard = Watched(batch, 0, len(block.weights), len(block.pairs))
    ask = lambda least: maxscore.best_in_shard(shard, block.term, block.times, block.pair[::2], block.weights, 3, least)
    docs, scores = ask(1)
    assert len(docs) == 3
    read.clear()
    assert len(ask(10**12)[0]) == 0 and not read
    again = ask(int(scores[-1]))
    assert np.array_equal(again[0], docs) and np.array_equal(again[1], scores)
