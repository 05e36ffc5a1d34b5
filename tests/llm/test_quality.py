"""The learning rows of the quality classifier stay bounded, and its scores are right on rows it never saw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.llm.queries import table


def test_learning_keys_are_bounded(spark):
    keys = spark.range(60_000).withColumnRenamed("id", "doc_id")
    labels = keys.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    hot = keys.unionByName(spark.range(30_000).select(F.lit(11).cast("long").alias("doc_id")))  # one key in a third of the rows
    chosen = quality.labelled(hot, labels, most_rows=500)
    rows = chosen.collect()
    learning = labels.filter(~quality.held_out(F.col("doc_id"))).select("doc_id", F.xxhash64("doc_id").alias("h"))
    want = [r.doc_id for r in learning.orderBy("h").limit(500).collect()]
    assert 500 <= len(rows) <= 2500 and [r._key for r in sorted(rows, key=lambda r: r._order)][:500] == want
    assert quality.labelled(keys.limit(0), labels).count() == 0


def test_held_out_scores(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    base = max(np.mean([r.quality for r in rows]), 1 - np.mean([r.quality for r in rows]))
    assert right > 0.97 and right > base
    kept = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}


@pytest.mark.parametrize("depth", [1, 3])
def test_first_split_by_brute_force(depth):
    """The first cut of the first tree is the one that lowers the squared error of the residuals most."""
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 8, (300, 4)).astype(np.float32)
    y = (x[:, 2] + rng.normal(scale=1.5, size=300) > 4).astype(float)
    forest = quality.fit(x, y, trees=1, depth=depth)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda side: g[side].sum() ** 2 / (h[side].sum() + 1)
    best = max((gain(x[:, f] <= c) + gain(x[:, f] > c), -f, -c) for f in range(4) for c in np.unique(x[:, f])[:-1])
    root = forest.roots[0]
    f, goes = forest.feature[root], x[:, forest.feature[root]] <= forest.threshold[root]
    assert gain(goes) + gain(~goes) == pytest.approx(best[0], rel=0.02) and f == -best[1]
