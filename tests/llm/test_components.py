"""Components of links against union-find."""

import random

import pytest

from quarry.llm.components import components


def _plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["random", "path", "hubs", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(110)],
        "path": [(i, i + 1) for i in range(150)],
        # a hub of largest id, one of smallest id, a repeated link, and a node between them
        "hubs": [(1000, i) for i in range(60)] + [(2000, 2001 + i) for i in range(60)] * 2 + [(1000, 2030)],
        "empty": [],
    }[shape]
    links = [(a, b) for a, b in links if a != b]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(_plain(links).items())
