"""Connected components against union by hand: chains, hubs with the least and the greatest id, cliques, loops, nulls."""

import random

import pytest

from weftspark.llm.components import components


def plain(edges):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(top)}


DRAW = random.Random(5)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(40)],
    "least hub": [(0, i) for i in range(1, 300)] + [(500, 501)],
    "greatest hub": [(1000, i) for i in range(300)] + [(2000, 2001), (2001, 2002)],
    "two hubs": [(150, i) for i in range(300) if i != 150] + [(900, i) for i in range(600, 800)] + [(299, 600)],
    "clique": [(i, j) for i in range(20) for j in range(i)] * 2,
    "random": [(DRAW.randrange(200), DRAW.randrange(200)) for _ in range(120)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_equal_union(spark, name):
    edges = [(a, b) for a, b in GRAPHS[name] if a != b]
    rows = GRAPHS[name] + [(7_000, 7_000), (None, 1), (1, None)]
    got = [tuple(r) for r in components(spark.createDataFrame(rows, "a long, b long")).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == plain(edges)
