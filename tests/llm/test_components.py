import random

import pytest

from quern.llm.components import components

RANDOM = random.Random(3)
GRAPHS = {
    "random": [(RANDOM.randrange(300), RANDOM.randrange(300)) for _ in range(250)],
    "path": [(i, i + 1) for i in range(200)],
    "star, loops and repeats": [(0, i) for i in range(1, 50)] + [(7, 0), (5, 5), (3, 4), (3, 4)],
    "two stars and a bridge": [(100, i) for i in range(101, 130)] + [(50, i) for i in range(60, 90)] + [(89, 129)],
    "negative": [(-5, 3), (3, -9), (8, 7)],
    "none": [],
    "only a loop": [(1, 1)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_roots_are_the_least_nodes(spark, name):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in GRAPHS[name]:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    rows = components(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()
    got = {r.node: r.root for r in rows if r.node != r.root}
    assert got == want and len(rows) == len({r.node for r in rows})
