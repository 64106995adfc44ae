import random

import pytest

from pagefold.llm import components
from pagefold.llm.components import connected


def least_members(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_components_of_random_graphs_paths_and_hubs(spark, monkeypatch, size):
    monkeypatch.setattr(components, "PARTITION_EDGES", size)
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + rng.randrange(1, 90)) for _ in range(120)]
    pairs += pairs[:20] + [(5, 5)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    want = least_members([p for p in pairs if p[0] != p[1]])
    assert got.keys() == want.keys()
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in got for b in got if a < b and (a + b) % 7 == 0)
    assert all(want[got[n]] == want[n] for n in got)


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
