import numpy as np
import pytest

from velumen.llm.graph import components
from velumen.llm.scratch import Scratch


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_components(spark, kind):
    rng = np.random.default_rng(4)
    ids = rng.permutation(300).tolist()
    edges = {
        "path": list(zip(ids, ids[1:], strict=False)),
        "star": [(ids[0], x) for x in ids[1:]] * 2,
        "random": [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(180)],
        "loops": [(6, 6), (7, 6), (6, 7)],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark, "g")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "g")).collect() == []


def test_nulls_loops_and_repeated_edges(spark):
    rows = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (4, None), (None, None), (-5, 2), (7, 8)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components(edges, Scratch(spark, "test")).collect()}
    assert {k: v for k, v in got.items() if k != 3} == {1: -5, 2: -5, -5: -5, 7: 7, 8: 7} and got.get(3, 3) == 3
    assert components(edges.where("a is null"), Scratch(spark, "test")).collect() == []
