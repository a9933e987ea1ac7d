import random

import pytest

from classyard.llm import components as C


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(3)
    yield [(rng.randrange(-60, 200), rng.randrange(-60, 200)) for _ in range(130)] + [(7, 7), (900, 900)]
    yield [(k, k + 1) for k in range(70)]                                        # a long path
    order = rng.sample(range(60), 60)
    yield list(zip(order, order[1:]))                                            # in no order
    yield [(99, k) for k in range(40)] + [(k, 99) for k in range(20)]            # a star around its largest node
    yield []


@pytest.mark.parametrize("edges", list(graphs()))
def test_components_equal_union_find(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = C.components(df).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.label for r in got} == union_find(edges)


def test_an_edge_is_joined_once(spark, monkeypatch):
    """Edges inside what is one component already are not read again in later rounds."""
    rows = []

    def counted(df, name):
        df = C_stored(df, name)
        if name == "cc-edges":
            rows.append(df.count())
        return df
    C_stored = C.stored
    monkeypatch.setattr(C, "stored", counted)
    edges = [(a, b) for g in range(6) for a in range(g * 100, g * 100 + 15) for b in range(a + 1, g * 100 + 15)]
    edges += [(g * 100 + 14, g * 100 + 100) for g in range(5)]
    assert {r.label for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}
    assert rows[0] == len(edges) and sum(rows) < 1.2 * len(edges)
