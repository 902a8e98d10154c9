"""Connected components against a plain union-find."""

import random

import pytest

from gridspark.graph import connected_components


def brute(edges):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for s, d in edges:
        s, d = find(s), find(d)
        parent[max(s, d)] = min(s, d)
    return {v: find(v) for v in parent}


CASES = {
    "chain": [(i, i + 1) for i in range(400)],
    "two arms": [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1001 + i) for i in range(300)] + [(300, 1300)],
    "star": [(10_000, i) for i in range(300)],
    "random": [(random.Random(i).randrange(500), random.Random(-i - 1).randrange(500)) for i in range(350)],
}


@pytest.mark.parametrize("name", CASES)
def test_matches_union_find(spark, name):
    edges = [(s, d) for s, d in CASES[name] if s != d]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges * 2, "src long, dst long")).collect()}
    assert got == brute(edges)


def test_empty_null_and_self_edges(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (3, None)], "src long, dst long")
    assert connected_components(df).collect() == []


def test_struct_nodes(spark):
    df = spark.sql("select struct(1L as g, 5L as n) as src, struct(1L as g, 2L as n) as dst")
    assert {r.component.n for r in connected_components(df).collect()} == {2}
