"""Components against union-find."""

import random

import pytest

from ligature.llm import components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def groups(df):
    return {r.id: r.group_id for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(None, 1), (2, None), (5, 5), (7, 8), (8, 7)]
    assert groups(components.hash_to_min(spark.createDataFrame(edges, "a long, b long"))) == union_find(edges)


def test_long_chain(spark):
    edges = [(k, k + 1) for k in range(100)]
    assert groups(components.hash_to_min(spark.createDataFrame(edges, "a long, b long"))) == dict.fromkeys(range(101), 0)


def test_values(spark):
    rows = [(1, " AB", "d1"), (2, "ab\t", None), (3, "shared", "d1"), (4, "Shared", "x"), (5, None, "none"), (6, "-", "None"), (None, "ab", "d1"), (1, " AB", "d1"), (7, "solo", "solo")]
    f = spark.createDataFrame([(*r, 0) for r in rows], "article_id long, ip string, dev string, id int")
    gone = spark.createDataFrame([("ip", "SHARED "), ("ip", None), ("dev", "other")], "attr_name string, attr_value string")
    assert groups(components.groups(f, "article_id", ["ip", "dev"], gone)) == {1: 1, 2: 1, 3: 1}
    assert groups(components.groups(f, "article_id", ["ip", "dev"])) == {1: 1, 2: 1, 3: 1, 4: 1}


def test_hot_value(spark):
    rows = [(k, "hot" if k % 3 else f"v{k}", f"d{k // 50}" if k % 50 < 2 else f"u{k}") for k in range(1500)]
    f = spark.createDataFrame(rows, "article_id long, ip string, dev string")
    by = {}
    edges = []
    for k, *values in rows:
        for v in values:
            edges += [(k, by[v])] if v in by else []
            by.setdefault(v, k)
    assert groups(components.groups(f, "article_id", ["ip", "dev"])) == union_find(edges)


def test_empty(spark):
    assert components.hash_to_min(spark.createDataFrame([], "a long, b long")).count() == 0
