"""Components against a plain search: nulls, loops, repeats, long paths, hubs."""

import random

from intake.llm.components import connected_components


def plain(edges):
    first = {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            first.setdefault(u, u)
            first.setdefault(v, v)
    moved = True
    while moved:
        moved = False
        for u, v in edges:
            if u in first and v in first and first[u] != first[v]:
                first[u] = first[v] = min(first[u], first[v])
                moved = True
    return first


def check(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert {r.node: r.component for r in got} == plain(edges) and len(got) == len({r.node for r in got})


def test_odd_edges(spark):
    check(spark, [(1, 2), (2, 1), (2, 2), (None, 3), (4, None), (None, None), (5, 5), (9, 7), (-3, 9), (1, 2)])
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_a_long_path(spark):
    ids = random.Random(1).sample(range(10**6), 600)
    check(spark, list(zip(ids, ids[1:])))


def test_random_graph(spark):
    rng = random.Random(2)
    check(spark, [(rng.randrange(400), rng.randrange(400)) for _ in range(300)])


def test_a_hub_of_very_many_links(spark):
    edges = spark.range(1, 40_000).selectExpr("id AS u", "0L AS v").unionByName(spark.range(50_000, 50_010).selectExpr("id AS u", "id + 1 AS v"))
    got = connected_components(edges).groupBy("component").count().collect()
    assert sorted((r.component, r["count"]) for r in got) == [(0, 40_000), (50_000, 11)]
