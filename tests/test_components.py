"""Components of stars, chains and random graphs; no task gathers a hub."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import components
from lumenfold.operators.components import connected_components


def brute(links):
    root = {}
    for x in {x for link in links for x in link}:
        root[x] = x

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot", [2, 256])
def test_random_graphs(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_ROWS", hot)
    rng = random.Random(hot)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(80)] + [(5, 5)]
    got = connected_components(spark.createDataFrame([*links, *links[:20], (None, 3), (4, None)], "a long, b long").repartition(5)).collect()
    assert {r["node"]: r["component"] for r in got} == brute(links) and len(got) == len(brute(links))


def test_chain_settles_in_rounds_of_its_logarithm(spark, monkeypatch):
    rng = random.Random(1)
    names = list(range(3000))
    rng.shuffle(names)
    links = list(zip(names, names[1:]))
    rounds = []
    monkeypatch.setattr(components, "_mark", lambda edges, old=components._mark: rounds.append(0) or old(edges))
    got = connected_components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert {r["component"] for r in got} == {0} and len(got) == 3000 and len(rounds) <= 16


def test_text_nodes_and_empty_tables(spark):
    got = connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")).collect()
    assert {r["node"]: r["component"] for r in got} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert [tuple(r) for r in connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).collect()] == [(3, 3)]


def test_a_hub_of_a_million_links_is_met_by_a_broadcast(spark):
    """After the lookup of minima, rows lie as they were dealt: no task has more than twice the median."""
    leaves = 1_000_000
    edges = spark.range(1, leaves + 1).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")).repartition(8)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("v > u")
    near = components.written(both.groupBy("u").agg(F.min("u").alias("m"), F.count("*").alias("n")), "near")
    met = components.meet(both, near, F.col("n") > components.hot_limit(leaves), "u")
    sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == leaves and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = connected_components(edges, "u", "v").groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [(0, leaves + 1)]
