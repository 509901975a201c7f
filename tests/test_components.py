"""Components in few rounds, traversal to the end."""

from __future__ import annotations

import random

from weftline.operators import graph as G


def test_a_long_path_takes_few_rounds(spark):
    rng = random.Random(6)
    names = list(range(3000))
    rng.shuffle(names)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(names, names[1:], strict=False)] + [(5000, 5001), (6000, 6000)]
    rounds: list[int] = []
    labels = {r.node: r.label for r in G.components(spark.createDataFrame(edges, "src long, dst long"), rounds).collect()}
    assert labels == {**dict.fromkeys(names, 0), 5000: 5000, 5001: 5000, 6000: 6000}
    assert len(rounds) <= 20


def test_reach_of_roots(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "e"), ("x", "x")], "src string, dst string")
    roots = spark.createDataFrame([("c",), ("lone",), ("x",)], "id string")
    assert {r.node for r in G.undirected_reach(edges, roots).collect()} == {"a", "b", "c", "lone", "x"}
    assert G.undirected_reach(edges.where("false"), roots.where("false")).count() == 0


def test_traversal_without_a_bound(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "t") for i in range(30)], "src string, dst string, type string")
    roots = spark.createDataFrame([("n0",)], "root string")
    assert G.reach(edges, roots).agg({"depth": "max"}).first()[0] == G.UNBOUNDED
    assert G.reach(edges, roots, None).agg({"depth": "max"}).first()[0] == 30
    assert G.shortest_hops(edges, spark.createDataFrame([("n30", "n0")], "a string, b string"), None).first().hops == 30
