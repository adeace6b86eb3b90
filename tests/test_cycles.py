"""Triangles, cycles and the bound of betweenness on small graphs, against brute force."""

import itertools
import random

import pytest

from graphloom.operators import graph


def test_triangles(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted((f"n{rng.randrange(12)}", "hub" if rng.random() < 0.3 else f"n{rng.randrange(12)}"))) for _ in range(45)}
    pairs = {p for p in pairs if p[0] != p[1]}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 2.0) for a, b in list(pairs)[:5]] + [("x", "x", 1.0)], "src string, dst string, w double")
    nodes = sorted({n for p in pairs for n in p})
    want = {t for t in itertools.combinations(nodes, 3) if all(p in pairs for p in itertools.combinations(t, 2))}
    got = [tuple(r) for r in graph.triangles(edges).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_cycles(spark):
    links = [("b", "c"), ("c", "a"), ("a", "b"), ("a", "c"), ("c", "d"), ("d", "d"), ("e", "f"), ("f", "e"), ("e", "f"), ("f", "g")]
    edges = spark.createDataFrame(links, "src string, dst string")
    parts = graph.strong_components(edges)
    groups = {r.component: list(r.members) for r in graph.cycle_groups(edges).collect()}
    assert groups == {"a": ["a", "b", "c"], "d": ["d"], "e": ["e", "f"]}
    cycles = {r.component: list(r.cycle) for r in graph.shortest_cycles(edges, parts).collect()}
    assert cycles == {"a": ["a", "c", "a"] if ("c", "a") in links and ("a", "c") in links else None, "e": ["e", "f", "e"]}
    assert graph.shortest_cycles(edges, parts, most=1).collect() == []


def test_betweenness_counts_before_it_collects(spark):
    path = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert {r.node: r.betweenness for r in graph.betweenness(path).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    with pytest.raises(ValueError, match="project"):
        graph.betweenness(path, most_edges=1)
