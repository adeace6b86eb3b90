"""Walks, paths, pruning and request limits on small tables, against brute force."""

import datetime
import itertools
import random

from graphloom.operators import walks
from graphloom.streaming.limits import admitted


def test_control_walk(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(7)]
    links = {(rng.choice(names), rng.choice(names)): rng.randrange(200_000, 1_000_001, 1000) for _ in range(24)}
    links = {p: s for p, s in links.items() if p[0] != p[1]}
    edges = spark.createDataFrame([(a, b, s / 1e6) for (a, b), s in links.items()] + [("n0", "n0", 1.0), (None, "n1", 1.0)], "src string, dst string, strength double")
    starts = spark.createDataFrame([("n0",), ("n1",), ("n1",), (None,)], "person string")
    want = {}
    for person in ("n0", "n1"):
        front = [(person, 10_000, (person,))]
        for depth in range(4):
            best = {}
            for node, got, path in front:
                for (a, b), s in links.items():
                    if a == node and b != person:
                        down = 10**6 * 10**depth
                        new = (2 * got * s * 7**depth + down) // (2 * down)
                        if new > 100 and (b not in best or (-new, path + (b,)) < (-best[b][0], best[b][1])):
                            best[b] = (new, path + (b,))
            best = {b: v for b, v in best.items() if (person, b) not in want or v[0] > want[person, b][0]}
            for b, (new, path) in best.items():
                want[person, b] = (new, depth + 1, path)
            front = [(b, new, path) for b, (new, path) in best.items()]
    got = {(r.person, r.target): (round(r.strength * 10_000), r.hops, tuple(r.path)) for r in walks.control_walk(edges, starts).collect()}
    assert got == want and max(v[1] for v in want.values()) > 1
    assert walks.control_walk(edges.limit(0), starts).collect() == []


def test_cheapest_paths(spark):
    rng = random.Random(9)
    names = [f"n{i}" for i in range(6)]
    links = {p: rng.randrange(5, 100) / 100 for p in itertools.combinations(names, 2) if rng.random() < 0.7}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()] + [("n0", "n0", 1.0)], "src string, dst string, w double")
    price = {k: round((1.05 - w) * 1e6) for (a, b), w in links.items() for k in ((a, b), (b, a))}
    want = []
    for n in range(4):
        for middle in itertools.permutations(names[1:5], n):
            path = ("n0", *middle, "n5")
            if all(p in price for p in zip(path, path[1:])):
                want.append((sum(price[p] for p in zip(path, path[1:])), path))
    got = [(round(r.cost * 1e6), tuple(r.path)) for r in walks.cheapest_paths(edges, "n0", "n5").collect()]
    assert got == sorted(want)[:3]
    assert walks.cheapest_paths(edges, "n0", "nowhere").collect() == []


def test_prune_runs_again_only_above_its_target(spark):
    day = datetime.date(2020, 1, 1)
    nodes = spark.createDataFrame([(k, day) for k in "abcd"] + [("e", None), ("f", datetime.date(2020, 12, 30))], "key string, last_seen date")
    edges = spark.createDataFrame([("a", "b", 0.2), ("b", "c", 0.35), ("c", "d", 0.9)], "src string, dst string, w double")
    found = lambda limit: {r.key: r["round"] for r in walks.prune(nodes, edges, "2020-12-31", limit).collect()}
    assert found(100) == {"a": 1}
    assert found(7) == {"a": 1, "b": 2, "c": 2}


def test_token_bucket(spark):
    rng = random.Random(3)
    day = 86_400_000
    asked = sorted((rng.choice("xyx"), rng.randrange(0, 5 * day, 1000), i, rng.randrange(1, 5)) for i in range(400))
    got = {r.id: r.wait_ms for r in admitted(spark.createDataFrame([(h, i, at, c) for h, at, i, c in asked] + [("x", 999, None, 1)], "host string, id long, at long, cost long"), day // 300, 3).collect()}
    want = {}
    for host in "xy":
        tokens, last = 3.0, 0
        for h, at, i, cost in asked:
            if h != host:
                continue
            now, cost = max(at, last), min(cost, 3)
            tokens = min(3.0, tokens + (now - last) * 300 / day)
            wait = max(0.0, (cost - tokens) * day / 300)
            tokens, last = tokens + wait * 300 / day - cost, now + wait
            want[i] = last - at
    assert set(got) == set(want) and max(want.values()) > 0
    assert all(abs(got[i] - want[i]) < 1 for i in want)
