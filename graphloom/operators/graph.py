"""Graph measures as loops of joins and aggregates; each round is written out to cut its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.confidence import strength
from graphloom.session import materialize, release


def undirected(edges: DataFrame, floor: float = 0.001) -> DataFrame:
    """(a, b, w): parallel edges merged on the unordered pair, self-loops dropped, weights floored."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.greatest("w", F.lit(floor)).alias("w"))
    return pair.groupBy("a", "b").agg(F.sum("w").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))))


def project(edges: DataFrame, least_confidence: float, most_nodes: int) -> DataFrame:
    """The strongest part of a graph: edges above a confidence, among the nodes of highest weighted degree."""
    kept = edges.where(F.col("confidence") >= least_confidence).select("src", "dst", strength(F.col("weight"), F.col("confidence")).alias("w"))
    degree = both_ways(undirected(kept)).groupBy("src").agg(F.sum("w").alias("degree"))
    top = degree.orderBy(F.desc("degree"), "src").limit(most_nodes).select("src")  # bounded by most_nodes
    return kept.join(top, "src", "left_semi").join(top.withColumnRenamed("src", "dst"), "dst", "left_semi")


def pagerank(edges: DataFrame, rounds: int = 12, damping: float = 0.85) -> DataFrame:
    """(node, rank), un-normalised: starts at 1, (1 - d) + d * sum; dangling rank is lost."""
    out = edges.select("src", "dst")
    degree = out.groupBy("src").agg(F.count("*").alias("out"))
    links, links_path = materialize(out.join(degree, "src"), "rank-links")
    nodes, nodes_path = materialize(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "rank-nodes")
    rank, rank_path = nodes.withColumn("rank", F.lit(1.0)), None
    for _ in range(rounds):
        sent = links.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = nodes.join(sent, F.col("node") == F.col("dst"), "left").select("node", ((1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new, new_path = materialize(new, "rank")
        if rank_path:
            release(edges.sparkSession, rank_path)
        rank, rank_path = new, new_path
    return rank


def pagerank_normalised(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) that adds up to 1: weighted links, the rank of dangling nodes spread over all."""
    total = edges.groupBy("src").agg(F.sum("w").alias("total"))
    links, _ = materialize(edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "rank-links")
    nodes, _ = materialize(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "rank-nodes")
    n = nodes.count()
    dangling = nodes.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("dangling", F.lit(True))
    marked, _ = materialize(nodes.join(dangling, "node", "left").select("node", F.coalesce("dangling", F.lit(False)).alias("dangling")), "rank-marked")
    rank, rank_path = marked.withColumn("rank", F.lit(1.0 / max(n, 1))), None
    for _ in range(rounds):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = links.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = (1 - damping) / max(n, 1) + damping * lost / max(n, 1)
        new = marked.join(sent, F.col("node") == F.col("dst"), "left").select("node", "dangling", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new, new_path = materialize(new, "rank")
        if rank_path:
            release(edges.sparkSession, rank_path)
        rank, rank_path = new, new_path
    return rank.select("node", "rank")


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, label): synchronous, unweighted votes of all incident edges, ties to the smallest label."""
    votes, _ = materialize(
        edges.where("src <> dst").select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))), "lpa-votes"
    )
    labels, path = materialize(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")), "lpa")
    for _ in range(rounds):
        counted = votes.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = counted.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("new"))
        moved, new_path = materialize(labels.join(best, F.col("node") == F.col("src"), "left").select("node", "label", F.coalesce("new", "label").alias("new")), "lpa")
        changed = not moved.where("new <> label").isEmpty()
        release(edges.sparkSession, path)
        labels, path = moved.select("node", F.col("new").alias("label")), new_path
        if not changed:
            break
    return labels


def name_partition(labels: DataFrame) -> DataFrame:
    """(node, community): groups called c000, c001, … by size, then by their first member."""
    groups = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    ranked = groups.withColumn("no", F.row_number().over(W.orderBy(F.desc("n"), "first")) - 1)
    return labels.join(ranked, "label").select("node", F.concat(F.lit("c"), F.lpad(F.col("no").cast("string"), 3, "0")).alias("community"))


def distances(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hops): nodes within ``hops`` undirected steps of ``start`` (node)."""
    near, _ = materialize(edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct(), "bfs-links")
    seen, path = materialize(start.select("node").distinct().withColumn("hops", F.lit(0)), "bfs")
    for step in range(1, hops + 1):
        edge = seen.where(F.col("hops") == step - 1).join(near, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        grown, new_path = materialize(seen.unionAll(edge.join(seen, "node", "left_anti").withColumn("hops", F.lit(step))), "bfs")
        release(edges.sparkSession, path)
        seen, path = grown, new_path
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, hops: int = 6) -> DataFrame:
    """(hop, node) of the shortest undirected path, of equals the lexicographically smallest; else empty."""
    near, _ = materialize(edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct(), "path-links")
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = front.select("node")
    for _ in range(hops + 1):
        found = front.where(F.col("node") == target).limit(1)
        if not found.isEmpty():
            return found.select(F.posexplode("path").alias("hop", "node"))
        step = front.join(near, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        front, _ = materialize(best, "path")
        if front.isEmpty():
            break
        seen = seen.unionAll(front.select("node"))
    return spark.createDataFrame([], "hop int, node string")


def core(edges: DataFrame, k: int) -> DataFrame:
    """(node): members of the k-core of the simple undirected graph, by peeling."""
    pairs, path = materialize(undirected(edges.withColumn("w", F.lit(1.0))).select("a", "b"), "core")
    while True:
        degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
        weak = degree.where(F.col("count") < k).select("node")
        if weak.isEmpty():
            return degree.select("node")
        left, new_path = materialize(pairs.join(weak, F.col("a") == F.col("node"), "left_anti").join(weak, F.col("b") == F.col("node"), "left_anti"), "core")
        release(edges.sparkSession, path)
        pairs, path = left, new_path


def betweenness(edges: DataFrame, most_edges: int = 50_000) -> DataFrame:
    """(node, betweenness): Brandes on the undirected graph, parallel edges counting as separate paths.

    Each task takes some sources over a compact copy of the adjacency, so work is spread by source. The copy
    is collected only after its edges are counted: a graph of more than ``most_edges`` is an error, and has to
    go through ``project`` first. Scores are halved per pair and normalised by (n - 1)(n - 2).
    """
    import numpy as np
    import pyarrow as pa

    spark = edges.sparkSession
    pairs, _ = materialize(edges.where("src <> dst").select("src", "dst"), "between-pairs")
    if pairs.count() > most_edges:
        raise ValueError(f"betweenness takes {most_edges} edges at most; project the graph first")
    pairs = pairs.toPandas()
    names = sorted(set(pairs.src) | set(pairs.dst))
    if len(names) < 3:
        return spark.createDataFrame([(n, 0.0) for n in names], "node string, betweenness double")
    place = {n: i for i, n in enumerate(names)}
    a, b = pairs.src.map(place).to_numpy(), pairs.dst.map(place).to_numpy()
    heads, tails = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(heads, kind="stable")
    bounds = np.searchsorted(heads[order], np.arange(len(names) + 1))
    graph = spark.sparkContext.broadcast((bounds, tails[order]))
    n = len(names)

    def run(batches):
        starts, ends = graph.value
        total = np.zeros(n)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                depth = np.full(n, -1)
                paths = np.zeros(n)
                depth[s], paths[s] = 0, 1.0
                layers = [np.array([s])]
                while len(layers[-1]):
                    front = layers[-1]
                    reach = np.concatenate([ends[starts[v] : starts[v + 1]] for v in front])
                    origin = np.repeat(front, starts[front + 1] - starts[front])
                    fresh = np.unique(reach[depth[reach] < 0])
                    depth[fresh] = depth[front[0]] + 1
                    down = depth[reach] == depth[front[0]] + 1
                    np.add.at(paths, reach[down], paths[origin[down]])
                    layers.append(fresh)
                owed = np.zeros(n)
                for front in reversed(layers[1:]):
                    if not len(front):
                        continue
                    reach = np.concatenate([ends[starts[v] : starts[v + 1]] for v in front])
                    origin = np.repeat(front, starts[front + 1] - starts[front])
                    up = depth[reach] == depth[origin] - 1
                    np.add.at(owed, reach[up], paths[reach[up]] / paths[origin[up]] * (1 + owed[origin[up]]))
                owed[s] = 0
                total += owed
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64)), pa.array(total)], names=["at", "part"])

    tasks = spark.range(n).repartition(min(n, 64))
    parts = tasks.mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("sum"))
    named = spark.createDataFrame([(i, name) for i, name in enumerate(names)], "at long, node string")
    return parts.join(named, "at").select("node", (F.col("sum") / ((n - 1) * (n - 2))).alias("betweenness"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """(node): cut vertices, found for each connected component on its own."""
    import pandas as pd

    from graphloom.operators.components import connected_components

    parts = connected_components(edges)
    local = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    tagged = local.join(parts, F.col("src") == F.col("vertex")).select("component", "src", "dst")

    def cuts(group: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for x, y in zip(group.src, group.dst):
            near.setdefault(x, []).append(y)
            near.setdefault(y, []).append(x)
        seen: dict = {}
        low: dict = {}
        found = set()
        root = min(near)
        seen[root] = low[root] = 0
        stack, clock, branches = [(root, None, iter(sorted(near[root])))], 1, 0
        while stack:
            node, parent, rest = stack[-1]
            after = next(rest, None)
            if after is None:
                stack.pop()
                if stack:
                    above = stack[-1][0]
                    low[above] = min(low[above], low[node])
                    if above == root:
                        branches += 1
                    elif low[node] >= seen[above]:
                        found.add(above)
            elif after not in seen:
                seen[after] = low[after] = clock
                clock += 1
                stack.append((after, node, iter(sorted(near[after]))))
            elif after != parent:
                low[node] = min(low[node], seen[after])
        if branches > 1:
            found.add(root)
        return pd.DataFrame({"node": sorted(found)}, dtype=object)

    return tagged.groupBy("component").applyInPandas(cuts, "node string")


def strong_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest member.

    Forward and backward smallest labels are spread until they settle; nodes on which both agree
    are done with that component, the others go round again.
    """
    spark = edges.sparkSession
    left, _ = materialize(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "scc-nodes")
    links, _ = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc-links")
    done = spark.createDataFrame([], "node string, component string")
    for _ in range(rounds):
        if left.isEmpty():
            break
        forward = _spread(left, links, "src", "dst")
        backward = _spread(left, links, "dst", "src")
        both = forward.withColumnRenamed("label", "f").join(backward.withColumnRenamed("label", "b"), "node")
        settled, _ = materialize(both.where("f = b").select("node", F.col("f").alias("component")), "scc-done")
        done = done.unionAll(settled)
        rest, _ = materialize(both.where("f <> b").select("node", "f", "b"), "scc-rest")
        ends = links.join(rest.select(F.col("node").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), "src").join(
            rest.select(F.col("node").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2")), "dst"
        )
        # members of one component agree on both labels, so other edges can go
        links, _ = materialize(ends.where("f1 = f2 AND b1 = b2").select("src", "dst"), "scc-links")
        left = rest.select("node")
    return done


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(component, members): strongly connected components of two members or more, and single ones that point to themselves."""
    parts, _ = materialize(strong_components(edges), "scc-all")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    groups = parts.join(loops, "node", "left").groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.bool_or(F.coalesce("loop", F.lit(False))).alias("loop"))
    return groups.where((F.size("members") > 1) | F.col("loop")).select("component", "members")


def shortest_cycles(edges: DataFrame, parts: DataFrame, most: int = 12) -> DataFrame:
    """(component, cycle): the shortest cycle of ``most`` hops at most through the smallest member of each component.

    All components are searched side by side, a hop a round; of equally short paths to a node the
    lexicographically smallest goes on. A member that points to itself alone has none.
    """
    spark = edges.sparkSession
    parts, _ = materialize(parts, "cycle-parts")
    a, b = (parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part")) for x in ("src", "dst"))
    inside, _ = materialize(edges.where("src <> dst").select("src", "dst").distinct().join(a, "src").join(b, "dst").where("src_part = dst_part").select("src", "dst", F.col("src_part").alias("component")), "cycle-links")
    heads = inside.groupBy("component").agg(F.min(F.least("src", "dst")).alias("head"))
    front, path = materialize(heads.select("component", "head", F.col("head").alias("node"), F.array("head").alias("path")), "cycle-front")
    seen, seen_path = materialize(front.select("component", "node"), "cycle-seen")
    done = spark.createDataFrame([], "component string, cycle array<string>")
    for _ in range(most):
        step = front.join(inside.select("component", F.col("src").alias("node"), "dst"), ["component", "node"]).select("component", "head", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best, best_path = materialize(step.groupBy("component", "head", "node").agg(F.min("path").alias("path")), "cycle-step")
        closed, _ = materialize(best.where("node = head").select("component", F.col("path").alias("cycle")), "cycle-done")
        done = done.unionAll(closed)
        left = best.where("node <> head").join(closed.select("component"), "component", "left_anti").join(seen, ["component", "node"], "left_anti")
        grown, grown_path = materialize(left.select("component", "head", "node", "path"), "cycle-front")
        both, both_path = materialize(seen.unionAll(grown.select("component", "node")), "cycle-seen")
        for old in (path, seen_path, best_path):
            release(spark, old)
        front, path, seen, seen_path = grown, grown_path, both, both_path
        if front.isEmpty():
            break
    return done


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: three nodes that are all linked, each once.

    Links go from the node of lower degree to that of higher, so no node starts many, however many it has.
    """
    pairs, _ = materialize(undirected(edges).select("a", "b"), "triangle-pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    ranked = pairs.join(degree.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    low = F.struct(F.col("na"), F.col("a")) < F.struct(F.col("nb"), F.col("b"))
    links, _ = materialize(ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.struct("nb", "b")).otherwise(F.struct(F.col("na").alias("nb"), F.col("a").alias("b"))).alias("v")), "triangle-links")
    wedges = links.join(links.select("u", F.col("v").alias("w")), "u").where("v < w").select("u", F.col("v.b").alias("v"), F.col("w.b").alias("w"))
    closed = wedges.join(links.select(F.col("u").alias("v"), F.col("v.b").alias("w")), ["v", "w"], "left_semi")
    three = F.array_sort(F.array("u", "v", "w"))
    return closed.select(three.alias("t")).select(*(F.get("t", F.lit(i)).alias(n) for i, n in enumerate("abc")))


def _spread(nodes: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    labels, path = materialize(nodes.select("node", F.col("node").alias("label")), "scc-label")
    while True:
        sent = links.join(labels, F.col(source) == F.col("node")).groupBy(F.col(target).alias("to")).agg(F.min("label").alias("low"))
        new, new_path = materialize(labels.join(sent, F.col("node") == F.col("to"), "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("new")), "scc-label")
        changed = not new.where("new <> label").isEmpty()
        release(nodes.sparkSession, path)
        labels, path = new.select("node", F.col("new").alias("label")), new_path
        if not changed:
            return labels


#: The weights of rank, betweenness and incoming control in a node's score.
BLEND = {"pagerank": 0.5, "betweenness": 0.3, "in_degree": 0.2}


def blend(nodes: DataFrame, weights: dict[str, float] = BLEND, name: str = "score") -> DataFrame:
    """Add the weighted mean of some columns, each divided by its largest value; rounded once, to six digits."""
    most = nodes.agg(*(F.max(c).alias(f"most_{c}") for c in weights))  # one row
    total = sum(weights.values())
    share = [F.lit(w / total) * F.coalesce(F.col(c) / F.nullif(F.col(f"most_{c}"), F.lit(0.0)), F.lit(0.0)) for c, w in weights.items()]
    return nodes.crossJoin(F.broadcast(most)).select(*nodes.columns, F.round(sum(share[1:], share[0]), 6).alias(name))
