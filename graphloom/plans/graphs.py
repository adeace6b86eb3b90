"""Queries over the graph: measures, neighbourhoods, paths, cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.confidence import strength
from graphloom.functions.hashing import cycle_id
from graphloom.operators import graph
from graphloom.operators.components import connected_components
from graphloom.plans.registry import query
from graphloom.sources.relational import EDGES_SQL, PLACES_SQL, edges, places, table

#: A directed graph over all order lines: suppliers to customers, customers to parts and parts to suppliers, by how a line ended.
FLOWS_SQL = """
flows AS (SELECT CASE l_returnflag WHEN 'N' THEN 'O' || l_suppkey WHEN 'R' THEN 'P' || o_custkey ELSE 'C' || l_partkey END AS src,
    CASE l_returnflag WHEN 'N' THEN 'P' || o_custkey WHEN 'R' THEN 'C' || l_partkey ELSE 'O' || l_suppkey END AS dst, count(*)::DOUBLE AS w
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def flows(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    firm, person, part = (F.concat(F.lit(k), F.col(c).cast("string")) for k, c in (("O", "l_suppkey"), ("P", "o_custkey"), ("C", "l_partkey")))
    ended = lambda n, r, other: F.when(F.col("l_returnflag") == "N", n).when(F.col("l_returnflag") == "R", r).otherwise(other)
    return lines.groupBy(ended(firm, person, part).alias("src"), ended(person, part, firm).alias("dst")).agg(F.count("*").cast("double").alias("w"))


#: A sparse chain of orders: each customer's order points to that customer's next one.
CHAIN_SQL = "chain AS (SELECT * FROM (SELECT 'D' || o_orderkey AS src, 'D' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"


def chain(spark, d):
    from pyspark.sql import Window as W

    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    named = lambda c: F.concat(F.lit("D"), c.cast("string"))
    return table(spark, d, "orders").withColumn("after", after).where("after IS NOT NULL").select(named(F.col("o_orderkey")).alias("src"), named(F.col("after")).alias("dst"))


#: Each customer's orders in a ring; of every third customer only the first order points to the second.
RINGS_SQL = """
seat AS (SELECT o_custkey AS c, 'D' || o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


def rings(spark, d):
    from pyspark.sql import Window as W

    by = W.partitionBy("o_custkey")
    named = lambda c: F.concat(F.lit("D"), c.cast("string"))
    first, ring = F.min("o_orderkey").over(by), F.col("o_custkey") % 3 != 0
    following = F.when(ring | (F.col("o_orderkey") == first), F.lead("o_orderkey").over(by.orderBy("o_orderkey")))
    after = F.coalesce(following, F.when(ring, first))
    return table(spark, d, "orders").withColumn("after", after).where("after IS NOT NULL").select(named(F.col("o_orderkey")).alias("src"), named(F.col("after")).alias("dst"))


_PLACES = PLACES_SQL + ", p AS (SELECT subject AS src, object AS dst, weight AS w FROM places)"


def _places(spark, d):
    return places(spark, d).select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("weight").alias("w"))


def _rank_sql(rounds: int, damping: float) -> str:
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM nodes)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS (SELECT node, {1 - damping!r} + {damping} * coalesce(got, 0) AS rank FROM nodes LEFT JOIN (SELECT dst, sum(rank / n_out) AS got FROM links JOIN r{i} ON src = node GROUP BY 1) ON node = dst)"
        )
    return f"WITH {_PLACES}, links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n_out FROM p), nodes AS (SELECT src AS node FROM p UNION SELECT dst FROM p), " + ", ".join(steps) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(12, 0.85))
def g12_pagerank(spark, d):
    return graph.pagerank(_places(spark, d)).select("node", F.round("rank", 6).alias("rank"))


def _normal_rank_sql(rounds: int, damping: float) -> str:
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT node, {1 - damping!r} / (SELECT count(*) FROM nodes) + {damping} * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM p)) / (SELECT count(*) FROM nodes) "
            f"+ {damping} * coalesce(got, 0) AS rank FROM nodes LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM links JOIN r{i} ON src = node GROUP BY 1) ON node = dst)"
        )
    return f"WITH {_PLACES}, links AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM p), nodes AS (SELECT src AS node FROM p UNION SELECT dst FROM p), " + ", ".join(steps) + f" SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@query(_normal_rank_sql(20, 0.85))
def g13_pagerank_normalised(spark, d):
    return graph.pagerank_normalised(_places(spark, d)).select("node", F.round("rank", 8).alias("rank"))


@query(
    f"WITH {FLOWS_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(greatest(w, 0.001)) AS w FROM flows WHERE src <> dst GROUP BY 1, 2"
)
def g30_undirected(spark, d):
    return graph.undirected(flows(spark, d))


_PROJECT = f"""WITH {EDGES_SQL}, k AS (SELECT subject AS src, object AS dst, least(1.0, greatest(0.05, weight)) * least(1.0, greatest(0.1, confidence)) AS w FROM edges WHERE confidence >= 0.5),
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(greatest(w, 0.001)) AS w FROM k GROUP BY 1, 2), g AS (SELECT node, round(sum(w), 6) AS degree FROM (SELECT a AS node, w FROM u UNION ALL SELECT b, w FROM u) GROUP BY 1)"""


@query(_PROJECT + " SELECT node, degree FROM g ORDER BY degree DESC, node LIMIT 100")
def g01_weighted_degree(spark, d):
    kept = edges(spark, d).where("confidence >= 0.5").select(F.col("subject").alias("src"), F.col("object").alias("dst"), strength(F.col("weight"), F.col("confidence")).alias("w"))
    degree = graph.both_ways(graph.undirected(kept)).groupBy(F.col("src").alias("node")).agg(F.round(F.sum("w"), 6).alias("degree"))
    return degree.orderBy(F.desc("degree"), "node").limit(100)


def _lpa_sql(rounds: int) -> str:
    steps = ["l0 AS (SELECT node, node AS label FROM nodes)"]
    for i in range(rounds):
        steps.append(
            f"l{i + 1} AS MATERIALIZED (SELECT n.node, coalesce(v.label, n.label) AS label FROM l{i} n LEFT JOIN (SELECT src, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k "
            f"FROM votes JOIN l{i} ON dst = node GROUP BY src, label) WHERE k = 1) v ON n.node = v.src)"
        )
    return (
        f"WITH {_PLACES}, votes AS (SELECT src, dst FROM p UNION ALL SELECT dst, src FROM p), nodes AS (SELECT src AS node FROM p UNION SELECT dst FROM p), " + ", ".join(steps)
        + f", g AS (SELECT label, 'c' || lpad((row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1)::VARCHAR, 3, '0') AS community FROM l{rounds} GROUP BY 1) SELECT node, community FROM l{rounds} JOIN g USING (label)"
    )


@query(_lpa_sql(8))
def g05_label_propagation(spark, d):
    return graph.name_partition(graph.label_propagation(_places(spark, d), 8))


@query(
    f"WITH RECURSIVE {PLACES_SQL}, p AS (SELECT subject AS src, object AS dst FROM places WHERE predicate = 'LOCATED_IN'), b AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p), "
    "c AS (SELECT src AS vertex, src AS seen FROM b UNION SELECT c.vertex, b.dst FROM c JOIN b ON c.seen = b.src) SELECT vertex, min(seen) AS component FROM c GROUP BY 1"
)
def g08_components(spark, d):
    return connected_components(places(spark, d).where("predicate = 'LOCATED_IN'").select(F.col("subject").alias("src"), F.col("object").alias("dst")))


@query(
    f"WITH RECURSIVE {PLACES_SQL}, p AS (SELECT subject AS src, object AS dst FROM places WHERE object NOT IN ('L0', 'L1') AND subject NOT IN ('L0', 'L1')), b AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p), "
    "s AS (SELECT 'R0' AS node, 0 AS hops UNION SELECT b.dst, s.hops + 1 FROM s JOIN b ON s.node = b.src WHERE s.hops < 3) SELECT node, min(hops)::INTEGER AS hops FROM s GROUP BY 1"
)
def g26_neighbourhood(spark, d):
    left = _places(spark, d).where("src NOT IN ('L0', 'L1') AND dst NOT IN ('L0', 'L1')")
    return graph.distances(left, spark.createDataFrame([("R0",)], "node string"), 3)


@query(
    f"WITH RECURSIVE {PLACES_SQL}, b AS (SELECT subject AS src, object AS dst FROM places UNION SELECT object, subject FROM places), s AS (SELECT 'L0' AS node, ['L0'] AS path UNION ALL "
    "SELECT b.dst, list_append(s.path, b.dst) FROM s JOIN b ON s.node = b.src WHERE len(s.path) <= 6 AND NOT list_contains(s.path, b.dst) AND s.node <> 'L5' AND b.dst NOT LIKE 'P%' AND b.dst NOT LIKE 'O%'), "
    "w AS (SELECT path FROM s WHERE node = 'L5' ORDER BY len(path), path LIMIT 1) SELECT (k - 1)::INTEGER AS hop, path[k] AS node FROM w, (SELECT unnest(range(1, 12)) AS k) WHERE k <= len(path)"
)
def g24_shortest_path(spark, d):
    return graph.shortest_path(_places(spark, d), "L0", "L5")


_CORE = "WITH " + FLOWS_SQL + ", u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM flows WHERE src <> dst)"


@query()
def g07_core(spark, d):
    return graph.core(flows(spark, d), 3)


@query()
def g02_betweenness(spark, d):
    """Of the strongest part of the graph."""
    strong = graph.project(flows(spark, d).select("src", "dst", (F.col("w") / 10).alias("weight"), F.lit(1.0).alias("confidence")), 0.5, 300)
    return graph.betweenness(strong).select("node", F.round("betweenness", 6).alias("betweenness"))


@query(
    f"WITH {PLACES_SQL}, b AS (SELECT subject AS src, object AS dst FROM places UNION SELECT object, subject FROM places), g AS (SELECT src AS node, count(DISTINCT dst) AS degree FROM b GROUP BY 1) "
    "SELECT node FROM g WHERE degree > 1"
)
def g06_articulation_points(spark, d):
    """In a forest of places every inner node is a cut vertex."""
    return graph.articulation_points(_places(spark, d))


@query(f"WITH {RINGS_SQL} SELECT node, CASE WHEN c % 3 <> 0 THEN min(node) OVER (PARTITION BY c) ELSE node END AS component FROM seat WHERE c % 3 <> 0 OR (n > 1 AND pos < 2)")
def g09_strong_components(spark, d):
    return graph.strong_components(rings(spark, d))


@query(
    f"WITH {RINGS_SQL}, m AS (SELECT *, min(node) OVER (PARTITION BY c) AS head FROM seat WHERE c % 3 <> 0 AND n BETWEEN 2 AND 12), h AS (SELECT *, max(CASE WHEN node = head THEN pos END) OVER (PARTITION BY c) AS hp FROM m) "
    "SELECT head AS component, array_to_string(list(node ORDER BY (pos - hp + n) % n), '|') || '|' || head AS cycle FROM h GROUP BY head"
)
def g10_shortest_cycles(spark, d):
    r = rings(spark, d)
    found = graph.shortest_cycles(r, graph.strong_components(r))
    return found.select("component", F.array_join("cycle", "|").alias("cycle"))


@query(f"WITH {RINGS_SQL}, m AS (SELECT c, list_sort(list(node)) AS m FROM seat WHERE c % 3 <> 0 GROUP BY c) SELECT substring(sha1(array_to_string(m, '|')), 1, 16) AS cycle_id, array_to_string(m, '|') AS members FROM m")
def g11_ownership_cycles(spark, d):
    """Components of more than one member, and members that point to themselves."""
    found = graph.cycle_groups(rings(spark, d))
    return found.select(cycle_id(F.col("members")).alias("cycle_id"), F.array_join("members", "|").alias("members"))


@query(
    f"WITH {EDGES_SQL}, x AS (SELECT object AS node, sum(observations)::DOUBLE AS pagerank, max(confidence) AS betweenness, count(DISTINCT subject)::DOUBLE AS in_degree FROM edges WHERE predicate = 'CONTRACTED_WITH' GROUP BY 1) "
    "SELECT node, round(0.5::DOUBLE * (pagerank / max(pagerank) OVER ()) + 0.3::DOUBLE * (betweenness / max(betweenness) OVER ()) + 0.2::DOUBLE * (in_degree / max(in_degree) OVER ()), 6) AS score FROM x"
)
def g14_blend(spark, d):
    """The three measures stand for rank, betweenness and incoming control."""
    x = edges(spark, d).where("predicate = 'CONTRACTED_WITH'").groupBy(F.col("object").alias("node")).agg(
        F.sum("observations").cast("double").alias("pagerank"), F.max("confidence").alias("betweenness"), F.countDistinct("subject").cast("double").alias("in_degree")
    )
    return graph.blend(x).select("node", "score")


@query(
    f"WITH {FLOWS_SQL}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM flows WHERE src <> dst) SELECT x.a AS a, x.b AS b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b"
)
def g28_triangles(spark, d):
    return graph.triangles(flows(spark, d))


@query(
    f"WITH {CHAIN_SQL}, g AS (SELECT src AS node FROM chain EXCEPT SELECT dst FROM chain) SELECT node FROM g"
)
def g27_chain_heads(spark, d):
    c = chain(spark, d)
    return c.select(F.col("src").alias("node")).distinct().join(c.select(F.col("dst").alias("node")), "node", "left_anti")
