"""Queries of control walks, cheapest paths, merges by the largest confidence, pruning and request limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph, walks
from graphloom.plans.graphs import CHAIN_SQL, RINGS_SQL, chain, flows, rings
from graphloom.plans.registry import query
from graphloom.sources.relational import EDGES_SQL, ENTITIES_SQL, edges, entities, table
from graphloom.streaming.limits import admitted, planned

_DEPTHS = " ".join(f"WHEN {d} THEN {walks.decayed('w.got', 'c.edge', d).replace('DIV', '//')}" for d in range(1, walks.HOPS))

#: Contracts and operations that are nearly sure, and rings of orders; persons and orders start walks.
_CONTROL_SQL = (
    f"WITH RECURSIVE {EDGES_SQL}, {RINGS_SQL}, ring AS (SELECT node AS src, CASE WHEN c % 3 <> 0 THEN coalesce(lead(node) OVER o, first_value(node) OVER o) WHEN pos = 0 THEN lead(node) OVER o END AS dst, "
    "0.5 + (CAST(substring(node, 2) AS BIGINT) % 50) / 100 AS s FROM seat WINDOW o AS (PARTITION BY c ORDER BY pos)), "
    "control AS (SELECT src, dst, max(CAST(round(s * 1000000) AS BIGINT)) AS edge FROM (SELECT subject AS src, object AS dst, confidence AS s FROM edges WHERE confidence >= 0.85 UNION ALL SELECT * FROM ring WHERE dst IS NOT NULL) WHERE src <> dst GROUP BY 1, 2), "
    f"walk AS (SELECT src AS person, dst AS target, {walks.decayed('10000', 'edge', 0).replace('DIV', '//')}::BIGINT AS got, 1 AS hops, [src, dst] AS path FROM control WHERE src[1] IN ('P', 'D') "
    f"UNION ALL SELECT person, dst, (CASE hops {_DEPTHS} END)::BIGINT, hops + 1, list_append(path, dst) FROM walk w JOIN control c ON w.target = c.src WHERE hops < 4 AND dst <> person AND got > 100), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY person, target ORDER BY got DESC, hops, path) AS k FROM walk WHERE got > 100) "
    "SELECT person, target, got / 10000.0::DOUBLE AS strength, hops::INTEGER AS hops, array_to_string(path, '>') AS path FROM best WHERE k = 1"
)


@query(_CONTROL_SQL)
def g16_control_walk(spark, d):
    """Walks of up to four hops from every person and every order."""
    sure = edges(spark, d).where("confidence >= 0.85").select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("confidence").alias("strength"))
    ring = rings(spark, d).select("src", "dst", (0.5 + F.substring("src", 2, 20).cast("long") % 50 / 100).alias("strength"))
    control = sure.unionAll(ring)
    starts = control.where("src LIKE 'P%' OR src LIKE 'D%'").select(F.col("src").alias("person"))
    return walks.control_walk(control, starts).withColumn("path", F.array_join("path", ">"))


@query(
    f"WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src, dst, CAST(round((1.05::DOUBLE - max(w)) * 1000000) AS BIGINT) AS price FROM (SELECT subject AS src, object AS dst, confidence AS w FROM edges WHERE predicate = 'OPERATES' "
    "UNION ALL SELECT object, subject, confidence FROM edges WHERE predicate = 'OPERATES') GROUP BY 1, 2), s AS (SELECT 'O1' AS node, ['O1'] AS path, 0::BIGINT AS cost UNION ALL "
    "SELECT b.dst, list_append(s.path, b.dst), s.cost + b.price FROM s JOIN b ON s.node = b.src WHERE len(s.path) <= 4 AND s.node <> 'O2' AND NOT list_contains(s.path, b.dst) AND (len(s.path) < 4 OR b.dst = 'O2')) "
    "SELECT cost / 1000000.0::DOUBLE AS cost, array_to_string(path, '>') AS path FROM (SELECT * FROM s WHERE node = 'O2' ORDER BY cost, path LIMIT 3)"
)
def g25_cheapest_paths(spark, d):
    """The three cheapest paths between two organisations through the craft they operate."""
    links = edges(spark, d).where("predicate = 'OPERATES'").select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("confidence").alias("w"))
    return walks.cheapest_paths(links, "O1", "O2").withColumn("path", F.array_join("path", ">"))


@query()
def g03_betweenness_by_max(spark, d):
    """Betweenness divided by its largest value."""
    strong = graph.project(flows(spark, d).select("src", "dst", (F.col("w") / 10).alias("weight"), F.lit(1.0).alias("confidence")), 0.5, 300)
    return graph.blend(graph.betweenness(strong), {"betweenness": 1.0}).select("node", F.col("score").alias("betweenness"))


@query(
    f"WITH {ENTITIES_SQL}, m AS (SELECT *, CASE WHEN mentions > 0 THEN name END AS known_as FROM entities), k AS (SELECT *, row_number() OVER (PARTITION BY entity_type, jurisdiction, community ORDER BY confidence DESC, key) AS n FROM m) "
    "SELECT entity_type, jurisdiction, community, max(CASE WHEN n = 1 THEN key END) AS winner, count(*) AS members, max(confidence) AS confidence, arg_min(known_as, n) FILTER (WHERE known_as IS NOT NULL) AS known_as, "
    "arg_min(last_seen, n) FILTER (WHERE last_seen IS NOT NULL) AS last_seen, sum(mentions)::BIGINT AS mentions FROM k GROUP BY 1, 2, 3"
)
def g35_merge_by_max(spark, d):
    nodes = entities(spark, d).withColumn("known_as", F.when(F.col("mentions") > 0, F.col("name")))
    return walks.merge_by_max(nodes, ["entity_type", "jurisdiction", "community"], ["known_as", "last_seen"], ["mentions"])


def _pass_sql(nodes: str, links: str, rule: tuple[int, float, int]) -> str:
    most, weak, age = rule
    return (
        f"SELECT key FROM {nodes} LEFT JOIN (SELECT k, count(*) AS degree, min(w) AS low FROM (SELECT src AS k, w FROM {links} UNION ALL SELECT dst, w FROM {links}) GROUP BY 1) ON key = k "
        f"WHERE seen < DATE '1998-08-02' - {age} AND (degree IS NULL OR (degree <= {most} AND low < {weak}))"
    )


@query(
    f"WITH {CHAIN_SQL}, e AS (SELECT src, dst, (CAST(substring(src, 2) AS BIGINT) % 10) / 10 AS w FROM chain), n AS (SELECT 'D' || o_orderkey AS key, o_orderdate::DATE AS seen FROM orders), a AS ({_pass_sql('n', 'e', walks.ORPHAN)}), "
    "e2 AS (SELECT * FROM e WHERE src NOT IN (FROM a) AND dst NOT IN (FROM a)), n2 AS (SELECT * FROM n WHERE key NOT IN (FROM a)), "
    f"b AS ({_pass_sql('n2', 'e2', walks.ESCALATED)}) SELECT key, 1 AS round FROM a UNION ALL SELECT key, 2 FROM b WHERE (SELECT count(*) FROM n) > {walks.TARGET} * 10000"
)
def p05_prune(spark, d):
    """Orders linked to each customer's next one, with room for 10,000 nodes."""
    nodes = table(spark, d, "orders").select(F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("key"), F.to_date("o_orderdate").alias("last_seen"))
    links = chain(spark, d).select("src", "dst", (F.substring("src", 2, 20).cast("long") % 10 / 10).alias("w"))
    return walks.prune(nodes, links, "1998-08-02", 10_000)


@query(
    "WITH r AS (SELECT event_type AS host, event_id AS id, epoch_us(ts) // 1000 AS ms, least(1 + user_id % 3, 2) AS cost FROM events), s AS (SELECT *, sum(cost) OVER w AS total FROM r WINDOW w AS (PARTITION BY host ORDER BY ms, id)), "
    "m AS (SELECT *, 600000 * total + max(ms - 600000 * (total - cost)) OVER (PARTITION BY host ORDER BY ms, id) AS due FROM s) SELECT host, id, greatest(0, due - 2 * 600000 - ms)::BIGINT AS wait_ms FROM m"
)
def r05_token_bucket(spark, d):
    """Requests of one to three tokens (the bucket holds two) to hosts that get a token in ten minutes."""
    asked = table(spark, d, "events").select(F.col("event_type").alias("host"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (1 + F.col("user_id") % 3).alias("cost"))
    return admitted(asked, interval_ms=600_000, burst=2).select("host", "id", "wait_ms")


@query(
    "WITH p AS (SELECT p_partkey AS model, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS rpm, CASE WHEN p_partkey % 3 = 0 THEN p_size // 2 END AS learned FROM part) "
    "SELECT model, CASE WHEN least(rpm, learned) = 0 THEN 0 ELSE greatest(1, floor(least(rpm, learned) * 0.8::DOUBLE)) END::BIGINT AS planned FROM p WHERE rpm IS NOT NULL"
)
def r07_planned_limits(spark, d):
    """Limits of a minute: configured (models without one are never called) or learned, whichever is lower, with a margin."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("model"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("rpm"), F.when(F.col("p_partkey") % 3 == 0, F.expr("p_size div 2")).alias("learned"))
    return p.where("rpm IS NOT NULL").select("model", planned(F.col("rpm"), F.col("learned"), 0.8).alias("planned"))
