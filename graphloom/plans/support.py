"""Queries over supporting operations: capacity, identifiers, reasons, decays, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.confidence import noisy_or_all, noisy_or_sql, strength
from graphloom.functions.vocab import edge_weight
from graphloom.operators import rules
from graphloom.plans.provenance import ADDRESS_SQL, j02_shared_address
from graphloom.plans.registry import query
from graphloom.sources import files
from graphloom.sources.relational import EDGES_SQL, ENTITIES_SQL, OBSERVATIONS_SQL, edges, entities, observations, table

_BOTH = f"WITH {ENTITIES_SQL}, {EDGES_SQL}"


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('machinery', 'building') AND lower(c_name) <> 'x'")
def s24_row_filters(spark, d):
    return table(spark, d, "customer").where(files.matches_filters({"c_mktsegment": ["Machinery", "BUILDING"]})).select("c_custkey")


@query(_BOTH + ", top AS (SELECT key FROM entities ORDER BY confidence DESC, key LIMIT 400) SELECT subject, object, predicate, sources FROM edges WHERE subject IN (SELECT key FROM top) AND object IN (SELECT key FROM top)")
def s36_bounded_snapshot(spark, d):
    top = F.broadcast(entities(spark, d).orderBy(F.desc("confidence"), "key").limit(400).select("key"))  # 400 rows
    return edges(spark, d).join(top, F.col("subject") == F.col("key"), "left_semi").join(top, F.col("object") == F.col("key"), "left_semi").select("subject", "object", "predicate", "sources")


@query(f"WITH {OBSERVATIONS_SQL}, s AS (SELECT subject, predicate, object, doc_id, line // 2 AS claim, max(confidence) AS c FROM observations GROUP BY 1, 2, 3, 4, 5) SELECT subject, predicate, object, {noisy_or_sql('c')} AS confidence FROM s GROUP BY 1, 2, 3")
def x10_same_claim(spark, d):
    """Repeats of one claim take the strongest, different claims corroborate."""
    claims = observations(spark, d).groupBy("subject", "predicate", "object", "doc_id", F.floor(F.col("line") / 2).alias("claim")).agg(F.max("confidence").alias("c"))
    return claims.groupBy("subject", "predicate", "object").agg(noisy_or_all(F.col("c")).alias("confidence"))


@query(f"WITH {OBSERVATIONS_SQL} SELECT subject, object, predicate, count(*) AS merged FROM observations WHERE subject <> object GROUP BY 1, 2, 3 HAVING count(*) > 1")
def x30_merged_relations(spark, d):
    return observations(spark, d).where("subject <> object").groupBy("subject", "object", "predicate").agg(F.count("*").alias("merged")).where("merged > 1")


@query(_BOTH + " SELECT n.key, n.entity_type, e.predicate, e.confidence FROM (SELECT object AS key, predicate, confidence FROM edges WHERE subject = 'P1' UNION ALL SELECT subject, predicate, confidence FROM edges WHERE object = 'P1') e JOIN entities n USING (key)")
def j13_node_detail(spark, d):
    e = edges(spark, d)
    near = e.where("subject = 'P1'").select(F.col("object").alias("key"), "predicate", "confidence").unionAll(e.where("object = 'P1'").select("subject", "predicate", "confidence"))
    return near.join(entities(spark, d).select("key", "entity_type"), "key").select("key", "entity_type", "predicate", "confidence")


@query("SELECT l_suppkey AS key, count(DISTINCT o_orderpriority) AS feeds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def j14_feeds_by_membership(spark, d):
    nodes = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") % 64).alias("part")).agg(F.collect_set("l_orderkey").alias("docs"))  # in parts: no list grows without bound
    docs = nodes.select("key", F.explode("docs").alias("o_orderkey")).join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return docs.groupBy("key").agg(F.countDistinct("o_orderpriority").alias("feeds"))


@query("WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS x, b.s_nationkey AS y FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1) SELECT a, b, x = y AS shared, x <> y AS conflict FROM p")
def p07_identifier_conflict(spark, d):
    from graphloom.operators.resolve import shared_identifier

    s = table(spark, d, "supplier").select("s_suppkey", F.struct(F.col("s_nationkey").cast("string").alias("lei")).alias("ids"))
    left, right = s.select(F.col("s_suppkey").alias("a"), F.col("ids").alias("l")), s.select((F.col("s_suppkey") - 1).alias("a"), F.col("s_suppkey").alias("b"), F.col("ids").alias("r"))
    shared, conflict = shared_identifier("l", "r", ("lei",))
    return left.join(right, "a").select("a", "b", shared.isNotNull().alias("shared"), conflict.alias("conflict"))


@query("SELECT count(*) AS n, count(*) >= 180000 AS stop, count(*) >= 200000 AS hard FROM lineitem")
def a02_guard(spark, d):
    n = F.count("*")
    return table(spark, d, "lineitem").agg(n.alias("n"), (n >= 180000).alias("stop"), (n >= 200000).alias("hard"))


@query(_BOTH + ", g AS (SELECT count(*) AS e FROM (SELECT DISTINCT subject, object FROM edges)), n AS (SELECT 1) SELECT (SELECT count(*) FROM entities) AS nodes, e AS edges FROM g".replace(", n AS (SELECT 1)", ""))
def a13_graph_size(spark, d):
    return entities(spark, d).agg(F.count("*").alias("nodes")).crossJoin(edges(spark, d).select("subject", "object").distinct().agg(F.count("*").alias("edges")))  # one row each


@query(f"WITH {OBSERVATIONS_SQL} SELECT subject, count(*) AS n FROM observations WHERE source = '1-URGENT' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def a16_source_dossier(spark, d):
    return observations(spark, d).where("source = '1-URGENT'").groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject").limit(12)


@query(f"WITH {EDGES_SQL} SELECT subject, object, round(least(1.0, greatest(0.05, weight)) * least(1.0, greatest(0.1, confidence)), 9)::DOUBLE AS strength FROM edges WHERE predicate = 'OPERATES'")
def g18_edge_strength(spark, d):
    return edges(spark, d).where("predicate = 'OPERATES'").select("subject", "object", F.round(strength(F.col("weight"), F.col("confidence")), 9).alias("strength"))


@query(f"WITH {ENTITIES_SQL} SELECT key, array_to_string(list_filter([CASE WHEN confidence < 0.6 THEN 'weak' END, CASE WHEN mentions = 0 THEN 'unmentioned' END, CASE WHEN jurisdiction IS NULL THEN 'nowhere' END], lambda r: r IS NOT NULL), ',') AS reasons FROM entities")
def g20_reasons(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("confidence") < 0.6, "weak"), F.when(F.col("mentions") == 0, "unmentioned"), F.when(F.col("jurisdiction").isNull(), "nowhere")))
    return entities(spark, d).select("key", F.array_join(reasons, ",").alias("reasons"))


@query("SELECT s_suppkey, s_acctbal < 0 OR s_nationkey IN (3, 7) AS offshore FROM supplier")
def g22_offshore_flag(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", ((F.col("s_acctbal") < 0) | F.col("s_nationkey").isin(3, 7)).alias("offshore"))


@query(f"WITH {ADDRESS_SQL}, p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM addressed a JOIN addressed b ON a.address = b.address AND a.s_suppkey < b.s_suppkey), t AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey) SELECT a, b FROM p EXCEPT SELECT a, b FROM t")
def g36_protected_pairs(spark, d):
    """Candidates that a shared document doesn't protect from merging."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = j02_shared_address(spark, d).distinct()
    together = pairs.join(lines.withColumnRenamed("l_suppkey", "a"), "a").join(lines.withColumnRenamed("l_suppkey", "b"), ["b", "l_orderkey"], "left_semi")
    return pairs.join(together.select("a", "b").distinct(), ["a", "b"], "left_anti")


@query(f"WITH {ENTITIES_SQL} SELECT name, max(confidence) AS confidence, sum(mentions)::BIGINT AS mentions FROM entities GROUP BY 1")
def z08_node_facts(spark, d):
    return entities(spark, d).groupBy("name").agg(F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"))


@query("SELECT o_orderkey, coalesce(nullif(o_custkey % 3, 0), nullif(o_custkey % 5, 0), 9)::BIGINT AS most FROM orders")
def z12_limits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.nullif(F.col("o_custkey") % 5, F.lit(0)), F.lit(9)).cast("long").alias("most"))


@query("SELECT event_id, CASE WHEN upper(event_type) IN ('CLICK', 'VIEW') THEN upper(event_type) ELSE 'ASSOCIATED_WITH' END AS predicate FROM events")
def z19_tolerant_enum(spark, d):
    known = F.broadcast(spark.createDataFrame([("CLICK",), ("VIEW",)], "predicate string"))
    e = table(spark, d, "events").select("event_id", F.upper("event_type").alias("given"))
    return e.join(known, F.col("given") == F.col("predicate"), "left").select("event_id", F.coalesce("predicate", F.lit("ASSOCIATED_WITH")).alias("predicate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(abs(l_partkey - l_suppkey) / 6.0)::BIGINT AS distance FROM lineitem")
def z27_distance(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.abs(F.col("l_partkey") - F.col("l_suppkey")) / 6).alias("distance"))


@query("WITH o AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, last >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS young FROM o")
def z45_age(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(newest).select("user_id", (F.col("last") >= F.col("newest") - F.make_interval(hours=F.lit(24))).alias("young"))


@query()
def u01_extra_rules(spark, d):
    """A plug-in's rule beside the built-in table."""
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("dance").alias("verb"), F.lit("Person").alias("subject_type"), F.lit("Person").alias("object_type"))
    return rules.apply_verbs(t, rules.verb_rules(spark, (("dance", "MET_WITH", 0.5, 2, "", ""),))).withColumn("weight", edge_weight(F.col("predicate")))
