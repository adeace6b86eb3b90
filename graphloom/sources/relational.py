"""The entity graph that the relational test tables describe, and the same as SQL.

Customers are persons, suppliers organisations, parts craft, nations and regions locations. An order is
a dated document from the source named by its priority; its lines are observations of a customer
contracting with a supplier and of a supplier operating a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.confidence import noisy_or_all, noisy_or_sql
from graphloom.functions.vocab import edge_weight
from graphloom.session import reach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, name, entity_type, jurisdiction, community, confidence, mentions, first_seen, last_seen."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", F.col("n_name").alias("jurisdiction"))
    orders = t("orders").groupBy("o_custkey").agg(F.count("*").alias("mentions"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    lines = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("mentions"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    none = F.lit(None)
    persons = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        _key("P", "c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("Person").alias("entity_type"), "jurisdiction", F.col("c_mktsegment").alias("community"),
        F.round(0.5 + (F.col("c_custkey") % 50) / 100, 2).alias("confidence"), F.coalesce("mentions", F.lit(0)).alias("mentions"),
        F.to_date("first").alias("first_seen"), F.to_date("last").alias("last_seen"),
    )
    organisations = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        _key("O", "s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("Organization").alias("entity_type"), "jurisdiction", F.col("jurisdiction").alias("community"),
        F.round(0.6 + (F.col("s_suppkey") % 40) / 100, 2).alias("confidence"), F.coalesce("mentions", F.lit(0)).alias("mentions"),
        F.to_date("first").alias("first_seen"), F.to_date("last").alias("last_seen"),
    )
    crafts = t("part").select(
        _key("C", "p_partkey").alias("key"), F.col("p_name").alias("name"), F.lit("Craft").alias("entity_type"), none.cast("string").alias("jurisdiction"), F.col("p_brand").alias("community"),
        F.round(0.4 + (F.col("p_size") % 60) / 100, 2).alias("confidence"), F.lit(0).cast("long").alias("mentions"), none.cast("date").alias("first_seen"), none.cast("date").alias("last_seen"),
    )
    places = t("nation").select(_key("L", "n_nationkey").alias("key"), F.col("n_name").alias("name")).unionAll(t("region").select(_key("R", "r_regionkey"), "r_name")).select(
        "key", "name", F.lit("Location").alias("entity_type"), F.col("name").alias("jurisdiction"), none.cast("string").alias("community"), F.lit(1.0).alias("confidence"),
        F.lit(0).cast("long").alias("mentions"), none.cast("date").alias("first_seen"), none.cast("date").alias("last_seen"),
    )
    return persons.unionAll(organisations).unionAll(crafts).unionAll(places)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object, confidence, doc_id, source, seen, line: one row an observation."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    common = [_key("D", "o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("source"), F.to_date("o_orderdate").alias("seen"), F.col("l_linenumber").alias("line")]
    return lines.select(
        F.inline(F.array(
            F.struct(_key("P", "o_custkey").alias("subject"), F.lit("CONTRACTED_WITH").alias("predicate"), _key("O", "l_suppkey").alias("object"), F.round(0.2 + F.col("l_discount") * 5, 6).alias("confidence")),
            F.struct(_key("O", "l_suppkey").alias("subject"), F.lit("OPERATES").alias("predicate"), _key("C", "l_partkey").alias("object"), F.round(0.3 + F.col("l_tax") * 5, 6).alias("confidence")),
        )), *common,
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged edges: of one document the strongest observation counts, documents corroborate each other."""
    once = observations(spark, sf_dir).groupBy("subject", "predicate", "object", "doc_id").agg(F.max("confidence").alias("c"), F.max("seen").alias("seen"), F.max("source").alias("source"))
    return once.groupBy("subject", "predicate", "object").agg(
        noisy_or_all(F.col("c")).alias("confidence"), F.count("*").alias("observations"), F.countDistinct("source").alias("sources"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")
    ).withColumn("weight", edge_weight(F.col("predicate")))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of place: subject, predicate, object, weight."""
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("supplier").select(_key("O", "s_suppkey").alias("subject"), F.lit("LOCATED_IN").alias("predicate"), _key("L", "s_nationkey").alias("object"), F.lit(0.7).alias("weight"))
        .unionAll(t("customer").select(_key("P", "c_custkey"), F.lit("NATIONAL_OF"), _key("L", "c_nationkey"), F.lit(0.8)))
        .unionAll(t("nation").select(_key("L", "n_nationkey"), F.lit("LOCATED_IN"), _key("R", "n_regionkey"), F.lit(0.7)))
    )


#: The same tables as common table expressions of DuckDB.
ENTITIES_SQL = """
n AS (SELECT n_nationkey, n_name AS jurisdiction FROM nation),
oc AS (SELECT o_custkey, count(*) AS mentions, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1),
ls AS (SELECT l_suppkey, count(*) AS mentions, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1),
entities AS (
SELECT 'P' || c_custkey AS key, c_name AS name, 'Person' AS entity_type, jurisdiction, c_mktsegment AS community, round(0.5 + (c_custkey % 50) / 100.0, 2)::DOUBLE AS confidence,
    coalesce(mentions, 0)::BIGINT AS mentions, first::DATE AS first_seen, last::DATE AS last_seen FROM customer JOIN n ON c_nationkey = n_nationkey LEFT JOIN oc ON c_custkey = o_custkey
UNION ALL SELECT 'O' || s_suppkey, s_name, 'Organization', jurisdiction, jurisdiction, round(0.6 + (s_suppkey % 40) / 100.0, 2)::DOUBLE, coalesce(mentions, 0)::BIGINT, first::DATE, last::DATE
    FROM supplier JOIN n ON s_nationkey = n_nationkey LEFT JOIN ls ON s_suppkey = l_suppkey
UNION ALL SELECT 'C' || p_partkey, p_name, 'Craft', NULL, p_brand, round(0.4 + (p_size % 60) / 100.0, 2)::DOUBLE, 0, NULL, NULL FROM part
UNION ALL SELECT 'L' || n_nationkey, n_name, 'Location', n_name, NULL, 1.0, 0, NULL, NULL FROM nation
UNION ALL SELECT 'R' || r_regionkey, r_name, 'Location', r_name, NULL, 1.0, 0, NULL, NULL FROM region)"""
OBSERVATIONS_SQL = """
observations AS (
SELECT 'P' || o_custkey AS subject, 'CONTRACTED_WITH' AS predicate, 'O' || l_suppkey AS object, round(0.2 + l_discount * 5, 6) AS confidence,
    'D' || o_orderkey AS doc_id, o_orderpriority AS source, o_orderdate::DATE AS seen, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'O' || l_suppkey, 'OPERATES', 'C' || l_partkey, round(0.3 + l_tax * 5, 6), 'D' || o_orderkey, o_orderpriority, o_orderdate::DATE, l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EDGES_SQL = (
    OBSERVATIONS_SQL
    + """,
edges AS (SELECT subject, predicate, object, @NOISY AS confidence, count(*) AS observations, count(DISTINCT source) AS sources,
    min(seen) AS first_seen, max(seen) AS last_seen, CASE predicate WHEN 'CONTRACTED_WITH' THEN 0.6 ELSE 0.8 END::DOUBLE AS weight
    FROM (SELECT subject, predicate, object, doc_id, max(confidence) AS c, max(seen) AS seen, max(source) AS source FROM observations GROUP BY ALL) GROUP BY ALL)"""
)
EDGES_SQL = EDGES_SQL.replace("@NOISY", noisy_or_sql("c")).replace("observations GROUP BY ALL) GROUP BY ALL", "observations GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
PLACES_SQL = """
places AS (SELECT 'O' || s_suppkey AS subject, 'LOCATED_IN' AS predicate, 'L' || s_nationkey AS object, 0.7::DOUBLE AS weight FROM supplier
UNION ALL SELECT 'P' || c_custkey, 'NATIONAL_OF', 'L' || c_nationkey, 0.8 FROM customer UNION ALL SELECT 'L' || n_nationkey, 'LOCATED_IN', 'R' || n_regionkey, 0.7 FROM nation)"""
