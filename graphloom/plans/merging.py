"""Queries over merging, resolution and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.confidence import noisy_or_sql
from graphloom.functions.vocab import EDGE_WEIGHTS, SYMMETRIC, edge_weight
from graphloom.operators import resolve, upsert
from graphloom.plans.registry import query
from graphloom.sources.relational import EDGES_SQL, OBSERVATIONS_SQL, edges, observations, table


@query(
    "WITH d AS (SELECT 'D' || l_orderkey AS doc_id, l_returnflag || repeat('x', l_linenumber) AS title, l_shipdate::DATE AS published, l_shipdate AS ingested FROM lineitem) "
    "SELECT doc_id, max(len(title) || '|' || title) AS title, min(published) AS published, max(ingested)::DATE AS ingested, count(*) AS times FROM d GROUP BY 1"
)
def k01_document_upsert(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("D"), F.col("l_orderkey")).alias("doc_id"), F.concat("l_returnflag", F.expr("repeat('x', l_linenumber)")).alias("title"),
        F.to_date("l_shipdate").alias("published"), F.to_date("l_shipdate").alias("ingested"), F.lit(1).cast("long").alias("times"),
    )
    merged = upsert.upsert_documents(rows.where("published < DATE'1998-01-01'"), rows.where("published >= DATE'1998-01-01'"))
    return merged.withColumn("title", F.concat(F.length("title").cast("string"), F.lit("|"), "title"))


@query(f"WITH {OBSERVATIONS_SQL}, o AS (SELECT subject, predicate, object, doc_id, max(confidence) AS c FROM observations WHERE subject <> object GROUP BY 1, 2, 3, 4) SELECT subject, predicate, object, {noisy_or_sql('c')} AS confidence, count(*) AS observations FROM o GROUP BY 1, 2, 3")
def k03_edge_merge(spark, d):
    return upsert.merge_observations(observations(spark, d)).select("subject", "predicate", "object", "confidence", "observations")


@query(
    f"WITH {OBSERVATIONS_SQL}, o AS (SELECT subject, predicate, object, doc_id, right(doc_id, 1) < '5' AS old, max(confidence) AS c FROM observations WHERE subject <> object GROUP BY 1, 2, 3, 4, 5), "
    f"b AS (SELECT subject, predicate, object, old, {noisy_or_sql('c')} AS c, count(*) AS n FROM o GROUP BY 1, 2, 3, 4) "
    f"SELECT subject, predicate, object, {noisy_or_sql('c')} AS confidence, sum(n)::BIGINT AS observations FROM b GROUP BY 1, 2, 3"
)
def k03_edge_upsert(spark, d):
    """Two batches, the second sent twice: the result is that of all observations at once."""
    o = observations(spark, d)
    split = F.substring("doc_id", -1, 1) < "5"
    batch = lambda rows: upsert.merge_observations(rows).withColumn("weight", edge_weight(F.col("predicate")))
    stored, new = batch(o.where(split)), batch(o.where(~split))
    # no document list is cut here, so that a repeated batch is known as such
    once = upsert.upsert_edges(stored, new, most_docs=10_000)
    return upsert.upsert_edges(once, new, most_docs=10_000).select("subject", "predicate", "object", "confidence", "observations")


@query("SELECT 'D' || l_orderkey AS doc_id, 'O' || l_suppkey AS key, count(*) AS n, min(l_linenumber * 40)::INTEGER AS first_at, max(l_discount) AS confidence, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS surfaces FROM lineitem GROUP BY 1, 2")
def k04_mention_upsert(spark, d):
    m = table(spark, d, "lineitem").select(
        F.concat(F.lit("D"), F.col("l_orderkey")).alias("doc_id"), F.concat(F.lit("O"), F.col("l_suppkey")).alias("key"), (F.col("l_linenumber") * 40).alias("at"),
        F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("surface"),
    )
    return upsert.upsert_mentions(m).withColumn("surfaces", F.array_join("surfaces", ","))


@query("SELECT 'P' || c_custkey AS key FROM customer WHERE c_custkey >= 200 ORDER BY round(c_acctbal, 6) DESC, c_custkey DESC, 'P' || c_custkey LIMIT 100")
def k07_node_budget(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("P"), F.col("c_custkey")).alias("key"), F.col("c_acctbal").alias("confidence"), F.col("c_custkey").alias("mentions"))
    return upsert.admit(c, c.where("mentions < 200"), 100).select("key")


@query("SELECT event_type, user_id, max(ts) AS last_ts, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def k05_last_write_wins(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("value"))


@query("SELECT p_brand AS key, max(lpad(len(p_name)::VARCHAR, 4, '0') || '|' || p_name) AS name, max(p_retailprice) AS confidence, sum(p_size)::BIGINT AS mentions, array_to_string(list_slice(list_sort(list(DISTINCT p_type)), 1, 64), ',') AS aliases FROM part GROUP BY 1")
def x29_merge_entities(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("confidence"), F.col("p_size").alias("mentions"), F.array("p_type").alias("aliases"))
    merged = upsert.merge_entities(rows)
    return merged.select("key", F.concat(F.lpad(F.length("name").cast("string"), 4, "0"), F.lit("|"), "name").alias("name"), "confidence", "mentions", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {EDGES_SQL} SELECT predicate, count(*) AS n, round(sum(confidence), 2) AS total, max(confidence) AS best FROM edges GROUP BY 1")
def x31_relation_summary(spark, d):
    return edges(spark, d).groupBy("predicate").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("total"), F.max("confidence").alias("best"))


_WEIGHTS = "CASE predicate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EDGE_WEIGHTS.items()) + " ELSE 0.5 END"


@query(f"WITH p AS (SELECT event_id, upper(event_type) AS kind, CASE event_type WHEN 'click' THEN 'OWNS' WHEN 'view' THEN 'MET_WITH' WHEN 'error' THEN 'ACCUSED_OF' ELSE upper(event_type) END AS predicate FROM events) SELECT event_id, ({_WEIGHTS})::DOUBLE AS weight FROM p")
def f46_edge_weight(spark, d):
    kind = F.col("event_type")
    predicate = F.when(kind == "click", "OWNS").when(kind == "view", "MET_WITH").when(kind == "error", "ACCUSED_OF").otherwise(F.upper(kind))
    return table(spark, d, "events").select("event_id", edge_weight(predicate).alias("weight"))


_SYM = ", ".join(f"'{p}'" for p in SYMMETRIC)


@query(f"WITH e AS (SELECT l_suppkey AS s, l_partkey AS o, CASE WHEN l_returnflag = 'N' THEN 'MET_WITH' ELSE 'OWNS' END AS predicate FROM lineitem) SELECT CASE WHEN predicate IN ({_SYM}) THEN least(s, o) ELSE s END AS subject, CASE WHEN predicate IN ({_SYM}) THEN greatest(s, o) ELSE o END AS object, predicate, count(*) AS n FROM e GROUP BY 1, 2, 3")
def x20_canonical_order(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("o"), F.when(F.col("l_returnflag") == "N", "MET_WITH").otherwise("OWNS").alias("predicate"))
    loose = F.col("predicate").isin(*SYMMETRIC)
    ordered = e.select(F.when(loose, F.least("s", "o")).otherwise(F.col("s")).alias("subject"), F.when(loose, F.greatest("s", "o")).otherwise(F.col("o")).alias("object"), "predicate")
    return ordered.groupBy("subject", "object", "predicate").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS at, l_suppkey AS key FROM lineitem), p AS (SELECT a.doc, a.key AS a, b.key AS b, abs(a.at - b.at) AS distance, row_number() OVER (PARTITION BY a.doc ORDER BY abs(a.at - b.at), a.key, b.key, a.at, b.at) AS k FROM t a JOIN t b ON a.doc = b.doc AND a.at < b.at AND a.key <> b.key) SELECT doc, a, b, distance::INTEGER AS distance FROM p WHERE k <= 12")
def x08_cooccurrence(spark, d):
    from pyspark.sql import Window as W

    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("at"), F.col("l_suppkey").alias("key"))
    left, right = t.select("doc", F.col("at").alias("x"), F.col("key").alias("a")), t.select("doc", F.col("at").alias("y"), F.col("key").alias("b"))
    pairs = left.join(right, "doc").where("x < y AND a <> b").withColumn("distance", F.col("y") - F.col("x"))
    closest = W.partitionBy("doc").orderBy("distance", "a", "b", "x", "y")
    return pairs.withColumn("k", F.row_number().over(closest)).where("k <= 12").select("doc", "a", "b", "distance")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(1.0, greatest(0.05, (1 - l_tax) * CASE WHEN l_quantity > 6 THEN greatest(0.6, 1 - 0.02 * (l_quantity - 6)) ELSE 1.0 END * CASE WHEN l_returnflag = 'R' THEN 0.95 ELSE 1.0 END)), 9) AS score FROM lineitem")
def x09_evidence_score(spark, d):
    decay = F.when(F.col("l_quantity") > 6, F.greatest(F.lit(0.6), 1 - 0.02 * (F.col("l_quantity") - 6))).otherwise(1.0)
    passive = F.when(F.col("l_returnflag") == "R", 0.95).otherwise(1.0)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), (1 - F.col("l_tax")) * decay * passive)), 9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))


_SUPPLIERS = "SELECT 'O' || s_suppkey AS key, 'Firm ' || n_name || ' ' || (s_suppkey % 10) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _suppliers(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.concat(F.lit("O"), F.col("s_suppkey")).alias("key"), F.concat(F.lit("Firm "), "n_name", F.lit(" "), (F.col("s_suppkey") % 10).cast("string")).alias("name"),
        F.lit("Organization").alias("entity_type"), F.col("s_suppkey").alias("mentions"), F.lit(0.5).alias("confidence"),
    )


@query()
def j09_fuzzy_pairs(spark, d):
    rows = _suppliers(spark, d)
    return resolve.score_pairs(resolve.blocked_pairs(rows), rows).where("score >= 0.88").select("a", "b", F.round("score", 6).alias("score"))


@query()
def g33_resolution_classes(spark, d):
    rows = _suppliers(spark, d)
    accepted = resolve.decide(resolve.score_pairs(resolve.blocked_pairs(rows), rows), 0.985)
    return resolve.classes(accepted, rows)


@query()
def w03_mutual_best(spark, d):
    rows = _suppliers(spark, d)
    return resolve.greedy_matching(resolve.decide(resolve.score_pairs(resolve.blocked_pairs(rows), rows))).select("a", "b", F.round("score", 6).alias("score"))


@query(
    f"WITH {EDGES_SQL}, m AS (SELECT subject, CASE WHEN predicate = 'CONTRACTED_WITH' THEN 'O' || (substring(object, 2)::BIGINT - substring(object, 2)::BIGINT % 10) ELSE object END AS object, predicate, confidence, observations FROM edges WHERE predicate = 'CONTRACTED_WITH') "
    f"SELECT subject, predicate, object, {noisy_or_sql('confidence')} AS confidence, sum(observations)::BIGINT AS observations FROM m WHERE subject <> object GROUP BY 1, 2, 3"
)
def g34_repoint(spark, d):
    """Every supplier merged into the first of its ten."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("O"), F.col("s_suppkey")).alias("key"), F.concat(F.lit("O"), F.col("s_suppkey") - F.col("s_suppkey") % 10).alias("winner"))
    return upsert.repoint(edges(spark, d).where("predicate = 'CONTRACTED_WITH'"), s)
