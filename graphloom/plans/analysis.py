"""Queries over rules, risk, influence and search."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import rules
from graphloom.plans.registry import query
from graphloom.sources.relational import EDGES_SQL, ENTITIES_SQL, OBSERVATIONS_SQL, edges, entities, observations, table

_BOTH = f"WITH {ENTITIES_SQL}, {EDGES_SQL}"

_LINKS = [*(k for k, _ in rules.LINK_TYPES), "Beneficial  Owner of", "a nominee shareholder of it", "the incorporated one", "same name as"]
_LINK = f"regexp_replace(lower({_LINKS!r}[p_partkey % {len(_LINKS)} + 1]), '\\s+', ' ', 'g')"


@query(f"SELECT p_partkey, CASE {_LINK} " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in rules.LINK_TYPES) + f" ELSE {rules.first_match_sql(_LINK, rules.LINK_TYPES + rules.LINK_WORDS, 'ASSOCIATED_WITH')} END AS predicate FROM part")
def s06_link_types(spark, d):
    kinds = F.array(*map(F.lit, _LINKS))
    return table(spark, d, "part").select("p_partkey", rules.link_predicate(F.element_at(kinds, (F.col("p_partkey") % len(_LINKS) + 1).cast("int"))).alias("predicate"))


_NATURE = "['ownership-of-shares-75-to-100-percent', 'voting-rights-25-to-50-percent', 'right-to-appoint-and-remove-directors', 'none'][p_partkey % 4 + 1]"


@query(f"SELECT p_partkey, {rules.first_match_sql(_NATURE, rules.CONTROL, 'ASSOCIATED_WITH')} AS predicate FROM part")
def s21_control_mapping(spark, d):
    kinds = F.array(*map(F.lit, ("ownership-of-shares-75-to-100-percent", "voting-rights-25-to-50-percent", "right-to-appoint-and-remove-directors", "none")))
    return table(spark, d, "part").select("p_partkey", rules.first_match(F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")), rules.CONTROL, "ASSOCIATED_WITH").alias("predicate"))


@query("SELECT c_custkey, c_mktsegment || ' of ' || c_name AS evidence, 'N' || c_nationkey AS object FROM customer WHERE lower(c_mktsegment) = 'machinery'")
def s23_mapped_columns(spark, d):
    return table(spark, d, "customer").where(F.lower("c_mktsegment") == "machinery").select(
        "c_custkey", F.format_string("%s of %s", "c_mktsegment", "c_name").alias("evidence"), F.concat(F.lit("N"), "c_nationkey").alias("object")
    )


@query(f"SELECT c_custkey, coalesce(map {{{', '.join(repr(k) + ': ' + repr(v) for k, v in rules.ROLES.items())}}}[['director', 'llp-member', 'clown', 'receiver'][c_custkey % 4 + 1]], 'ASSOCIATED_WITH') AS predicate FROM customer")
def z33_officer_roles(spark, d):
    roles = F.create_map(*(F.lit(x) for pair in rules.ROLES.items() for x in pair))
    some = F.element_at(F.array(*map(F.lit, ("director", "llp-member", "clown", "receiver"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.try_element_at(roles, some), F.lit("ASSOCIATED_WITH")).alias("predicate"))


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{p}', {e}, {n}, '{s}', '{o}', {i})" for i, (v, p, e, n, s, o) in enumerate(rules.VERBS)) + ") AS r(verb, predicate, evidence, priority, sk, ok, ro))"
_TRIPLES = "t AS (SELECT l_orderkey * 10 + l_linenumber AS id, ['own', 'hold', 'operate', 'meet', 'dance'][l_suppkey % 5 + 1] AS verb, CASE WHEN l_partkey % 2 = 0 THEN 'Person' ELSE 'Organization' END AS st, CASE l_partkey % 3 WHEN 0 THEN 'Craft' WHEN 1 THEN 'Location' ELSE 'Person' END AS ot FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2))"


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT IN ('small ring', 'red widget') AND len(p_name) >= 9")
def x12_noise_filter(spark, d):
    noise = spark.createDataFrame([("small ring",), ("red widget",)], "p_name string")
    return table(spark, d, "part").where(F.length("p_name") >= 9).join(F.broadcast(noise), "p_name", "left_anti").select("p_partkey", "p_name")


@query(f"WITH {ENTITIES_SQL} SELECT entity_type, count(*) AS n, min(key) AS first FROM entities GROUP BY 1")
def x32_partition_by_type(spark, d):
    return entities(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.min("key").alias("first"))


@query("WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::INT AS b, l_discount AS c FROM lineitem), o AS (SELECT *, a >= coalesce(max(b) OVER (PARTITION BY doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS open FROM s), g AS (SELECT *, sum(open::INT) OVER (PARTITION BY doc ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT doc, count(DISTINCT k) AS clusters FROM g GROUP BY 1")
def x02_overlap_clusters(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"), F.col("l_discount").alias("confidence"))
    return rules.suppress_overlaps(s).groupBy("doc").agg(F.count("*").alias("clusters"))


@query(_BOTH + ", x AS (SELECT subject AS person, object AS target, max(greatest(weight, confidence)) AS strength, max(confidence) AS influence FROM edges WHERE subject LIKE 'P%' GROUP BY 1, 2) SELECT person, target, round(0.65 * influence + 0.35 * strength, 6) AS score FROM x WHERE round(0.65 * influence + 0.35 * strength, 6) >= 0.6 ORDER BY score DESC, person, target LIMIT 2000")
def g15_influence_edges(spark, d):
    x = edges(spark, d).where("subject LIKE 'P%'").groupBy(F.col("subject").alias("person"), F.col("object").alias("target")).agg(F.max(F.greatest("weight", "confidence")).alias("strength"), F.max("confidence").alias("influence"))
    scored = x.select("person", "target", F.round(0.65 * F.col("influence") + 0.35 * F.col("strength"), 6).alias("score")).where("score >= 0.6")
    return scored.orderBy(F.desc("score"), "person", "target").limit(2000)


@query(_BOTH + ", b AS (SELECT subject AS person, count(DISTINCT object) AS targets, max(confidence) AS best FROM edges WHERE subject LIKE 'P%' GROUP BY 1) SELECT person, round(0.3 * least(1.0, targets / 40.0) + 0.25 * best + 0.2 * (CASE WHEN e.confidence < 0.6 THEN 1 ELSE 0 END), 8)::DOUBLE AS risk FROM b JOIN entities e ON key = person WHERE targets >= 3")
def g17_risk(spark, d):
    b = edges(spark, d).where("subject LIKE 'P%'").groupBy(F.col("subject").alias("key")).agg(F.countDistinct("object").alias("targets"), F.max("confidence").alias("best")).where("targets >= 3")
    joined = b.join(entities(spark, d).select("key", "confidence"), "key")
    risk = 0.3 * F.least(F.lit(1.0), F.col("targets") / 40) + 0.25 * F.col("best") + 0.2 * F.when(F.col("confidence") < 0.6, 1).otherwise(0)
    return joined.select(F.col("key").alias("person"), F.round(risk, 8).alias("risk"))


@query(_BOTH + ", c AS (SELECT community, avg(CASE WHEN confidence < 0.6 THEN 1.0 ELSE 0 END) AS ratio FROM entities WHERE entity_type = 'Person' GROUP BY 1) SELECT key, round(ratio, 6)::DOUBLE AS ratio FROM entities JOIN c USING (community) WHERE entity_type = 'Person'")
def g21_cluster_ratio(spark, d):
    persons = entities(spark, d).where("entity_type = 'Person'")
    ratio = persons.groupBy("community").agg(F.avg((F.col("confidence") < 0.6).cast("double")).alias("ratio"))
    return persons.join(ratio, "community").select("key", F.round("ratio", 6).alias("ratio"))


@query(_BOTH + ", n AS (SELECT subject, count(DISTINCT o.jurisdiction) AS clusters FROM edges JOIN entities o ON o.key = object WHERE predicate = 'CONTRACTED_WITH' GROUP BY 1)".replace("n AS (SELECT subject", "bridges AS (SELECT subject") + " SELECT subject, clusters FROM bridges WHERE clusters >= 2 ORDER BY clusters DESC, subject LIMIT 10")
def g23_bridges(spark, d):
    who = entities(spark, d).select(F.col("key").alias("object"), "jurisdiction")
    near = edges(spark, d).where("predicate = 'CONTRACTED_WITH'").select("subject", "object").join(who, "object")
    return near.groupBy("subject").agg(F.countDistinct("jurisdiction").alias("clusters")).where("clusters >= 2").orderBy(F.desc("clusters"), "subject").limit(10)


@query("SELECT doc_id, quality IS NOT NULL AND quality = 1 OR source IN ('src1', 'src4') AS released FROM documents LEFT JOIN labels USING (doc_id)")
def p03_auto_release(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", (F.coalesce(F.col("quality") == 1, F.lit(False)) | F.arrays_overlap(F.array("source"), F.array(F.lit("src1"), F.lit("src4")))).alias("released"))


@query(f"WITH {ENTITIES_SQL} SELECT entity_type, key FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY mentions DESC, confidence DESC, len(name), key) AS k FROM entities) WHERE k <= 3")
def w02_ranked(spark, d):
    order = W.partitionBy("entity_type").orderBy(F.desc("mentions"), F.desc("confidence"), F.length("name"), "key")
    return entities(spark, d).withColumn("k", F.row_number().over(order)).where("k <= 3").select("entity_type", "key")


@query("WITH g AS (SELECT c_mktsegment AS label, count(*) AS n, min(c_name) AS first FROM customer GROUP BY 1) SELECT label, 'l' || lpad((row_number() OVER (ORDER BY n DESC, first) - 1)::VARCHAR, 3, '0') AS name FROM g")
def w10_named_groups(spark, d):
    groups = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"), F.min("c_name").alias("first"))
    number = F.row_number().over(W.orderBy(F.desc("n"), "first")) - 1
    return groups.select("label", F.concat(F.lit("l"), F.lpad(number.cast("string"), 3, "0")).alias("name"))


@query("WITH w AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0), a AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS f FROM lineitem) SELECT w.k AS watched, count(*) AS changes FROM w JOIN a USING (k) GROUP BY 1")
def d02_watchlist(spark, d):
    watched = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("watched"))
    changes = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("watched"), "l_returnflag").distinct()
    return changes.join(watched, "watched", "left_semi").groupBy("watched").agg(F.count("*").alias("changes"))


@query("WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS t FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS t FROM orders WHERE o_orderkey % 2 = 0) SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN a.t = b.t THEN 'unchanged' ELSE 'skipped' END AS status, count(*) AS n FROM b LEFT JOIN a USING (k) GROUP BY 1")
def d03_merge_notes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("t"))
    a = o.where("k % 3 <> 0").select("k", F.col("t").alias("old"))
    b = o.where("k % 2 = 0").withColumn("t", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("t")))
    status = F.when(F.col("old").isNull(), "added").when(F.col("old") == F.col("t"), "unchanged").otherwise("skipped")
    return b.join(a, "k", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, array_to_string(list_slice(list_distinct(list_sort(list(c_mktsegment))), 1, 3), ',') AS kinds FROM customer GROUP BY 1".replace("list_distinct(list_sort(list(c_mktsegment)))", "list_sort(list(DISTINCT c_mktsegment))"))
def d05_bounded_union(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    return g.select("c_nationkey", F.array_join(F.slice("s", 1, 3), ",").alias("kinds"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1 UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def d06_union_branches(spark, d):
    t = lambda name: table(spark, d, name)
    parts = t("nation").where("n_regionkey = 1").select(F.col("n_name").alias("name")).unionByName(t("region").select(F.col("r_name").alias("name")))
    return parts.unionByName(t("customer").select(F.col("c_mktsegment").alias("name"))).distinct()


@query(f"WITH {ENTITIES_SQL} SELECT kind, key, score FROM (SELECT 'entity' AS kind, key, 2 * instr(lower(name), 'red') AS score FROM entities WHERE instr(lower(name), 'red') > 0 UNION ALL SELECT 'outlet', o_orderpriority, 50 FROM orders WHERE instr(lower(o_orderpriority), 'ed') > 0 GROUP BY 2) ORDER BY score DESC, kind, key LIMIT 40")
def c04_union_search(spark, d):
    who = entities(spark, d).select(F.lit("entity").alias("kind"), "key", (2 * F.instr(F.lower("name"), "red")).alias("score")).where("score > 0")
    outlets = table(spark, d, "orders").where(F.instr(F.lower("o_orderpriority"), "ed") > 0).select(F.lit("outlet").alias("kind"), F.col("o_orderpriority").alias("key"), F.lit(50).alias("score")).distinct()
    return who.unionByName(outlets).orderBy(F.desc("score"), "kind", "key").limit(40)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE contains(lower(s_name), '7') AND s_acctbal >= 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10 OFFSET 5")
def c08_table_page(spark, d):
    found = table(spark, d, "supplier").where(F.contains(F.lower("s_name"), F.lit("7")) & (F.col("s_acctbal") >= 0))
    return found.orderBy(F.desc("s_acctbal"), "s_suppkey").offset(5).limit(10).select("s_suppkey", "s_name", "s_acctbal")


@query(f"WITH {ENTITIES_SQL} SELECT key FROM entities ORDER BY CASE WHEN key = 'p7' THEN 0 WHEN lower(name) = 'red ring' THEN 1 WHEN contains(lower(name), 'red ring') THEN 2 ELSE 3 END, key LIMIT 1")
def c09_best_match(spark, d):
    name = F.lower("name")
    rank = F.when(F.col("key") == "p7", 0).when(name == "red ring", 1).when(F.contains(name, F.lit("red ring")), 2).otherwise(3)
    return entities(spark, d).orderBy(rank, "key").limit(1).select("key")


@query(f"WITH {OBSERVATIONS_SQL}, r AS (SELECT subject, doc_id, confidence, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, doc_id, predicate, object, line) AS k FROM observations) SELECT subject, doc_id, confidence FROM r WHERE k <= 20")
def c11_evidence_caps(spark, d):
    best = W.partitionBy("subject").orderBy(F.desc("confidence"), "doc_id", "predicate", "object", "line")
    return observations(spark, d).withColumn("k", F.row_number().over(best)).where("k <= 20").select("subject", "doc_id", "confidence")


@query("WITH b AS (SELECT lower(substring(p_name, 1, 4)) AS block, list_sort(list(DISTINCT p_brand)) AS keys FROM part GROUP BY 1) SELECT array_to_string(keys, ',') AS members, count(*) AS blocks FROM b WHERE len(keys) BETWEEN 2 AND 40 GROUP BY 1")
def j10_blocks(spark, d):
    b = table(spark, d, "part").groupBy(F.lower(F.substring("p_name", 1, 4)).alias("block")).agg(F.array_sort(F.collect_set("p_brand")).alias("keys"))
    return b.where("size(keys) BETWEEN 2 AND 40").groupBy(F.array_join("keys", ",").alias("members")).agg(F.count("*").alias("blocks"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(source, 'missing') AS evidence FROM lineitem LEFT JOIN documents ON l_partkey = doc_id")
def j15_evidence_lookup(spark, d):
    """Each line cites the document of its part's number; numbers that no document has are said to be missing."""
    known = table(spark, d, "documents").select(F.col("doc_id").alias("l_partkey"), "source")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(known, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("source", F.lit("missing")).alias("evidence"))


@query("SELECT key, predicate, max(c) AS confidence FROM (SELECT l_suppkey AS key, l_returnflag AS predicate, l_discount AS c FROM lineitem UNION ALL SELECT s_suppkey, 'N', 0.05 FROM supplier) GROUP BY 1, 2")
def j17_stronger_wins(spark, d):
    stored = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("N").alias("predicate"), F.lit(0.05).alias("c"))
    new = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("predicate"), F.col("l_discount").alias("c"))
    return new.unionByName(stored).groupBy("key", "predicate").agg(F.max("c").alias("confidence"))


@query("WITH x AS (SELECT s_suppkey, unnest([{'reason': 'address', 'v': s_nationkey || '/' || floor(s_acctbal / 100)::BIGINT}, {'reason': 'balance', 'v': (floor(s_acctbal / 10)::BIGINT)::VARCHAR}]) AS c FROM supplier), k AS (SELECT * FROM x WHERE c IN (SELECT c FROM x GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40)) SELECT a.s_suppkey AS a, b.s_suppkey AS b, array_to_string(list_sort(list(a.c.reason)), ',') AS reasons FROM k a JOIN k b ON a.c = b.c AND a.s_suppkey < b.s_suppkey GROUP BY 1, 2")
def z01_pair_reasons(spark, d):
    """Pairs that share an address or a band of balances, with the reasons; groups of more than 40 aren't paired."""
    reason = lambda name, value: F.struct(F.lit(name).alias("reason"), value.alias("v"))
    place = F.concat_ws("/", F.col("s_nationkey").cast("string"), F.floor(F.col("s_acctbal") / 100).cast("string"))
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(reason("address", place), reason("balance", F.floor(F.col("s_acctbal") / 10).cast("string")))).alias("x"))
    small = s.groupBy("x").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 40").select("x")
    kept = s.join(small, "x", "left_semi")
    pairs = kept.select(F.col("s_suppkey").alias("a"), "x").join(kept.select(F.col("s_suppkey").alias("b"), "x"), "x").where("a < b")
    return pairs.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("x.reason")), ",").alias("reasons"))


@query("SELECT l_suppkey AS source, l_partkey AS target, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS predicates FROM lineitem GROUP BY 1, 2")
def z11_pair_predicates(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("predicates"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def z34_month(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("-", F.year("o_orderdate"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")).alias("month"))


@query("WITH r AS (SELECT * FROM (VALUES ('/', true), ('/en/', false), ('/en/2', true)) AS v(prefix, allow)), m AS (SELECT page_id, prefix, allow, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages, r) SELECT page_id, arg_max(allow, len(prefix)) AS allowed FROM m WHERE starts_with(path, prefix) GROUP BY 1")
def r09_robots(spark, d):
    """Longest matching prefix of a rule table of a few rows."""
    rule = F.broadcast(spark.createDataFrame([("/", True), ("/en/", False), ("/en/2", True)], "prefix string, allow boolean"))
    path = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]+", "").alias("path"))
    return path.join(rule, F.startswith(F.col("path"), F.col("prefix"))).groupBy("page_id").agg(F.max_by("allow", F.length("prefix")).alias("allowed"))
