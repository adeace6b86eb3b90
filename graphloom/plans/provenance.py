"""Queries over evidence: joins, filters, aggregates, rankings, differences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.craft import fnv_bin
from graphloom.operators import provenance, resolve
from graphloom.plans.registry import query
from graphloom.sources.relational import EDGES_SQL, ENTITIES_SQL, OBSERVATIONS_SQL, edges, entities, observations, table

_E = f"WITH {ENTITIES_SQL}"
_O = f"WITH {OBSERVATIONS_SQL}"
_G = f"WITH {EDGES_SQL}"
_BOTH = f"WITH {ENTITIES_SQL}, {EDGES_SQL}"


# --- joins -------------------------------------------------------------------------------------------------


@query(
    "WITH m AS (SELECT l_orderkey AS doc, l_linenumber * 40 AS at, l_suppkey AS key FROM lineitem) SELECT a.key AS a, b.key AS b, count(*) AS n FROM m a JOIN m b ON a.doc = b.doc "
    "AND a.key < b.key AND abs(a.at - b.at) <= 120 GROUP BY 1, 2"
)
def j01_band_join(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 40).alias("at"), F.col("l_suppkey").alias("key"))
    return provenance.band_pairs(m, 120)


#: Suppliers at one address: of a nation, and with balances in one band; groups of more than 40 aren't paired.
ADDRESS_SQL = "a0 AS (SELECT s_suppkey, s_nationkey || '/' || floor(s_acctbal / 100)::BIGINT AS address FROM supplier), addressed AS (SELECT * FROM a0 WHERE address IN (SELECT address FROM a0 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40))"
LARGEST_ADDRESS = 40


def addressed(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.concat_ws("/", F.col("s_nationkey").cast("string"), F.floor(F.col("s_acctbal") / 100).cast("string")).alias("block"), F.lit("").alias("entity_type"))


@query(f"WITH {ADDRESS_SQL} SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM addressed a JOIN addressed b ON a.address = b.address AND a.s_suppkey < b.s_suppkey")
def j02_shared_address(spark, d):
    return resolve.pairs_in_blocks(addressed(spark, d), LARGEST_ADDRESS)


@query(
    f"WITH {ADDRESS_SQL}, p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM addressed a JOIN addressed b ON a.address = b.address AND a.s_suppkey < b.s_suppkey) SELECT a, b FROM p "
    "WHERE EXISTS (SELECT 1 FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_suppkey = p.a AND y.l_suppkey = p.b)"
)
def j03_co_occurrence_guard(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    x = lines.select("l_orderkey", F.col("l_suppkey").alias("a"))
    y = lines.select("l_orderkey", F.col("l_suppkey").alias("b"))
    together = j02_shared_address(spark, d).select("a", "b").join(x, "a").join(y, ["b", "l_orderkey"], "left_semi")
    return together.select("a", "b").distinct()


@query(_BOTH + " SELECT subject, object, s.jurisdiction AS from_place, o.entity_type AS to_type, e.confidence FROM edges e JOIN entities s ON subject = s.key JOIN entities o ON object = o.key WHERE predicate = 'CONTRACTED_WITH' AND e.confidence >= 0.8")
def j05_control_edges(spark, d):
    who = entities(spark, d)
    strong = edges(spark, d).where("predicate = 'CONTRACTED_WITH' AND confidence >= 0.8").select("subject", "object", "confidence")
    named = strong.join(who.select(F.col("key").alias("subject"), F.col("jurisdiction").alias("from_place")), "subject")
    return named.join(who.select(F.col("key").alias("object"), F.col("entity_type").alias("to_type")), "object").select("subject", "object", "from_place", "to_type", "confidence")


@query(_G + " SELECT CASE WHEN predicate = 'OPERATES' THEN object ELSE subject END AS owner, CASE WHEN predicate = 'OPERATES' THEN subject ELSE object END AS owned, confidence FROM edges WHERE confidence >= 0.7")
def j06_direction_normalised(spark, d):
    inverse = F.col("predicate") == "OPERATES"
    return edges(spark, d).where("confidence >= 0.7").select(
        F.when(inverse, F.col("object")).otherwise(F.col("subject")).alias("owner"), F.when(inverse, F.col("subject")).otherwise(F.col("object")).alias("owned"), "confidence"
    )


@query(_BOTH + ", g AS (SELECT k AS key, count(*) AS degree FROM (SELECT subject AS k FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1) SELECT key, entity_type, coalesce(degree, 0) AS degree FROM entities LEFT JOIN g USING (key) ORDER BY coalesce(degree, 0) DESC, key LIMIT 200")
def j07_degree(spark, d):
    ends = edges(spark, d).select(F.explode(F.array("subject", "object")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    joined = entities(spark, d).select("key", "entity_type").join(ends, "key", "left").select("key", "entity_type", F.coalesce("degree", F.lit(0)).alias("degree"))
    return joined.orderBy(F.desc("degree"), "key").limit(200)


@query("WITH k AS (SELECT c_custkey AS id, unnest(['n' || c_nationkey || c_mktsegment, 'b' || floor(c_acctbal)::BIGINT]) AS identifier FROM customer) SELECT identifier, count(DISTINCT id) AS members, min(id) AS first FROM k GROUP BY 1 HAVING count(DISTINCT id) > 1")
def j11_shared_identifiers(spark, d):
    ids = F.array(F.concat(F.lit("n"), F.col("c_nationkey"), F.col("c_mktsegment")), F.concat(F.lit("b"), F.floor("c_acctbal").cast("string")))
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(ids).alias("identifier"))
    return k.groupBy("identifier").agg(F.countDistinct("id").alias("members"), F.min("id").alias("first")).where("members > 1")


@query("WITH a AS (SELECT lower(p_name) AS alias, p_partkey AS key, p_size AS mentions FROM part), r AS (SELECT alias, key, row_number() OVER (PARTITION BY alias ORDER BY mentions DESC, key) AS k FROM a WHERE len(alias) >= 3) SELECT p_partkey, r.key AS resolved FROM part JOIN r ON lower(p_name) = alias AND k = 1")
def j12_alias_lookup(spark, d):
    part = table(spark, d, "part").withColumn("alias", F.lower("p_name"))
    best = part.where(F.length("alias") >= 3).groupBy("alias").agg(F.min_by("p_partkey", F.struct(-F.col("p_size"), "p_partkey")).alias("resolved"))
    return part.join(best, "alias").select("p_partkey", "resolved")


@query("SELECT l_orderkey AS doc, count(DISTINCT l_suppkey) AS entities FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def j16_shared_sources(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.countDistinct("l_suppkey").alias("entities")).where("entities >= 2")


@query("SELECT count(*) AS dangling FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def j18_dangling(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("dangling"))


# --- filters -----------------------------------------------------------------------------------------------


@query(
    _BOTH + ", kept AS (SELECT key FROM entities WHERE entity_type IN ('Person', 'Organization') AND confidence >= 0.7 AND first_seen <= DATE '1996-06-30' AND last_seen >= DATE '1995-01-01') "
    "SELECT subject, predicate, object FROM edges WHERE subject IN (SELECT key FROM kept) AND object IN (SELECT key FROM kept) AND confidence >= 0.5"
)
def p01_slice(spark, d):
    kept = entities(spark, d).where("entity_type IN ('Person', 'Organization') AND confidence >= 0.7 AND first_seen <= DATE'1996-06-30' AND last_seen >= DATE'1995-01-01'").select("key")
    strong = edges(spark, d).where("confidence >= 0.5").select("subject", "predicate", "object")
    return strong.join(kept, F.col("subject") == F.col("key"), "left_semi").join(kept, F.col("object") == F.col("key"), "left_semi")


@query(
    "WITH f AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN true END AS blocked, CASE l.quality WHEN 1 THEN true WHEN 0 THEN false END AS released, d.source FROM documents d LEFT JOIN labels l USING (doc_id)) "
    "SELECT doc_id, CASE WHEN blocked THEN false WHEN released IS NOT DISTINCT FROM false THEN false WHEN released THEN true ELSE source IN ('src0', 'src1', 'src2') END AS approved FROM f"
)
def p02_approved(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    blocked, released = F.when(F.col("toxic") == 1, True), F.when(F.col("quality") == 1, True).when(F.col("quality") == 0, False)
    verdict = (
        F.when(blocked, False).when(released.eqNullSafe(F.lit(False)), False).when(released, True).otherwise(F.col("source").isin("src0", "src1", "src2"))
    )
    return docs.join(labels, "doc_id", "left").select("doc_id", verdict.alias("approved"))


@query(
    _BOTH + ", g AS (SELECT k AS key, count(*) AS degree, min(weight) AS low FROM (SELECT subject AS k, weight FROM edges UNION ALL SELECT object, weight FROM edges) GROUP BY 1) "
    "SELECT key, coalesce(degree, 0) AS degree FROM entities LEFT JOIN g USING (key) WHERE coalesce(degree, 0) <= 1 AND (degree IS NULL OR low < 0.7) ORDER BY coalesce(degree, 0), key LIMIT 500"
)
def p04_orphans(spark, d):
    ends = edges(spark, d).select(F.explode(F.array("subject", "object")).alias("key"), "weight").groupBy("key").agg(F.count("*").alias("degree"), F.min("weight").alias("low"))
    joined = entities(spark, d).select("key").join(ends, "key", "left")
    weak = joined.where("coalesce(degree, 0) <= 1 AND (degree IS NULL OR low < 0.7)").select("key", F.coalesce("degree", F.lit(0)).alias("degree"))
    return weak.orderBy("degree", "key").limit(500)


@query(
    _O + ", b AS (SELECT subject, predicate, object, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS outlets FROM observations GROUP BY 1, 2, 3) "
    "SELECT CASE WHEN docs = 1 THEN 'single' WHEN outlets > 1 THEN 'independent' ELSE 'shared' END AS status, count(*) AS n FROM b GROUP BY 1"
)
def p08_source_independence(spark, d):
    backed = provenance.backing(observations(spark, d))
    return backed.groupBy(provenance.source_status(F.col("docs"), F.col("outlets"), F.col("unnamed")).alias("status")).agg(F.count("*").alias("n"))


@query(_E + " SELECT key, first_seen FROM entities WHERE first_seen >= DATE '1997-01-01'")
def p11_new_entities(spark, d):
    return entities(spark, d).where("first_seen >= DATE'1997-01-01'").select("key", "first_seen")


# --- aggregates --------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM lineitem) AS edges, round(((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)) / 200000.0, 6)::DOUBLE AS utilisation")
def a01_capacity(spark, d):
    one = lambda name: table(spark, d, name).agg(F.count("*").alias(name))
    joined = one("customer").crossJoin(one("supplier")).crossJoin(one("part")).crossJoin(one("lineitem"))  # scalars: one row each
    nodes = F.col("customer") + F.col("supplier") + F.col("part")
    return joined.select(nodes.alias("nodes"), F.col("lineitem").alias("edges"), F.round(nodes / 200000, 6).alias("utilisation"))


@query(_BOTH + " SELECT key, count(DISTINCT subject) AS in_degree FROM entities LEFT JOIN edges ON object = key AND predicate = 'CONTRACTED_WITH' WHERE entity_type = 'Organization' GROUP BY 1")
def a03_in_degree(spark, d):
    control = edges(spark, d).where("predicate = 'CONTRACTED_WITH'").groupBy(F.col("object").alias("key")).agg(F.countDistinct("subject").alias("n"))
    return entities(spark, d).where("entity_type = 'Organization'").join(control, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("in_degree"))


@query(_O + " SELECT lower(trim(source)) AS outlet, count(DISTINCT doc_id) AS docs, count(DISTINCT subject) AS subjects, min(seen) AS first_seen, max(seen) AS last_seen, min(source) AS name FROM observations GROUP BY 1")
def a04_source_registry(spark, d):
    return observations(spark, d).groupBy(F.lower(F.trim("source")).alias("outlet")).agg(
        F.countDistinct("doc_id").alias("docs"), F.countDistinct("subject").alias("subjects"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.min("source").alias("name")
    )


@query(_E + ", m AS (SELECT strftime(first_seen, '%Y-%m') AS month, count(*) AS n FROM entities WHERE first_seen IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 24) SELECT month, n FROM m")
def a05_monthly_first_seen(spark, d):
    months = entities(spark, d).where("first_seen IS NOT NULL").groupBy(F.date_format("first_seen", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return months.orderBy(F.desc("month")).limit(24)


@query("SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS label, count(*) AS members, count(DISTINCT p_brand) = 1 AS same_type FROM part GROUP BY 1 HAVING count(*) >= 2")
def a06_duplicate_labels(spark, d):
    folded = F.lower(F.trim(F.regexp_replace("p_name", "\\s+", " ")))
    return table(spark, d, "part").groupBy(folded.alias("label")).agg(F.count("*").alias("members"), (F.countDistinct("p_brand") == 1).alias("same_type")).where("members >= 2")


_FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT"


@query(_E + f" SELECT entity_type, {_FNV.format('key')} % 32 AS bin, count(*) AS members, round(avg(confidence), 6) AS confidence FROM entities GROUP BY 1, 2")
def a07_level_of_detail(spark, d):
    binned = entities(spark, d).select("entity_type", fnv_bin(F.col("key"), 32).alias("bin"), "confidence")
    return binned.groupBy("entity_type", "bin").agg(F.count("*").alias("members"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT floor(s_acctbal / 500.0)::BIGINT AS x, s_nationkey AS y, count(*) AS n, max(s_acctbal) AS highest FROM supplier GROUP BY 1, 2")
def a08_grid(spark, d):
    return table(spark, d, "supplier").groupBy(F.floor(F.col("s_acctbal") / 500).alias("x"), F.col("s_nationkey").alias("y")).agg(F.count("*").alias("n"), F.max("s_acctbal").alias("highest"))


@query(_G + " SELECT least(subject, object) AS a, greatest(subject, object) AS b, max(confidence) AS confidence, round(sum(weight), 4) AS weight, sum(observations)::BIGINT AS observations FROM edges GROUP BY 1, 2")
def a09_bundles(spark, d):
    return edges(spark, d).groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(
        F.max("confidence").alias("confidence"), F.round(F.sum("weight"), 4).alias("weight"), F.sum("observations").alias("observations")
    )


@query(_O + " SELECT key, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS outlets, max(seen) AS newest FROM (SELECT subject AS key, doc_id, source, seen FROM observations UNION ALL SELECT object, doc_id, source, seen FROM observations) GROUP BY 1")
def a10_node_backing(spark, d):
    ends = observations(spark, d).select(F.explode(F.array("subject", "object")).alias("key"), "doc_id", "source", "seen")
    return ends.groupBy("key").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("source").alias("outlets"), F.max("seen").alias("newest"))


@query(_G + " SELECT count(*) AS edges, count(*) FILTER (sources = 1) AS single_source, count(*) FILTER (sources = 1 AND confidence >= 0.6) AS thin_but_sure FROM edges")
def a11_provenance_gaps(spark, d):
    return edges(spark, d).agg(F.count("*").alias("edges"), F.count_if(F.col("sources") == 1).alias("single_source"), F.count_if((F.col("sources") == 1) & (F.col("confidence") >= 0.6)).alias("thin_but_sure"))


@query(
    _O + ", f AS (SELECT subject, predicate, object, source, min(seen) AS seen FROM observations GROUP BY 1, 2, 3, 4), l AS (SELECT source, datediff('day', min(seen) OVER w, seen) AS lag, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY subject, predicate, object)) "
    "SELECT source, count(*) FILTER (lag = 0) AS firsts, count(*) FILTER (lag > 0) AS followups, round(avg(lag) FILTER (lag > 0), 2) AS mean_lag FROM l WHERE n > 1 GROUP BY 1"
)
def a14_primacy(spark, d):
    return provenance.primacy(observations(spark, d))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a18_counters(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.countDistinct("user_id").alias("users"))


# --- rankings ----------------------------------------------------------------------------------------------


@query(_E + " SELECT jurisdiction, key FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY mentions DESC, confidence DESC, coalesce(first_seen, DATE '9999-12-31'), key) AS k FROM entities WHERE jurisdiction IS NOT NULL) WHERE k = 1")
def w01_winner(spark, d):
    order = F.struct(-F.col("mentions"), -F.col("confidence"), F.coalesce("first_seen", F.lit("9999-12-31").cast("date")), "key")
    return entities(spark, d).where("jurisdiction IS NOT NULL").groupBy("jurisdiction").agg(F.min_by("key", order).alias("key"))


@query(_G + " SELECT subject, object, confidence FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, object) AS k FROM edges WHERE subject LIKE 'P%') WHERE k <= 8 ORDER BY confidence DESC, subject, object LIMIT 2000")
def w04_top_targets(spark, d):
    best = W.partitionBy("subject").orderBy(F.desc("confidence"), "object")
    ranked = edges(spark, d).where("subject LIKE 'P%'").withColumn("k", F.row_number().over(best)).where("k <= 8")
    return ranked.orderBy(F.desc("confidence"), "subject", "object").limit(2000).select("subject", "object", "confidence")


@query(_E + " SELECT key, mentions FROM entities ORDER BY mentions DESC, key LIMIT 50")
def w05_top_scores(spark, d):
    return entities(spark, d).orderBy(F.desc("mentions"), "key").limit(50).select("key", "mentions")


@query(_E + " SELECT key, name, count(*) OVER () AS total FROM entities WHERE name LIKE '%ring%' ORDER BY confidence DESC, key LIMIT 20 OFFSET 20")
def w06_search_page(spark, d):
    found = entities(spark, d).where(F.contains(F.col("name"), F.lit("ring"))).withColumn("total", F.count("*").over(W.partitionBy()))
    return found.orderBy(F.desc("confidence"), "key").offset(20).limit(20).select("key", "name", "total")


@query(_O + " SELECT DISTINCT seen, doc_id, predicate FROM observations WHERE subject = 'P1' OR object = 'P1' ORDER BY seen, doc_id, predicate LIMIT 40")
def w07_timeline(spark, d):
    return observations(spark, d).where("subject = 'P1' OR object = 'P1'").select("seen", "doc_id", "predicate").distinct().orderBy("seen", "doc_id", "predicate").limit(40)


@query("WITH h AS (SELECT o_orderkey AS hop, o_custkey, o_orderdate::DATE AS first, lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) SELECT hop, first, coalesce(first < before, false) AS anachronism FROM h")
def w08_path_timeline(spark, d):
    before = F.lag("first").over(W.partitionBy("o_custkey").orderBy("hop"))
    hops = table(spark, d, "orders").select(F.col("o_orderkey").alias("hop"), "o_custkey", F.to_date("o_orderdate").alias("first"))
    return hops.withColumn("before", before).select("hop", "first", F.coalesce(F.col("first") < F.col("before"), F.lit(False)).alias("anachronism"))


@query("SELECT p_brand, round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER (), 6) AS share FROM part GROUP BY 1 ORDER BY share DESC, p_brand LIMIT 10")
def w09_shares(spark, d):
    totals = table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return totals.select("p_brand", F.round(F.col("v") / F.sum("v").over(W.partitionBy()), 6).alias("share")).orderBy(F.desc("share"), "p_brand").limit(10)


@query("SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events) ORDER BY value DESC, event_id LIMIT 25")
def w11_recent_top(spark, d):
    e = table(spark, d, "events")
    latest = e.agg(F.max("ts").alias("latest"))  # one row
    return e.crossJoin(latest).where(F.col("ts") >= F.col("latest") - F.make_interval(hours=F.lit(24))).orderBy(F.desc("value"), "event_id").limit(25).select("event_id", "value")


# --- differences and conflicts -----------------------------------------------------------------------------


@query("WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'unchanged' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k AND a.p = b.p GROUP BY 1")
def d01_snapshot_diff(spark, d):
    keyed = table(spark, d, "lineitem").select(F.concat_ws("|", "l_suppkey", "l_partkey").alias("key"), "l_shipdate")
    old, new = keyed.where("l_shipdate < TIMESTAMP'1998-01-01'"), keyed.where("l_shipdate >= TIMESTAMP'1998-01-01'")
    return provenance.snapshot_diff(old, new, "key").groupBy("status").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT l_suppkey AS id, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem WHERE l_suppkey < 4 GROUP BY 1) SELECT a.id AS a, b.id AS b, len(list_intersect(a.parts, b.parts))::INTEGER AS shared FROM n a JOIN n b ON a.id < b.id")
def d04_shared_neighbours(spark, d):
    n = table(spark, d, "lineitem").where("l_suppkey < 4").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("parts"))  # four stated ids at most
    a, b = n.select(F.col("l_suppkey").alias("a"), F.col("parts").alias("pa")), n.select(F.col("l_suppkey").alias("b"), F.col("parts").alias("pb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.size(F.array_intersect("pa", "pb")).alias("shared"))


_FLAGGED = "SELECT l_suppkey AS s, l_partkey AS o, CASE WHEN l_returnflag = 'R' THEN 'SOLD' ELSE 'OWNS' END AS predicate, l_shipdate::DATE AS seen, l_orderkey AS doc FROM lineitem"


@query(
    f"WITH o AS ({_FLAGGED}), g AS (SELECT s, o, predicate, min(seen) AS first, max(seen) AS last FROM o GROUP BY 1, 2, 3) SELECT CASE WHEN x.first <= y.last AND y.first <= x.last THEN 'conflict' ELSE 'sequence' END AS status, count(*) AS n "
    "FROM g x JOIN g y ON x.s = y.s AND x.o = y.o AND x.predicate < y.predicate GROUP BY 1"
)
def c01_conflicts(spark, d):
    o = table(spark, d, "lineitem").select(
        F.concat(F.lit("O"), F.col("l_suppkey")).alias("subject"), F.concat(F.lit("C"), F.col("l_partkey")).alias("object"),
        F.when(F.col("l_returnflag") == "R", "SOLD").otherwise("OWNS").alias("predicate"), F.to_date("l_shipdate").alias("seen"), F.col("l_orderkey").alias("doc_id"),
    )
    return provenance.conflicts(o).groupBy("status").agg(F.count("*").alias("n"))


@query(_G + " SELECT CASE WHEN last_seen < (SELECT max(last_seen) FROM edges) - INTERVAL 24 MONTH THEN 'stale' ELSE 'fresh' END AS freshness, count(*) AS n FROM edges GROUP BY 1")
def c02_freshness(spark, d):
    e = edges(spark, d)
    newest = e.agg(F.max("last_seen").alias("reference"))  # one row
    return e.crossJoin(newest).groupBy(provenance.freshness(F.col("last_seen"), F.col("reference"), 24).alias("freshness")).agg(F.count("*").alias("n"))


@query(_G + " SELECT CASE WHEN confidence < 0.3 THEN 'weak' WHEN sources = 1 THEN 'thin' WHEN last_seen < DATE '1997-01-01' THEN 'stale' ELSE 'solid' END AS grade, count(*) AS n FROM edges GROUP BY 1")
def c03_grades(spark, d):
    grade = F.when(F.col("confidence") < 0.3, "weak").when(F.col("sources") == 1, "thin").when(F.col("last_seen") < "1997-01-01", "stale").otherwise("solid")
    return edges(spark, d).groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


@query(
    _E + ", s AS (SELECT key, CASE WHEN lower(name) = 'red ring' THEN 100 WHEN lower(name) LIKE 'red ring%' THEN 90 WHEN lower(name) LIKE '%red%' THEN 50 WHEN lower(community) LIKE '%red%' THEN 12 END AS relevance FROM entities) "
    "SELECT key, relevance FROM s WHERE relevance IS NOT NULL ORDER BY relevance DESC, key LIMIT 50"
)
def c06_ranked_search(spark, d):
    name = F.lower("name")
    relevance = F.when(name == "red ring", 100).when(name.startswith("red ring"), 90).when(F.contains(name, F.lit("red")), 50).when(F.contains(F.lower("community"), F.lit("red")), 12)
    return entities(spark, d).select("key", relevance.alias("relevance")).where("relevance IS NOT NULL").orderBy(F.desc("relevance"), "key").limit(50)


@query(_BOTH + ", t AS (SELECT key FROM entities ORDER BY mentions DESC, key LIMIT 300) SELECT subject, predicate, object FROM edges WHERE subject IN (SELECT key FROM t) AND object IN (SELECT key FROM t)")
def c07_overview(spark, d):
    top = entities(spark, d).orderBy(F.desc("mentions"), "key").limit(300).select("key")
    return edges(spark, d).select("subject", "predicate", "object").join(F.broadcast(top), F.col("subject") == F.col("key"), "left_semi").join(F.broadcast(top), F.col("object") == F.col("key"), "left_semi")


@query(_BOTH + ", p AS (SELECT key, name, row_number() OVER (PARTITION BY entity_type ORDER BY confidence DESC, key) AS k FROM entities WHERE confidence >= 0.75) SELECT key, name FROM p WHERE k <= 100 AND (key IN (SELECT subject FROM edges) OR key IN (SELECT object FROM edges))")
def c12_publish(spark, d):
    best = W.partitionBy("entity_type").orderBy(F.desc("confidence"), "key")
    allowed = entities(spark, d).where("confidence >= 0.75").withColumn("k", F.row_number().over(best)).where("k <= 100").select("key", "name")
    linked = edges(spark, d).select(F.explode(F.array("subject", "object")).alias("key"))
    return allowed.join(linked, "key", "left_semi")
