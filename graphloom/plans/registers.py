"""Queries over registers, leaks, passenger lists, sinks and the small rules around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import sinks
from graphloom.functions import support
from graphloom.operators import resolve
from graphloom.plans.registry import query
from graphloom.session import new_path
from graphloom.sources import registers
from graphloom.sources.relational import EDGES_SQL, ENTITIES_SQL, OBSERVATIONS_SQL, edges, entities, observations, table

_s = lambda c: F.col(c).cast("string")


def register(spark, d):
    """Parts as aircraft of customers; ten customers share an address, and one address has a great many."""
    customer = table(spark, d, "customer")
    raw = customer.select(
        F.concat(F.lit(" "), (F.col("c_custkey") % 90000 + 10000).cast("string"), F.lit("q ")).alias("N-NUMBER"),
        F.concat(F.lit("JANE DOE"), F.when(F.col("c_custkey") % 6 == 0, " AVIATION LLC").otherwise(""), F.lit(" "), _s("c_custkey")).alias("NAME"),
        F.when(F.col("c_custkey") % 4 == 0, "1 Register St").otherwise(F.concat(F.floor(F.col("c_custkey") / 10).cast("string"), F.lit(" Long Rd"))).alias("STREET"),
        F.lit("Springfield").alias("CITY"), F.lit("").alias("STATE"), F.lit("US").alias("COUNTRY"),
    )
    return registers.aircraft_register(raw.toDF("n_number", "name", "street", "city", "state", "country"))


_REGISTER_SQL = """
reg AS (SELECT 'N' || (c_custkey % 90000 + 10000) || 'Q' AS tail, 'Jane Doe' || CASE WHEN c_custkey % 6 = 0 THEN ' Aviation Llc' ELSE '' END || ' ' || c_custkey AS owner,
    CASE WHEN c_custkey % 6 = 0 THEN 'Organization' ELSE 'Person' END AS owner_type,
    CASE WHEN c_custkey % 4 = 0 THEN '1 Register St' ELSE (c_custkey // 10) || ' Long Rd' END || ', Springfield, US' AS address,
    CASE WHEN c_custkey % 4 = 0 THEN '1registerstreet' ELSE (c_custkey // 10) || 'longroad' END || 'springfieldus' AS address_key FROM customer)"""


@query(f"WITH {_REGISTER_SQL} SELECT tail, owner, owner_type, address, address_key FROM reg")
def s14_aircraft_register(spark, d):
    return register(spark, d).select("tail", "owner", "owner_type", "address", "address_key")


@query(f"WITH {_REGISTER_SQL} SELECT owner AS subject, 'OWNS' AS predicate, tail AS object FROM reg UNION ALL SELECT tail, 'REGISTERED_IN', 'US' FROM reg UNION ALL SELECT owner, 'LOCATED_IN', address FROM reg")
def s14_register_edges(spark, d):
    return registers.register_edges(register(spark, d)).select("subject", "predicate", "object")


@query(
    f"WITH {_REGISTER_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY address_key) AS n FROM (SELECT DISTINCT address_key, owner, owner_type, address FROM reg)), "
    "pairs AS (SELECT a.owner AS subject, b.owner AS object, row_number() OVER (PARTITION BY a.address_key ORDER BY a.owner, b.owner) AS k FROM sized a JOIN sized b ON a.address_key = b.address_key AND a.owner < b.owner "
    "WHERE a.n BETWEEN 2 AND 40 AND a.owner_type = 'Person' AND b.owner_type = 'Person'), large AS (SELECT *, row_number() OVER (PARTITION BY address_key ORDER BY owner) AS k FROM sized WHERE n > 40) "
    "SELECT subject, 'SHARES_ADDRESS' AS predicate, object FROM pairs WHERE k <= 24 UNION ALL SELECT owner, 'LOCATED_IN', address FROM large WHERE k <= 24"
)
def s15_shared_addresses(spark, d):
    return registers.shared_addresses(register(spark, d)).select("subject", "predicate", "object")


@query(
    "SELECT 'P' || o_custkey AS subject, 'PASSENGER_ON' AS predicate, 'C' || l_partkey AS object, 'listed aboard C' || l_partkey || ' on ' || l_shipdate::DATE || ' from ' || l_returnflag || ' to ' || l_linestatus AS evidence, count(*) AS n "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 1 GROUP BY ALL"
)
def s17_passengers(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    listed = lines.select(
        F.when(F.col("l_linenumber") == 1, "TOTAL 12").otherwise(F.concat(F.lit(" P"), _s("o_custkey"))).alias("passenger"), F.concat(F.lit("C"), _s("l_partkey")).alias("craft"),
        F.to_date("l_shipdate").cast("string").alias("date"), F.col("l_returnflag").alias("origin"), F.col("l_linestatus").alias("destination"),
    )
    padded = listed.withColumn("passenger", F.when(F.length(F.trim("passenger")) < 3, F.lpad(F.trim("passenger"), 3, "_")).otherwise(F.col("passenger")))
    found = registers.passenger_edges(padded).withColumn("subject", F.replace("subject", F.lit("_"), F.lit("")))
    return found.groupBy("subject", "predicate", "object", "evidence").agg(F.count("*").alias("n"))


@query(
    "WITH a AS (SELECT DISTINCT o_orderpriority AS log, 'C' || l_partkey AS craft, 'P' || o_custkey AS person FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "p AS (SELECT x.log, x.craft, x.person AS subject, y.person AS object, row_number() OVER (PARTITION BY x.log, x.craft ORDER BY x.person, y.person) AS k FROM a x JOIN a y ON x.log = y.log AND x.craft = y.craft AND x.person < y.person) "
    "SELECT log, craft, subject, object, 'TRAVELED_WITH' AS predicate FROM p WHERE k <= 60"
)
def s18_travelled_together(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    aboard = lines.select(F.col("o_orderpriority").alias("log"), F.concat(F.lit("C"), _s("l_partkey")).alias("craft"), F.concat(F.lit("P"), _s("o_custkey")).alias("person"))
    return registers.travelled_together(aboard)


@query(
    "SELECT c_name AS subject, 'DIRECTOR_OF' AS predicate, 'S' || c_nationkey AS object FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_name, 'REGISTERED_IN', 'N' || c_nationkey FROM customer WHERE c_custkey % 3 <> 0 "
    "UNION ALL SELECT c_name, 'LOCATED_IN', c_custkey || ' Some Street' FROM customer WHERE c_custkey % 3 = 1"
)
def s04_leak_rows(spark, d):
    """A leak's rows: links, and nodes with a jurisdiction and an address or none."""
    key, none = F.col("c_custkey"), F.lit("")
    rows = table(spark, d, "customer").select(
        _s("c_custkey").alias("node_id"), F.when(key % 3 != 0, F.col("c_name")).otherwise(none).alias("name"), none.alias("original_name"),
        F.when(key % 3 != 0, F.concat(F.lit("N"), _s("c_nationkey"))).alias("jurisdiction"),
        F.when(key % 3 == 1, F.concat(_s("c_custkey"), F.lit(" Some Street"))).when(key % 3 == 2, F.concat(F.lit("n"), _s("c_nationkey"))).alias("address"),
        F.when(key % 3 == 0, "Director / Board member of").otherwise(none).alias("link_type"), F.lit("x").alias("start_node"), F.col("c_name").alias("start_name"),
        F.lit("y").alias("end_node"), F.concat(F.lit("S"), _s("c_nationkey")).alias("end_name"),
    )
    return registers.leak_edges(rows).select("subject", "predicate", "object")


@query("SELECT s_suppkey AS page_id, s_name AS subject, CASE WHEN s_suppkey % 2 = 0 THEN 'SHAREHOLDER_OF' ELSE 'LOCATED_IN' END AS predicate, 'Other ' || s_nationkey AS object FROM supplier")
def s05_node_pages(spark, d):
    told = F.when(F.col("s_suppkey") % 2 == 0, "is a <b>shareholder</b> of").otherwise("has its address with")
    page = F.concat(
        F.lit("<html><h1 class='x'>"), "s_name", F.lit("</h1><table><tr><th>no link</th></tr><tr><td>"), told, F.lit('</td><td><a href="/nodes/'), _s("s_suppkey"),
        F.lit('">Other <i>'), _s("s_nationkey"), F.lit("</i></a></td></tr></table>"),
    )
    return registers.node_page_edges(table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), page.alias("html"))).select("page_id", "subject", "predicate", "object")


@query(
    "SELECT 'Ann ' || s_suppkey AS subject, 'DIRECTOR_OF' AS predicate, s_name AS object FROM supplier UNION ALL SELECT 'Bob', 'OFFICER_OF', s_name FROM supplier UNION ALL SELECT s_name, 'REGISTERED_IN', 'GB' FROM supplier "
    "UNION ALL SELECT s_name, 'LOCATED_IN', s_suppkey || ' High Street' FROM supplier UNION ALL SELECT s_name, 'SUBSIDIARY_OF', 'Parent ' || s_nationkey FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT s_name, 'OPERATES_IN', 'Mining' FROM supplier"
)
def s08_company_officers(spark, d):
    """A company register's JSON: officers, address, industry and parent."""
    officer = lambda name, position: F.struct(F.struct(name.alias("name"), F.lit(position).alias("position")).alias("officer"))
    body = F.to_json(F.struct(
        F.col("s_name").alias("name"), F.lit("gb").alias("jurisdiction_code"), F.concat(_s("s_suppkey"), F.lit(" High Street")).alias("registered_address_in_full"),
        F.array(officer(F.concat(F.lit("Ann "), _s("s_suppkey")), "Managing Director"), officer(F.lit("Bob"), "clerk")).alias("officers"),
        F.array(F.struct(F.struct(F.lit("08").alias("code"), F.lit("Mining").alias("description")).alias("industry_code"))).alias("industry_codes"),
        F.when(F.col("s_nationkey") % 2 == 0, F.struct(F.concat(F.lit("Parent "), _s("s_nationkey")).alias("name"))).alias("parent_company"),
    ))
    return registers.company_edges(table(spark, d, "supplier").select(body.alias("company")))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 0 ELSE 1 END + CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE 0 END AS n FROM orders")
def s25_record_arrays(spark, d):
    at = F.col("o_orderkey") % 3
    body = F.when(at == 0, '[{"a": "1"}, {"a": "2"}]').when(at == 1, '{"meta": 1, "data": [{"a": "1"}]}').otherwise('{"meta": 1}')
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.size(registers.record_array(body, "struct<a: string>")), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


# --- sinks ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0")
def k08_drop_unnamed(spark, d):
    """Entities whose name has no letter or digit are left out."""
    from graphloom.functions.names import normalize

    name = F.when(F.col("p_partkey") % 4 == 0, " -- ").otherwise(F.col("p_name"))
    return table(spark, d, "part").where(normalize(name, F.lit("Craft")) != "").select("p_partkey")


@query("SELECT s_suppkey AS key, bool_or(l_orderkey % 3 <> 0) AS is_new FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1")
def k09_new_evidence(spark, d):
    """Whether any document of an entity isn't among those stored for it."""
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("doc")).distinct()
    stored = line.where("doc % 3 = 0").withColumn("stored", F.lit(True))
    return line.join(stored, ["key", "doc"], "left").groupBy("key").agg(F.bool_or(F.col("stored").isNull()).alias("is_new"))


@query("SELECT sha256('L' || n_nationkey) || '.json' AS file, 1 AS n FROM nation UNION ALL SELECT sha256('R' || n_regionkey) || '.json', count(*)::INTEGER FROM nation GROUP BY n_regionkey")
def k10_published_slices(spark, d):
    """Nations and regions published as slices, and read back by their manifest."""
    nation = table(spark, d, "nation")
    links = nation.select(F.concat(F.lit("L"), _s("n_nationkey")).alias("source"), F.concat(F.lit("R"), _s("n_regionkey")).alias("target"), F.lit("LOCATED_IN").alias("type"))
    nodes = links.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("type", F.lit("Location"))
    path = new_path(spark, "published")
    sinks.publish(nodes, links, path)
    again = sinks.publish(nodes.repartition(3), links.repartition(2), path)
    if again != sinks.revision(sinks.slices(nodes, links)):
        raise ValueError("a revision depends on the order of the rows")
    count = F.size(F.from_json(F.get_json_object("body", "$.edges"), "array<struct<source: string>>"))
    return sinks.read_published(spark, path).select("file", count.alias("n"))


@query("SELECT p_partkey || ',\"' || p_name || ', \"\"' || p_brand || '\"\"\",' AS line FROM part")
def k11_csv_lines(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"), F.lit(None).cast("string").alias("none"))
    return sinks.csv_lines(rows, ["p_partkey", "label", "none"])


@query(
    f"WITH {OBSERVATIONS_SQL}, u AS (SELECT doc_id AS id, 'E ' || subject AS use FROM observations WHERE predicate = 'CONTRACTED_WITH' UNION SELECT doc_id, subject || ' → ' || object FROM observations WHERE predicate = 'CONTRACTED_WITH') "
    "SELECT id, array_to_string(list_sort(list(use)), ' | ') AS used_by FROM u WHERE id IN (SELECT DISTINCT id FROM u ORDER BY id LIMIT 5000) GROUP BY id"
)
def k11_evidence_list(spark, d):
    o = observations(spark, d).where("predicate = 'CONTRACTED_WITH'")
    nodes = o.select(F.concat(F.lit("E "), "subject").alias("label"), F.array("doc_id").alias("docs"))
    links = o.select(F.col("subject").alias("source_label"), F.col("object").alias("target_label"), F.array("doc_id").alias("docs"))
    evidence = spark.createDataFrame([], "id string, title string, source string, date string, url string")
    return sinks.evidence_uses(nodes, links, evidence).select("id", "used_by")


@query("SELECT r_name AS name, length(r_name)::BIGINT + 1 AS n FROM region")
def k14_archive(spark, d):
    """One archive of a file a region, written twice alike, and read back."""
    import io
    import zipfile

    rows = [(r.r_name, r.r_name + "\n") for r in table(spark, d, "region").orderBy("r_name").collect()]  # five rows
    packed = sinks.archive(rows)
    if packed != sinks.archive(rows):
        raise ValueError("the same files give another archive")
    with zipfile.ZipFile(io.BytesIO(packed)) as archive:
        return spark.createDataFrame([(i.filename, i.file_size) for i in archive.infolist()], "name string, n long")


@query("SELECT 0 AS no, '# Regions' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '## largest' UNION ALL SELECT 3, '' UNION ALL SELECT 4, '| r_name |' UNION ALL SELECT 5, '| --- |' UNION ALL SELECT (5 + row_number() OVER (ORDER BY r_name))::INTEGER, '| ' || r_name || ' |' FROM region")
def c10_report(spark, d):
    text = sinks.markdown("Regions", {"largest": table(spark, d, "region").orderBy("r_name").select("r_name")})
    return spark.createDataFrame(list(enumerate(text.splitlines())), "no int, line string")


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(trim(text)) > 0")
def z46_messages(spark, d):
    """Texts as messages: none longer than allowed, and no sign lost but for the line ends between them."""
    docs = table(spark, d, "documents").where(F.length(F.trim("text")) > 0).select("doc_id", F.length("text").alias("whole"), sinks.messages(F.col("text")).alias("m"))
    parts = docs.select("doc_id", "whole", F.size("m").alias("parts"), F.aggregate("m", F.lit(0), lambda a, x: a + F.length(x)).alias("n"), F.exists("m", lambda x: F.length(x) > sinks.MESSAGE).alias("long"))
    right = ~F.col("long") & F.col("n").between(F.col("whole") - F.col("parts") + 1, F.col("whole"))
    return parts.select("doc_id", F.when(right, F.col("whole")).cast("long").alias("n"))


# --- small rules ----------------------------------------------------------------------------------------------

_LABELS = ("PER", "gpe", "Vessel", "LAW", "org", "PRODUCT")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Person' WHEN 1 THEN 'Location' WHEN 2 THEN 'Craft' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'Organization' ELSE 'Craft' END AS kind FROM events")
def f44_label_types(spark, d):
    given = F.get(F.array(*map(F.lit, _LABELS)), (F.col("event_id") % 6).cast("int"))
    return table(spark, d, "events").select("event_id", support.label_type(given).alias("kind"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Aircraft_Registration' WHEN 1 THEN 'Bank_Account' WHEN 2 THEN NULL WHEN 3 THEN 'Organization' ELSE 'Crypto_Address' END AS label FROM events")
def f43_documented_labels(spark, d):
    given = F.get(F.array(*map(F.lit, ("Tail-Number", " IBAN ", "gadget", "organisation", "bitcoin_address"))), (F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").select("event_id", support.documented_label(given).alias("label"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Organization' WHEN 1 THEN NULL WHEN 2 THEN 'Location' ELSE 'Organization' END AS kind FROM events")
def f42_name_types(spark, d):
    at = (F.col("event_id") % 4).cast("int")
    label, text = F.get(F.array(*map(F.lit, ("MISC", "MISC", "GPE", "ORG"))), at), F.get(F.array(*map(F.lit, ("Acme  GmbH", "Golden Gate", "x", "y"))), at)
    return table(spark, d, "events").select("event_id", support.name_type(label, text).alias("kind"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'John McKay' WHEN 1 THEN 'Mary O''Neil' WHEN 2 THEN 'van der Berg' ELSE 'Anna-Lena Macdonald' END AS name FROM supplier")
def f32_humanised(spark, d):
    given = F.get(F.array(*map(F.lit, ("JOHN MCKAY", "MARY O'NEIL", "van der Berg", "Anna-Lena Macdonald"))), (F.col("s_suppkey") % 4).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", registers.humanise(given).alias("name"))


@query("SELECT s_suppkey, s_suppkey % 3 <> 1 AS corporate, s_suppkey % 3 = 1 AS person FROM supplier")
def f33_name_kinds(spark, d):
    given = F.get(F.array(*map(F.lit, ("Blue Sky Charter", "Jane Ann Doe", "Doe Family Trust"))), (F.col("s_suppkey") % 3).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", registers.looks_corporate(given).alias("corporate"), registers.looks_like_person(given).alias("person"))


@query("SELECT s_suppkey, s_suppkey % 3 <> 2 AS matched, CASE s_suppkey % 3 WHEN 1 THEN 'token' ELSE 'string' END AS signal FROM supplier")
def f19_name_match(spark, d):
    at = (F.col("s_suppkey") % 3).cast("int")
    a = F.get(F.array(*map(F.lit, ("Northwind Marine Limited", "Elena Petrovna Markova", "Alpha Trading"))), at)
    b = F.get(F.array(*map(F.lit, ("Northwind Marine Ltd", "Markova Elena", "Zebra Quarry"))), at)
    rows = table(spark, d, "supplier").select("s_suppkey", support.match(a, b).alias("m"))
    return rows.select("s_suppkey", (F.col("m.score") >= support.MATCH).alias("matched"), "m.signal")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN DATE '2021-03-09' WHEN 1 THEN DATE '1999-12-01' WHEN 2 THEN DATE '1987-01-01' END AS day, CASE p_partkey % 4 WHEN 1 THEN '1999-12' WHEN 3 THEN '0012' END AS month FROM part")
def z29_fuzzy_dates(spark, d):
    given = F.get(F.array(*map(F.lit, ("signed 2021-03-09 in Rome", "1999-12 or so", "since 1987", "0012 is too early"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", support.fuzzy_date(given, F.lit("2024-01-01").cast("date")).alias("day"), support.month_or_year(given).alias("month"))


@query("SELECT p_partkey, p_size IN (6, 12, 24, 60) AS fresh FROM part")
def p12_fresh_windows(spark, d):
    return table(spark, d, "part").select("p_partkey", support.fresh_window(F.col("p_size")).alias("fresh"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9])(bl|ri)')")
def z53_prefix_search(spark, d):
    asked = support.prefix_query(F.lit("Bl a RI"))
    return table(spark, d, "part").where(support.matches_prefixes(F.col("p_name"), asked)).select("p_partkey", "p_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS n FROM orders")
def z41_model_json(spark, d):
    said = F.when(F.col("o_orderkey") % 2 == 0, 'Sure:\n```json\n[{"s": "a"}, {"s": "b"}]\n```').otherwise("I can't.")
    found = support.model_json(said, "struct<s: string>")
    return table(spark, d, "orders").select("o_orderkey", F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0)).alias("n"))


@query(f"WITH {ENTITIES_SQL} SELECT key, CASE WHEN entity_type = 'Craft' THEN 'Unknown' ELSE entity_type END AS kind FROM entities")
def z10_types_of_labels(spark, d):
    labels = F.when(F.col("entity_type") == "Craft", F.array(F.lit("Entity"))).otherwise(F.array(F.lit("Entity"), F.col("entity_type"), F.lit("Offshore")))
    return entities(spark, d).select("key", support.type_of_labels(labels).alias("kind"))


@query(f"WITH {EDGES_SQL} SELECT object, predicate, max(confidence) AS confidence, arg_min(subject, (-confidence, subject)) AS subject FROM edges GROUP BY 1, 2")
def z09_strongest(spark, d):
    """Of all edges to one target the strongest of each predicate."""
    return edges(spark, d).groupBy("object", "predicate").agg(F.max("confidence").alias("confidence"), F.min_by("subject", F.struct(-F.col("confidence"), "subject")).alias("subject"))


@query(f"WITH {EDGES_SQL}, {ENTITIES_SQL}, g AS (SELECT k, count(*) AS degree FROM (SELECT subject AS k FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1) SELECT key, name, entity_type, coalesce(degree, 0)::BIGINT AS degree FROM entities LEFT JOIN g ON key = k WHERE key IN (SELECT 'P' || (o_custkey) FROM orders WHERE o_orderstatus = 'F')")
def j04_node_lookup(spark, d):
    """Attributes and degree of listed nodes."""
    asked = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("P"), _s("o_custkey")).alias("key")).distinct()
    degree = edges(spark, d).select(F.explode(F.array("subject", "object")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    return entities(spark, d).join(asked, "key", "left_semi").join(degree, "key", "left").select("key", "name", "entity_type", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


@query("WITH s AS (SELECT 'O' || s_suppkey AS key, s_nationkey AS block, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'Organization' END AS kind FROM supplier) SELECT a.key AS a, b.key AS b FROM s a JOIN s b ON a.block = b.block AND a.key < b.key AND (a.kind = b.kind OR a.kind = '' OR b.kind = '')")
def j08_pairs_in_blocks(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("O"), _s("s_suppkey")).alias("key"), F.col("s_nationkey").alias("block"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise("Organization").alias("entity_type"))
    return resolve.pairs_in_blocks(s).select("a", "b")


@query(f"WITH {OBSERVATIONS_SQL} SELECT 'predicate' AS what, predicate AS value, count(*) AS n FROM observations GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM observations GROUP BY 2")
def a12_histograms(spark, d):
    cells = F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("predicate", "source")))
    return observations(spark, d).select(F.inline(cells)).groupBy("what", "value").agg(F.count("*").alias("n"))


@query(
    f"WITH {EDGES_SQL}, {ENTITIES_SQL}, c AS (SELECT (SELECT count(*) FROM entities) AS nodes, (SELECT count(*) FROM edges) AS links) SELECT nodes, links, round(nodes / 200000.0::DOUBLE, 4) AS node_share, round(links / 400000.0::DOUBLE, 4) AS edge_share, "
    "greatest(0, 200000 - nodes) AS headroom, greatest(0, 180000 - nodes) AS to_stop, nodes >= 180000 AS stop, round(nodes / 200000.0::DOUBLE, 4) >= 0.85 OR round(links / 400000.0::DOUBLE, 4) >= 0.85 OR nodes >= 180000 AS over_target FROM c"
)
def a01_full_capacity(spark, d):
    return resolve.capacity(entities(spark, d), edges(spark, d))
