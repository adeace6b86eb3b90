"""Queries over extraction. Texts are made of the tables' rows by a template, so that SQL knows what has to be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.extraction import frames
from graphloom.extraction import relation_rules as rules
from graphloom.functions import domain
from graphloom.operators.rules import suppress_overlaps
from graphloom.plans.registry import query
from graphloom.sources.relational import table

# --- craft ----------------------------------------------------------------------------------------------------

_SHIP = "lpad((l_orderkey % 900000 + 100000)::VARCHAR, 6, '0')"
_SUM = " + ".join(f"CAST(substring(s, {i + 1}, 1) AS INTEGER) * {7 - i}" for i in range(6))
#: One text a line: a ship's number with a right or a wrong check digit, a registration, a radio number, or a named ship.
_CRAFT_SQL = f"""
s0 AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {_SHIP} AS s FROM lineitem),
s1 AS (SELECT *, ({_SUM}) % 10 AS digit FROM s0)"""


def craft_texts(spark, d):
    line = table(spark, d, "lineitem")
    s = F.lpad((F.col("l_orderkey") % 900000 + 100000).cast("string"), 6, "0")
    digit = sum((F.substring(s, i + 1, 1).cast("int") * (7 - i) for i in range(6)), F.lit(0)) % 10
    wrong = (digit + F.when(F.col("l_linenumber") == 2, 1).otherwise(0)) % 10
    number = F.concat(s, wrong.cast("string"))
    text = (
        F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("A report names IMO "), number, F.lit(" twice, says the register.")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("They flew on 9H-V"), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), F.lit(" last week.")))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("A call came from MMSI "), F.lpad((F.col("l_partkey") % 900000000 + 100000000).cast("string"), 9, "0"), F.lit(" at night.")))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("Later the yacht Amber"), (F.col("l_suppkey") % 50).cast("string"), F.lit(" was seen.")))
        .otherwise(F.lit("No craft is named here, not in E-COMMERCE and not on the I-95."))
    )
    return line.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("doc_id"), text.alias("text"))


@query(
    f"WITH {_CRAFT_SQL} SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS doc_id, "
    "CASE l_linenumber WHEN 1 THEN 'imo_number' WHEN 3 THEN 'aircraft_registration' WHEN 4 THEN 'mmsi' ELSE 'craft_appositive' END AS kind, "
    "CASE l_linenumber WHEN 1 THEN s || digit WHEN 3 THEN '9H-V' || lpad((l_suppkey % 100)::VARCHAR, 2, '0') "
    "WHEN 4 THEN lpad((l_partkey % 900000000 + 100000000)::VARCHAR, 9, '0') ELSE 'Amber' || (l_suppkey % 50) END AS identifier, "
    "CASE l_linenumber WHEN 1 THEN 0.97 WHEN 3 THEN 0.95 WHEN 4 THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence FROM s1 WHERE l_linenumber IN (1, 3, 4, 5)"
)
def x01_craft_matches(spark, d):
    return frames.craft_matches(craft_texts(spark, d)).select("doc_id", "kind", "identifier", "confidence")


@query("SELECT CASE l_linenumber WHEN 1 THEN 'imo_number' WHEN 3 THEN 'aircraft_registration' WHEN 4 THEN 'mmsi' ELSE 'craft_appositive' END AS kind, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3, 4, 5) GROUP BY 1")
def x03_craft_summary(spark, d):
    return frames.craft_matches(craft_texts(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


# --- names and statements -------------------------------------------------------------------------------------

_VERBS = ("owns", "acquired", "is controlled by", "allegedly funded", "sold", "is based in", "never owned")


def statement_texts(spark, d, once: bool = False):
    """One sentence an order line about a firm and another, or a place; with ``once``, equal ids are one row, dealt over all cores."""
    line = table(spark, d, "lineitem")
    if once:
        named = ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        line = line.select(*named).repartition(tasks, *named).distinct()
    a = F.concat(F.lit("Firm"), F.col("l_suppkey").cast("string"), F.lit(" Holdings"))
    b = F.concat(F.lit("Part"), F.col("l_partkey").cast("string"), F.lit(" Ltd"))
    place = F.concat(F.lit("Port"), (F.col("l_partkey") % 40).cast("string"))
    n = F.col("l_linenumber")
    said = F.element_at(F.array(*map(F.lit, _VERBS)), n)
    text = F.concat(a, F.lit(" "), said, F.lit(" "), F.when(n == 5, F.concat(F.lit("to "), b)).when(n == 6, place).otherwise(b), F.lit("."))
    return line.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("doc_id"), text.alias("text"))


_NAMED_SQL = """
named AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS doc_id, l_linenumber AS n, 'Firm' || l_suppkey || ' Holdings' AS a,
    CASE WHEN l_linenumber = 6 THEN 'Port' || (l_partkey % 40) ELSE 'Part' || l_partkey || ' Ltd' END AS b FROM lineitem)"""


@query(
    f"WITH {_NAMED_SQL} SELECT doc_id, a AS surface, 'ORG' AS label, 0.8::DOUBLE AS confidence FROM named "
    "UNION ALL SELECT doc_id, b, CASE n WHEN 6 THEN 'GPE' ELSE 'ORG' END, CASE n WHEN 6 THEN 0.55 ELSE 0.8 END FROM named"
)
def x04_names(spark, d):
    return frames.names_found(statement_texts(spark, d)).select("doc_id", "surface", "label", "confidence")


@query(
    f"WITH {_NAMED_SQL} SELECT doc_id, a AS subject, CASE n WHEN 1 THEN 'owns' WHEN 2 THEN 'acquired' WHEN 3 THEN 'is controlled by' WHEN 4 THEN 'funded' WHEN 5 THEN 'sold' ELSE 'is based in' END AS verb, "
    "b AS object, CASE n WHEN 5 THEN 'to' ELSE '' END AS preposition, n = 3 AS passive, n = 4 AS hedged, false AS negated, count(*) AS times FROM (SELECT * FROM named WHERE n <= 6 UNION ALL SELECT * FROM named WHERE n = 1) GROUP BY ALL"
)
def x05_statements(spark, d):
    """``owns`` is in two patterns, so it is found twice, as it would be in any text."""
    found = frames.statements_found(statement_texts(spark, d))
    return found.groupBy("doc_id", "subject", "verb", "object", "preposition", "passive", "hedged", "negated").agg(F.count("*").alias("times"))


_RELATION = (
    "CASE n WHEN 1 THEN 'OWNS' WHEN 2 THEN 'ACQUIRED' WHEN 3 THEN 'CONTROLS' WHEN 4 THEN 'FUNDED' WHEN 5 THEN 'TRANSFERRED_TO' ELSE 'LOCATED_IN' END",
    "CASE n WHEN 1 THEN 0.98 WHEN 2 THEN 0.95 WHEN 3 THEN 0.88 WHEN 4 THEN round(0.92 * 0.75, 4) WHEN 5 THEN 0.85 ELSE 0.6 END",
)
_VERB_WORDS = {1: "owns", 2: "acquired", 3: "is controlled by", 4: "funded", 5: "sold", 6: "is based in"}
#: "is based in" is reduced to "bas", which no rule has, so the types decide. Words between the starts of the arguments: the length of what stands before the object, by six.
_DISTANCE = "((length(a) + 1 + length(v)) // 6)"
_RELATIONS_SQL = f"""{_NAMED_SQL},
said AS (SELECT *, CASE n WHEN 1 THEN 'owns ' WHEN 2 THEN 'acquired ' WHEN 3 THEN 'is controlled by ' WHEN 4 THEN 'allegedly funded ' WHEN 5 THEN 'sold to ' ELSE 'is based in ' END AS v FROM named WHERE n <= 6),
scored AS (SELECT *, {_RELATION[0]} AS predicate, ({_RELATION[1]})::DOUBLE AS base, {_DISTANCE} AS far FROM said),
evident AS (SELECT *, round(least(1.0, greatest(0.05, base * CASE WHEN far > 6 THEN greatest(0.6, 1.0 - 0.02 * (far - 6)) ELSE 1.0 END * CASE n WHEN 3 THEN 0.95 ELSE 1.0 END)), 4) AS e FROM scored)"""


@query(
    f"WITH {_RELATIONS_SQL} SELECT DISTINCT doc_id, CASE n WHEN 3 THEN b ELSE a END AS subject, predicate, CASE n WHEN 3 THEN a ELSE b END AS object, round(least(1.0, 0.4 * e), 6) AS confidence, n = 4 AS hedged FROM evident"
)
def x13_typed_relations(spark, d):
    """An id names its text, so lines that repeat one are dropped first, and a text's repeated statements where it is read: what is found isn't shuffled."""
    found = frames.statements_found(statement_texts(spark, d, once=True), once=True)
    typed = found.withColumn("id", F.col("doc_id")).withColumn("sentence", F.col("clause"))
    return rules.relations(typed).select(F.col("id").alias("doc_id"), "subject", "predicate", "object", "confidence", "hedged")


_PHRASES = ("is owned by", "travelled to", "was carried", "has been running", "invests in", "carries")
_STEMS = ("own", "travell", "carry", "runn", "invest", "carry")


@query("SELECT l_linenumber AS n, CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(_STEMS)) + " END AS stem, CASE l_linenumber WHEN 2 THEN 'travel' WHEN 4 THEN 'run' " + " ".join(f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(_STEMS) if i not in (1, 3)) + " END AS single, count(*) AS times FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2, 3")
def x14_normal_verbs(spark, d):
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), F.col("l_linenumber"))
    stem = rules.normal_verb(phrase)
    return table(spark, d, "lineitem").where("l_linenumber <= 6").groupBy(F.col("l_linenumber").alias("n"), stem.alias("stem"), rules.single_consonant(stem).alias("single")).agg(F.count("*").alias("times"))


#: (kind, word, subject's type, object's type, sentence, preposition, passive) and what is to come of it.
_CASES = (
    ("verb", "own", "Person", "Organization", "", "", False, "OWNS", False, 0.98), ("verb", "hold", "Person", "Organization", "", "", False, "OWNS", False, 0.98),
    ("verb", "control", "Organization", "Organization", "", "", False, "CONTROLS", False, 0.88), ("verb", "bought", "Organization", "Craft", "", "", False, "ACQUIRED", False, 0.95),
    ("verb", "invest", "Person", "Organization", "", "", False, "SHAREHOLDER_OF", False, 0.9), ("verb", "met", "Person", "Person", "", "", False, "MET_WITH", False, 0.9),
    ("verb", "sail", "Craft", "Location", "", "", False, "TRAVELED_TO", False, 0.92), ("verb", "depart", "Craft", "Location", "", "", False, "ARRIVED_FROM", False, 0.85),
    ("verb", "charter", "Organization", "Craft", "", "", False, "OPERATES", False, 0.92), ("verb", "register", "Craft", "Location", "", "", False, "REGISTERED_IN", False, 0.95),
    ("verb", "investigate", "Organization", "Person", "", "", False, "INVESTIGATED_BY", True, 0.9), ("verb", "acquire", "Organization", "Organization", "", "", True, "ACQUIRED", False, 0.9025),
    ("verb", "own", "Person", "Organization", "X allegedly owns Y.", "", False, "OWNS", False, 0.735), ("verb", "sold", "Organization", "Organization", "", "to", False, "TRANSFERRED_TO", False, 0.85),
    ("verb", "frobnicate", "Person", "Organization", "", "", False, "AFFILIATED_WITH", False, 0.6), ("verb", "travelling", "Person", "Location", "", "", False, "TRAVELED_TO", False, 0.92),
    ("verb", "gründen", "Person", "Organization", "", "", False, "FOUNDED", False, 0.95),
    ("noun", "director", "Person", "Organization", "", "", False, "DIRECTOR_OF", False, 0.9), ("noun", "parent", "Organization", "Organization", "", "", False, "PARENT_OF", True, 0.88),
    ("noun", "wife", "Person", "Person", "reportedly his wife", "", False, "FAMILY_OF", False, 0.675), ("noun", "gadget", "Person", "Organization", "", "", False, "AFFILIATED_WITH", False, 0.55),
    ("preposition", "in", "Organization", "Location", "", "", False, "REGISTERED_IN", False, 0.82), ("preposition", "in", "Person", "Location", "", "", False, "LOCATED_IN", False, 0.8),
    ("preposition", "aboard", "Person", "Craft", "", "", False, "TRAVELED_WITH", False, 0.82), ("preposition", "beyond", "Organization", "Organization", "", "", False, "ASSOCIATED_WITH", False, 0.5),
)


def _decided(spark, d, kind):
    """The cases of one kind, dealt over the orders, and what is decided for each."""
    cases = [c for c in _CASES if c[0] == kind]
    listed = spark.createDataFrame([(i, *c[1:7]) for i, c in enumerate(cases)], "no int, word string, subject_type string, object_type string, sentence string, preposition string, passive boolean")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % len(cases)).cast("int").alias("no")).join(F.broadcast(listed), "no")
    return rules.decide(rows, kind).select("id", "predicate", "reverse", "evidence")


def _decided_sql(kind):
    cases = [c for c in _CASES if c[0] == kind]
    pick = lambda i, quote: " ".join(f"WHEN {n} THEN {quote}{c[i]}{quote}" for n, c in enumerate(cases))
    no = f"CASE o_orderkey % {len(cases)}"
    return f"SELECT o_orderkey AS id, {no} {pick(7, chr(39))} END AS predicate, {no} {pick(8, '')} END AS reverse, ({no} {pick(9, '')} END)::DOUBLE AS evidence FROM orders"


@query(_decided_sql("verb"))
def x15_verb_decisions(spark, d):
    return _decided(spark, d, "verb")


@query(_decided_sql("noun"))
def x16_noun_decisions(spark, d):
    return _decided(spark, d, "noun")


@query(_decided_sql("preposition"))
def x17_preposition_decisions(spark, d):
    return _decided(spark, d, "preposition")


@query("SELECT l_orderkey AS doc, l_linenumber AS n, CASE WHEN l_returnflag = 'A' THEN 'TRAVELED_WITH' WHEN l_returnflag = 'N' THEN 'LOCATED_IN' ELSE 'MET_WITH' END AS predicate, round(greatest(0.4, 1.0 - least(0.3, 0.3 * (l_quantity / 30.0))), 4)::DOUBLE AS evidence, count(*) AS times FROM lineitem GROUP BY ALL")
def x18_together(spark, d):
    left = F.when(F.col("l_returnflag") == "A", "Craft").otherwise("Person")
    right = F.when(F.col("l_returnflag") == "N", "Location").otherwise("Person")
    predicate, evidence = rules.together(left, right, F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), predicate.alias("predicate"), evidence.alias("evidence")).agg(F.count("*").alias("times"))


_TYPE_NAMES = ("Person", "Organization", "Location", "Craft")
_DEFAULTS = {("P", "O"): "AFFILIATED_WITH", ("O", "O"): "ASSOCIATED_WITH"}


def _default(a: str, b: str) -> str:
    if (a[0], b[0]) in _DEFAULTS:
        return _DEFAULTS[a[0], b[0]]
    if b == "Location":
        return "LOCATED_IN"
    return ("TRAVELED_WITH" if a == "Person" else "OPERATES") if b == "Craft" else "ASSOCIATED_WITH"


@query(
    "SELECT o_orderkey AS id, CASE o_orderkey % 16 " + " ".join(f"WHEN {4 * i + j} THEN '{_default(a, b)}'" for i, a in enumerate(_TYPE_NAMES) for j, b in enumerate(_TYPE_NAMES)) + " END AS predicate FROM orders"
)
def x19_type_defaults(spark, d):
    kinds = F.array(*map(F.lit, _TYPE_NAMES))
    at = (F.col("o_orderkey") % 16).cast("int")
    a, b = F.get(kinds, F.floor(at / 4).cast("int")), F.get(kinds, at % 4)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rules.type_default(a, b).alias("predicate"))


_SAID = ("He may own it.", "She did not sign.", "Er bestreitet alles.", "Das ist angeblich wahr.", "The notary signed.", "Kein Vertrag, womöglich.", "Maybe nothing.")


@query("SELECT l_linenumber AS n, l_linenumber IN (1, 4, 6) AS hedged, l_linenumber IN (2, 3, 6) AS negated, count(*) AS times FROM lineitem GROUP BY 1, 2, 3")
def x21_cues(spark, d):
    hedged, negated = rules.cues(F.element_at(F.array(*map(F.lit, _SAID)), F.col("l_linenumber")))
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n"), hedged.alias("hedged"), negated.alias("negated")).agg(F.count("*").alias("times"))


@query()
def x22_rule_tables(spark, d):
    """All rules as rows, one a word."""
    parts = [rules.table(spark, kind).withColumn("kind", F.lit(kind)) for kind in ("verb", "noun", "preposition")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# --- sentences and windows ------------------------------------------------------------------------------------


def prose(spark, d):
    """A text an order: a sentence a line, with abbreviations that end none."""
    line = table(spark, d, "lineitem")
    said = F.concat(F.lit("Dr. Weiss sent lot "), F.col("l_linenumber").cast("string"), F.lit(" of No. "), F.col("l_partkey").cast("string"), F.lit(" e.g. by rail."))
    return line.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", said.alias("s")))), lambda x: x["s"]), " ").alias("text"))


_PROSE_SQL = """
said AS (SELECT l_orderkey AS doc_id, 'Dr. Weiss sent lot ' || l_linenumber || ' of No. ' || l_partkey || ' e.g. by rail.' AS sentence,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS number FROM lineitem),
spans AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM said)"""


@query(f"WITH {_PROSE_SQL} SELECT doc_id, number::INTEGER AS number, start::INTEGER AS start, (start + length(sentence))::INTEGER AS stop, sentence FROM spans")
def t08_sentences(spark, d):
    return frames.sentences_found(prose(spark, d)).withColumnRenamed("end", "stop")


@query(f"WITH {_PROSE_SQL} SELECT doc_id, number::INTEGER AS number, start::INTEGER AS start, (start + length(sentence))::INTEGER AS stop, sentence FROM spans")
def t09_plain_sentences(spark, d):
    return frames.sentences_found(prose(spark, d), plain=True).withColumnRenamed("end", "stop")


@query()
def t10_chunks(spark, d):
    """Windows over whole documents."""
    return frames.chunks_found(table(spark, d, "documents")).select("doc_id", "number", "start", F.col("end").alias("stop"), "tokens", "first", "last", "cut")


@query()
def t01_clean_texts(spark, d):
    return frames.cleaned(table(spark, d, "documents")).select("doc_id", F.length("clean").alias("n"), F.md5("clean").alias("digest"))


@query("SELECT event_id, 'json' AS kind, 'user: ' || user_id || chr(10) || 'list[0]: ' || event_type || chr(10) || 'list[1].value: ' || event_id AS text FROM events")
def t05_json_text(spark, d):
    e = table(spark, d, "events")
    made = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "none": null, "list": ["'), F.col("event_type"), F.lit('", {"value": '), F.col("event_id").cast("string"), F.lit("}]}"))
    rows = e.select("event_id", made.alias("body"), F.lit("application/json").alias("type"), F.lit("").alias("url"))
    return frames.extracted(rows, "event_id", "body", "type", "url").select("event_id", "kind", "text")


@query("SELECT o_orderkey, 'csv' AS kind, 'key=' || o_orderkey || '; status=' || o_orderstatus || chr(10) || 'key=' || o_custkey AS text FROM orders")
def t06_csv_text(spark, d):
    made = F.concat(F.lit("key,status\n"), F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_orderstatus"), F.lit("\n"), F.col("o_custkey").cast("string"), F.lit(",\n"))
    rows = table(spark, d, "orders").select("o_orderkey", made.alias("body"), F.lit("text/csv").alias("type"), F.lit("").alias("url"))
    return frames.extracted(rows, "o_orderkey", "body", "type", "url").select("o_orderkey", "kind", "text")


_KINDS = (("application/pdf", "/x", "pdf"), ("", "/feed.rss", "xml"), ("text/plain; charset=x", "/a.html", "text"), ("image/png", "/a", "image"), ("", "/a.json?x=1", "json"), ("application/zip", "/a.csv", "archive"), ("", "/a.tsv", "csv"))


@query("SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, _, k) in enumerate(_KINDS)) + " END AS kind, CASE WHEN p_partkey % 7 IN (0, 3, 5) THEN 'unsupported-kind:' || CASE p_partkey % 7 WHEN 0 THEN 'pdf' WHEN 3 THEN 'image' ELSE 'archive' END WHEN p_partkey % 7 = 4 THEN 'invalid-json' ELSE '' END AS warning FROM part")
def t07_dispatch(spark, d):
    at = (F.col("p_partkey") % 7).cast("int")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("body"), F.get(F.array(*(F.lit(t) for t, _, _ in _KINDS)), at).alias("type"), F.get(F.array(*(F.lit(u) for _, u, _ in _KINDS)), at).alias("url"))
    return frames.extracted(rows, "p_partkey", "body", "type", "url").select("p_partkey", "kind", "warning")


# --- what entities are ----------------------------------------------------------------------------------------

_PLACES = ("bvi", "Delaware", "Germany", "Cayman Islands", "hk", "somewhere in Panama City", "France")
_CLASSES = ("secrecy", "opacity", "", "secrecy", "opacity", "secrecy", "")


def companies(spark, d):
    """Customers as companies with properties that follow from the key."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("Firm "), key.cast("string"), F.when(key % 5 == 0, " Holdings").when(key % 11 == 0, " Foundation").otherwise(" Works"))
    props = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("jurisdiction"), F.get(F.array(*map(F.lit, _PLACES)), (key % 7).cast("int"))),
        F.when(key % 3 == 0, F.struct(F.lit("status"), F.lit("Struck Off"))), F.when(key % 2 == 0, F.struct(F.lit("reg_number"), key.cast("string"))),
        F.when(key % 13 == 0, F.struct(F.lit("nominee"), F.lit("yes"))), F.when(key % 4 == 0, F.struct(F.lit("shared_address_count"), (key % 8).cast("string"))),
        F.when(key % 6 == 0, F.struct(F.lit("website"), F.lit("x"))),
    )))
    return table(spark, d, "customer").select(key.alias("key"), name.alias("name"), F.lit("Organization").alias("entity_type"), props.alias("properties"))


_CLASS_SQL = "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES)) + " END"
_RISK_SQL = f"""risk AS (SELECT *, CASE WHEN foundation THEN 0.0 ELSE greatest(0.0, least(1.0, round(
    CASE class WHEN 'secrecy' THEN 0.35 WHEN 'opacity' THEN 0.12 ELSE 0 END + CASE WHEN key % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN key % 2 = 0 THEN 0 ELSE 0.1 END
    + CASE WHEN key % 5 = 0 THEN 0.1 ELSE 0 END + CASE WHEN key % 13 = 0 THEN 0.25 ELSE 0 END
    + CASE WHEN key % 4 = 0 AND key % 8 >= 5 THEN 0.2 WHEN key % 4 = 0 AND key % 8 >= 2 THEN 0.1 ELSE 0 END - CASE WHEN key % 6 = 0 THEN 0.1 ELSE 0 END, 4))) END::DOUBLE AS score
    FROM (SELECT c_custkey AS key, {_CLASS_SQL} AS class, c_custkey % 11 = 0 AND c_custkey % 5 <> 0 AS foundation FROM customer))"""


@query(f"SELECT c_custkey AS key, {_CLASS_SQL} AS class FROM customer")
def f23_jurisdiction_class(spark, d):
    return companies(spark, d).select("key", domain.jurisdiction_class(F.col("name"), F.col("properties")).alias("class"))


@query(f"WITH {_RISK_SQL} SELECT key, score FROM risk")
def f27_shell_risk(spark, d):
    return companies(spark, d).select("key", domain.shell_risk(F.col("name"), F.col("entity_type"), F.col("properties"))["score"].alias("score"))


@query(f"WITH {_RISK_SQL} SELECT key, score >= 0.5 AS shell FROM risk")
def f28_shell_companies(spark, d):
    return companies(spark, d).select("key", domain.is_shell(F.col("name"), F.col("entity_type"), F.col("properties")).alias("shell"))


@query(
    f"WITH {_RISK_SQL} SELECT key, 'Entity,Organization,' || CASE WHEN foundation THEN 'Foundation' ELSE 'Company' END || CASE WHEN score >= 0.5 THEN ',ShellCompany' ELSE '' END || CASE WHEN class = 'secrecy' THEN ',Offshore' ELSE '' END AS labels, "
    "CASE WHEN foundation THEN 'Company' ELSE 'Foundation' END AS stale FROM risk"
)
def f29_labels(spark, d):
    current = domain.labels(F.col("name"), F.col("entity_type"), F.col("properties"))
    return companies(spark, d).select("key", F.array_join(current, ",").alias("labels"), F.array_join(domain.stale_labels(current), ",").alias("stale"))


@query(
    f"WITH {_RISK_SQL} SELECT key, CASE WHEN score > 0 THEN (score >= 0.5)::VARCHAR END AS is_shell, nullif(class, '') AS jurisdiction_class, 'Alias ' || key AS alias FROM risk"
)
def f30_extras(spark, d):
    alias = F.concat(F.lit("Alias "), F.col("key").cast("string"))
    made = companies(spark, d).withColumn("extras", domain.extras(F.col("name"), F.col("entity_type"), F.col("properties"), F.array(F.col("name"), alias)))
    return made.select("key", *(F.try_element_at("extras", F.lit(k)).alias(k) for k in ("is_shell", "jurisdiction_class", "alias")))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Aircraft' WHEN 1 THEN 'Vessel' WHEN 2 THEN 'Vehicle' WHEN 3 THEN 'Vessel' WHEN 4 THEN 'Aircraft' ELSE 'Craft' END AS label FROM part"
)
def f24_craft_label(spark, d):
    at = F.col("p_partkey") % 6
    props = F.when(at == 0, F.create_map(F.lit("registration"), F.lit("x"))).when(at == 1, F.create_map(F.lit("mmsi"), F.lit("1"))).when(at == 2, F.create_map(F.lit("vin"), F.lit("1"))).otherwise(F.create_map(F.lit("a"), F.lit("")))
    name = F.when(at == 3, "Motor Yacht Ida").when(at == 4, F.concat(F.lit("9H-V"), (F.col("p_partkey") % 10).cast("string"))).otherwise("Ida")
    return table(spark, d, "part").select("p_partkey", domain.craft_label(name, props).alias("label"))


@query(
    "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'N' || (s_suppkey % 900 + 100) || 'AB' WHEN 1 THEN 'N' || (s_suppkey % 900 + 100) WHEN 2 THEN '9H-ABX' ELSE '' END AS tail FROM supplier"
)
def f26_normal_tail(spark, d):
    from graphloom.functions.craft import normalize_tail

    at, number = F.col("s_suppkey") % 4, (F.col("s_suppkey") % 900 + 100).cast("string")
    raw = F.when(at == 0, F.concat(F.lit(" "), number, F.lit("ab "))).when(at == 1, F.concat(F.lit("n-"), number)).when(at == 2, "9h abx").otherwise(" ")
    return table(spark, d, "supplier").select("s_suppkey", normalize_tail(F.when(at == 2, "9h-abx").otherwise(raw)).alias("tail"))


@query(
    "SELECT s_suppkey, s_suppkey || ' main street, suite ' || (s_suppkey % 9) || ', road town' AS address, s_suppkey || 'mainstreetsuite' || (s_suppkey % 9) || 'roadtown' AS key FROM supplier"
)
def f22_normal_address(spark, d):
    from graphloom.functions.craft import address_key, normalize_address

    raw = F.concat(F.col("s_suppkey").cast("string"), F.lit(" Main St.,\nSte "), (F.col("s_suppkey") % 9).cast("string"), F.lit(", ROAD TOWN, British Virgin Islands, UNITED KINGDOM"))
    return table(spark, d, "supplier").select("s_suppkey", normalize_address(raw).alias("address"), address_key(raw).alias("key"))


@query("SELECT doc, min(start)::INTEGER AS start, max(stop)::INTEGER AS stop FROM (SELECT l_orderkey AS doc, l_linenumber * 100 AS start, l_linenumber * 100 + 40 AS stop FROM lineitem) GROUP BY doc, start")
def x24_fold_spans(spark, d):
    """Spans of overlapping windows, the same mention in both: one stays, the longer."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 100).alias("start"))
    spans = line.select("doc", F.inline(F.array(*(F.struct((F.col("start") + a).alias("start"), (F.col("start") + b).alias("end"), F.lit(c).alias("confidence")) for a, b, c in ((0, 40, 0.5), (5, 40, 0.9))))))
    return suppress_overlaps(spans.distinct()).select("doc", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("stop"))
