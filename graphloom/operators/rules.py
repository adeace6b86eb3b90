"""Rule tables as data, and the joins that apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Natures of control, the first that occurs in a record decides; predicate and evidence.
CONTROL = (
    ("ownership-of-shares-75-to-100", "OWNS", 1.0), ("ownership-of-shares-50-to-75", "SHAREHOLDER_OF", 0.9),
    ("ownership-of-shares-25-to-50", "SHAREHOLDER_OF", 0.8), ("ownership-of-shares", "SHAREHOLDER_OF", 0.7),
    ("right-to-appoint-and-remove-directors", "CONTROLS", 1.0), ("voting-rights-75-to-100", "CONTROLS", 0.95),
    ("voting-rights-50-to-75", "CONTROLS", 0.85), ("voting-rights-25-to-50", "CONTROLS", 0.75), ("voting-rights", "CONTROLS", 0.7),
    ("right-to-surplus-assets", "OWNS", 0.9), ("right-to-capital", "OWNS", 0.9), ("ownership-of-capital", "OWNS", 0.9),
    ("significant-influence-or-control", "CONTROLS", 0.7), ("right-to-appoint", "CONTROLS", 0.85), ("right-to-remove", "CONTROLS", 0.85),
)
#: Roles of officers and the predicate each stands for.
ROLES = {
    "director": "DIRECTOR_OF", "corporate-director": "DIRECTOR_OF", "secretary": "OFFICER_OF", "corporate-secretary": "OFFICER_OF",
    "llp-member": "MEMBER_OF", "llp-designated-member": "DIRECTOR_OF", "member": "MEMBER_OF", "manager": "OFFICER_OF",
    "judicial-factor": "CONTROLS", "receiver": "CONTROLS", "receiver-manager": "CONTROLS", "cic-manager": "OFFICER_OF", "other": "ASSOCIATED_WITH",
}
#: Descriptions of links, in the order in which they are looked for.
LINK_TYPES = (
    ("officer of", "DIRECTOR_OF"), ("director of", "DIRECTOR_OF"), ("president of", "DIRECTOR_OF"), ("vice president of", "DIRECTOR_OF"), ("treasurer of", "DIRECTOR_OF"),
    ("secretary of", "DIRECTOR_OF"), ("board member of", "DIRECTOR_OF"), ("board of directors of", "DIRECTOR_OF"), ("intermediary of", "INTERMEDIARY_FOR"),
    ("shareholder of", "SHAREHOLDER_OF"), ("owner of", "OWNS"), ("beneficial owner of", "OWNS"), ("beneficiary of", "OWNED_BY"), ("registered address", "LOCATED_IN"),
    ("address of", "LOCATED_IN"), ("registered address of", "LOCATED_IN"), ("jurisdiction of", "REGISTERED_IN"), ("incorporated in", "REGISTERED_IN"), ("registered in", "REGISTERED_IN"),
    ("parent of", "PARENT_OF"), ("subsidiary of", "SUBSIDIARY_OF"), ("related to", "ASSOCIATED_WITH"), ("connected to", "ASSOCIATED_WITH"), ("same name and address as", "ASSOCIATED_WITH"),
    ("nominee shareholder of", "SHAREHOLDER_OF"), ("trustee of", "CONTROLS"), ("settlor of", "FOUNDED"), ("protector of", "CONTROLS"), ("power of attorney of", "CONTROLS"),
    ("authorized representative of", "OFFICER_OF"), ("senior managing officer of", "OFFICER_OF"), ("alternative director of", "DIRECTOR_OF"),
    ("director / board member of", "DIRECTOR_OF"), ("member of", "MEMBER_OF"), ("partner of", "ASSOCIATED_WITH"), ("client of", "ASSOCIATED_WITH"),
    ("bank account of", "ASSOCIATED_WITH"), ("record id", "ASSOCIATED_WITH"),
)
#: Words that decide where no description is found, in this order.
LINK_WORDS = (
    ("director", "DIRECTOR_OF"), ("board", "DIRECTOR_OF"), ("intermediar", "INTERMEDIARY_FOR"), ("shareholder", "SHAREHOLDER_OF"), ("address", "LOCATED_IN"),
    ("jurisdiction", "REGISTERED_IN"), ("incorporated", "REGISTERED_IN"),
)


#: Verb stems, predicate, evidence, priority, type of the subject and of the object ("" is any).
VERBS = (
    ("own", "OWNS", 1.0, 5, "", ""), ("hold", "OWNS", 0.9, 4, "", "Craft"), ("control", "CONTROLS", 1.0, 6, "", ""), ("acquire", "ACQUIRED", 0.95, 5, "", "Organization"),
    ("found", "FOUNDED", 0.95, 5, "", "Organization"), ("appoint", "APPOINTED_BY", 0.9, 5, "", "Person"), ("employ", "EMPLOYS", 0.9, 4, "Organization", "Person"),
    ("fund", "FUNDED", 0.9, 5, "", ""), ("pay", "PAID_TO", 0.85, 4, "", ""), ("contract", "CONTRACTED_WITH", 0.8, 4, "", ""), ("operate", "OPERATES", 0.9, 5, "", "Craft"),
    ("operate", "OPERATES_IN", 0.8, 4, "", "Location"), ("meet", "MET_WITH", 0.7, 3, "Person", "Person"), ("accuse", "ACCUSED_OF", 0.8, 4, "", ""),
    ("sanction", "SANCTIONED_BY", 0.95, 6, "", ""), ("link", "ASSOCIATED_WITH", 0.5, 1, "", ""),
)


def first_match(text: Column, table: tuple, default: str) -> Column:
    """The predicate of the first entry whose words occur in the text."""
    out = F.lit(default)
    for words, predicate, *_ in reversed(table):
        out = F.when(F.contains(F.lower(text), F.lit(words)), predicate).otherwise(out)
    return out


def link_predicate(label: Column) -> Column:
    """The predicate of a link's description: as a whole, else by the first description or word in it."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), "\\s+", " ")))
    whole = F.create_map(*(F.lit(x) for pair in LINK_TYPES for x in pair))
    return F.coalesce(F.try_element_at(whole, plain), first_match(plain, LINK_TYPES + LINK_WORDS, "ASSOCIATED_WITH"))


def first_match_sql(text: str, table: tuple, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{w}') THEN '{p}'" for w, p, *_ in table) + f" ELSE '{default}' END"


def verb_rules(spark: SparkSession, extra: tuple = ()) -> DataFrame:
    """The rule table with its order, and a plug-in's rules behind it."""
    rows = [(*r, i) for i, r in enumerate((*VERBS, *extra))]
    return spark.createDataFrame(rows, "verb string, predicate string, evidence double, priority int, subject_kind string, object_kind string, rule_order int")


def apply_verbs(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """Triples (id, verb, subject_type, object_type) with the predicate of the best rule that fits the types.

    The rule table is of a few dozen rows, so it is broadcast; without a rule a triple is an association.
    """
    fits = (F.col("subject_kind") == "") | (F.col("subject_kind") == F.col("subject_type"))
    fits = fits & ((F.col("object_kind") == "") | (F.col("object_kind") == F.col("object_type")))
    matched = triples.join(F.broadcast(rules), "verb", "left").where(F.col("predicate").isNull() | fits)
    best = W.partitionBy("id").orderBy(F.desc("priority"), "rule_order")
    chosen = matched.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    found = triples.select("id", "verb").join(chosen.select("id", "predicate", "evidence"), "id", "left")
    return found.select("id", F.coalesce("predicate", F.lit("ASSOCIATED_WITH")).alias("predicate"), F.coalesce("evidence", F.lit(0.6)).alias("evidence"))


def suppress_overlaps(spans: DataFrame) -> DataFrame:
    """Of spans (doc, start, end, confidence) of one overlapping cluster the longest stays, then the surest."""
    before = W.partitionBy("doc").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    opened = spans.withColumn("_open", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    cluster = opened.withColumn("_cluster", F.sum("_open").over(W.partitionBy("doc").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    order = F.struct(F.col("end") - F.col("start"), "confidence", -F.col("start"))
    best = cluster.groupBy("doc", "_cluster").agg(F.max_by(F.struct("start", "end", "confidence"), order).alias("s"))
    return best.select("doc", "s.start", "s.end", "s.confidence")
