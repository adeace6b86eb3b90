"""Queries of claims that a model proposes, made here from each document's own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.extraction import claims
from graphloom.plans.registry import query
from graphloom.sources.relational import table

#: Predicates that the made claims may use, and how texts call them.
PREDICATES = ["OWNS", "CONTROLS", "DIRECTOR_OF", "SHAREHOLDER_OF"]
ALIASES = {"owns": "OWNS", "owner of": "OWNS", "controls": "CONTROLS", "director of": "DIRECTOR_OF"}


def _claims(spark, d):
    """One claim a document: two of its words and the quote around them, every seventh quote altered."""
    t = table(spark, d, "documents").withColumn("w", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    word = lambda i: F.get("w", F.lit(i))
    kinds = F.array(F.lit("Person"), F.lit("Organization"))
    return t.select(
        "doc_id", "text", F.concat_ws(" ", word(0), word(1)).alias("subject"), F.get(kinds, (F.col("doc_id") % 2).cast("int")).alias("subject_type"),
        F.get(F.array(*(F.lit(p) for p in [*PREDICATES, "KNOWS"])), (F.col("doc_id") % 5).cast("int")).alias("predicate"), word(5).alias("object"),
        F.when(F.col("doc_id") % 11 != 0, "Organization").alias("object_type"), F.concat(F.array_join(F.slice("w", 2, 6), " "), F.when(F.col("doc_id") % 7 == 0, " zq").otherwise("")).alias("evidence"),
        (F.col("doc_id") % 13 == 0).alias("negated"), F.lit(False).alias("hedged"), (F.col("doc_id") % 120 / 100).alias("confidence"), F.lit(0.9).alias("source_weight"),
        F.array(F.struct(F.concat_ws(" ", word(2), word(1)).alias("name"), F.lit("Person").alias("entity_type"))).alias("others"),
    )


@query()
def x27_validated_claims(spark, d):
    checked = claims.validate(_claims(spark, d), PREDICATES)
    return checked.select("doc_id", "predicate", "reason", F.col("confidence_checked").alias("confidence"))


@query()
def x27_reject_reasons(spark, d):
    return claims.reasons(claims.validate(_claims(spark, d), PREDICATES))


@query()
def x28_names_in_quotes(spark, d):
    c = _claims(spark, d)
    return c.select("doc_id", claims.named_in(F.col("subject"), F.col("subject_type"), claims.folded(F.col("evidence")), F.col("others")).alias("found"))


@query()
def x26_grounded(spark, d):
    """Documents as chunks, each with one triplet under a documented or an unknown predicate."""
    said = F.get(F.array(*(F.lit(p) for p in ["Owner_of", "controls", "likes", "Director-Of"])), (F.col("doc_id") % 4).cast("int"))
    made = _claims(spark, d).select(F.col("doc_id").alias("chunk_id"), F.lit(0).alias("position"), F.col("text").alias("chunk"), "subject", said.alias("predicate"), "object")
    return claims.grounded(made, ALIASES).select("chunk_id", "subject", "predicate", "object")
