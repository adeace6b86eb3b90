"""Merging new observations into stored tables, with the arithmetic of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.confidence import noisy_or, noisy_or_all


def first_of(values: Column, most: int) -> Column:
    """The first ``most`` distinct values of an array."""
    return F.slice(F.array_distinct(values), 1, most)


def last_of(values: Column, most: int) -> Column:
    """The last ``most`` distinct values of an array."""
    kept = F.array_distinct(values)
    return F.slice(kept, F.greatest(F.size(kept) - most + 1, F.lit(1)), most)


def upsert_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """By doc_id: the longest title wins, the first date stays, the last ingest is renewed, times add up.

    Both have doc_id, title, published, ingested, times.
    """
    return stored.unionByName(new).groupBy("doc_id").agg(
        F.max_by("title", F.struct(F.length("title"), "title")).alias("title"), F.min("published").alias("published"),
        F.max("ingested").alias("ingested"), F.sum("times").alias("times"),
    )


def upsert_mentions(mentions: DataFrame) -> DataFrame:
    """A mention belongs to its document: counted anew, best confidence, first offset, eight surface forms."""
    return mentions.groupBy("doc_id", "key").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("confidence").alias("confidence"), F.slice(F.array_sort(F.collect_set("surface")), 1, 8).alias("surfaces")
    )


def merge_observations(observations: DataFrame) -> DataFrame:
    """Edges from observations: in a document the strongest counts, documents corroborate, loops go."""
    once = observations.where("subject <> object").groupBy("subject", "predicate", "object", "doc_id").agg(F.max("confidence").alias("c"))
    return once.groupBy("subject", "predicate", "object").agg(
        noisy_or_all(F.col("c")).alias("confidence"), F.count("*").alias("observations"), F.array_sort(F.collect_set("doc_id")).alias("docs")
    )


def upsert_edges(stored: DataFrame, new: DataFrame, most_docs: int = 20) -> DataFrame:
    """Merge edges: confidence and observations grow only by documents that the stored edge doesn't know.

    Both have subject, predicate, object, confidence, observations, weight, docs (array). Running the
    same batch twice changes nothing.
    """
    key = ["subject", "predicate", "object"]
    a = stored.select(*key, *(F.col(c).alias(f"{c}_a") for c in ("confidence", "observations", "weight", "docs")))
    b = new.select(*key, *(F.col(c).alias(f"{c}_b") for c in ("confidence", "observations", "weight", "docs")))
    none = F.array().cast("array<string>")
    fresh = F.size(F.array_except(F.coalesce("docs_b", none), F.coalesce("docs_a", none))) > 0
    joined = a.join(b, key, "full_outer")
    return joined.select(
        *key,
        F.when(F.col("confidence_a").isNull(), F.col("confidence_b")).when(fresh, noisy_or(F.col("confidence_a"), F.col("confidence_b"))).otherwise(F.col("confidence_a")).alias("confidence"),
        (F.coalesce("observations_a", F.lit(0)) + F.when(fresh, F.coalesce("observations_b", F.lit(0))).otherwise(0)).alias("observations"),
        F.greatest("weight_a", "weight_b").alias("weight"),
        last_of(F.concat(F.coalesce("docs_a", none), F.coalesce("docs_b", none)), most_docs).alias("docs"),
    )


def merge_entities(entities: DataFrame) -> DataFrame:
    """Fold rows of one key: united aliases and documents, best confidence, longest name."""
    return entities.groupBy("key").agg(
        F.max_by("name", F.struct(F.length("name"), "name")).alias("name"), F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))), 1, 64).alias("aliases"),
    )


def admit(newcomers: DataFrame, stored: DataFrame, budget: int) -> DataFrame:
    """Newcomers that a node budget admits, the surest and most mentioned first; stored ones stay anyway."""
    fresh = newcomers.join(stored.select("key"), "key", "left_anti")
    return fresh.orderBy(F.desc(F.round("confidence", 6)), F.desc("mentions"), "key").limit(budget)


def repoint(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with the losers of ``mapping`` (key, winner) replaced; loops that arise are dropped."""
    out = edges
    for side in ("subject", "object"):
        out = out.join(mapping.select(F.col("key").alias(side), F.col("winner").alias(f"{side}_w")), side, "left")
    moved = out.select(F.coalesce("subject_w", "subject").alias("subject"), "predicate", F.coalesce("object_w", "object").alias("object"), "confidence", "observations")
    return moved.where("subject <> object").groupBy("subject", "predicate", "object").agg(
        noisy_or_all(F.col("confidence")).alias("confidence"), F.sum("observations").alias("observations")
    )
