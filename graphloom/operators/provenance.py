"""Where claims come from: independence of sources, freshness, conflicts, who reported first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def source_status(docs: Column, named_sources: Column, unnamed: Column) -> Column:
    """none / single / unknown / shared / independent, from distinct documents and sources."""
    return (
        F.when(docs == 0, "none").when(docs == 1, "single").when(named_sources > 1, "independent").when(unnamed > 0, "unknown").otherwise("shared")
    )


def backing(observations: DataFrame) -> DataFrame:
    """Per edge: distinct documents and named sources, oldest and newest date."""
    source = F.lower(F.trim("source"))
    return observations.groupBy("subject", "predicate", "object").agg(
        F.countDistinct("doc_id").alias("docs"), F.countDistinct(F.nullif(source, F.lit(""))).alias("outlets"),
        F.sum((source.isNull() | (source == "")).cast("int")).alias("unnamed"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
    )


def freshness(newest: Column, reference: Column, months: int) -> Column:
    return F.when(newest.isNull(), "undated").when(newest < F.add_months(reference, -months), "stale").otherwise("fresh")


def conflicts(observations: DataFrame) -> DataFrame:
    """Unordered pairs with several predicates: conflict where date windows overlap, sequence where none do.

    Windows are swept in the order of their first day, so a pair costs one sort of its predicates.
    """
    spans = observations.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "predicate").agg(
        F.min("seen").alias("first"), F.max("seen").alias("last"), F.countDistinct("doc_id").alias("docs")
    )
    order = W.partitionBy("a", "b").orderBy("first", "predicate").rowsBetween(W.unboundedPreceding, -1)
    swept = spans.withColumn("overlaps", F.col("first") <= F.max("last").over(order))
    pairs = swept.groupBy("a", "b").agg(
        F.count("*").alias("predicates"), F.bool_or("overlaps").alias("overlaps"), F.bool_or(F.col("first").isNull()).alias("undated"), F.sum("docs").alias("docs")
    )
    status = F.when(F.col("overlaps"), "conflict").when(F.col("undated"), "undated").otherwise("sequence")
    return pairs.where("predicates > 1").select("a", "b", "predicates", "docs", status.alias("status"))


def firsts(observations: DataFrame) -> DataFrame:
    """Per edge and source: first date and its lag in days behind the edge's first report."""
    first = observations.where("seen IS NOT NULL").groupBy("subject", "predicate", "object", "source").agg(F.min("seen").alias("seen"))
    edge = W.partitionBy("subject", "predicate", "object")
    return first.withColumn("lag", F.datediff("seen", F.min("seen").over(edge))).withColumn("outlets", F.count("*").over(edge))


def primacy(observations: DataFrame) -> DataFrame:
    """Per source, over edges that several report: how often first, how often later, and the mean lag."""
    shared = firsts(observations).where("outlets > 1")
    return shared.groupBy("source").agg(
        F.sum((F.col("lag") == 0).cast("long")).alias("firsts"), F.sum((F.col("lag") > 0).cast("long")).alias("followups"),
        F.round(F.avg(F.when(F.col("lag") > 0, F.col("lag"))), 2).alias("mean_lag"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status): added, removed or unchanged between two tables of keys."""
    a = old.select(key).distinct().withColumn("_in_old", F.lit(True))
    b = new.select(key).distinct().withColumn("_in_new", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").otherwise("unchanged").alias("status"))


def band_pairs(mentions: DataFrame, width: int, doc: str = "doc_id", at: str = "at", key: str = "key") -> DataFrame:
    """(a, b, n): keys of one document that are within ``width`` of each other, with the times they are.

    Offsets are cut into buckets of that width; a mention is joined with those of its own and of the
    next bucket, so a long document spreads over many join keys.
    """
    m = mentions.select(F.col(doc).alias("doc"), F.col(at).alias("at"), F.col(key).alias("key")).withColumn("bucket", F.floor(F.col("at") / width))
    left = m.select("doc", F.col("at").alias("at1"), F.col("key").alias("k1"), "bucket")
    right = m.select("doc", F.col("at").alias("at2"), F.col("key").alias("k2"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"))
    near = left.join(right, ["doc", "bucket"]).where((F.col("k1") < F.col("k2")) & (F.abs(F.col("at1") - F.col("at2")) <= width))
    return near.groupBy(F.col("k1").alias("a"), F.col("k2").alias("b")).agg(F.count("*").alias("n"))
