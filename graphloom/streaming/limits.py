"""Limits on requests, computed for whole tables of them: waiting times of a token bucket, planned limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A host's requests are first taken by day, so that no task holds all those of a busy host.
BLOCK_MS = 86_400_000


def admitted(requests: DataFrame, interval_ms: int, burst: int) -> DataFrame:
    """Add ``wait_ms``: how long each request waits for its tokens.

    ``requests`` is (host, id, at, cost): milliseconds and whole tokens. A host's bucket starts full with
    ``burst`` tokens and gets one each ``interval_ms``; a request that asks for more takes a full bucket.
    Requests are served in order of time and id. When all taken so far are paid back is a running sum and a
    running maximum, first within a block of a host, then over its blocks. Requests without time or cost take no part.
    """
    r = requests.where("at IS NOT NULL AND cost IS NOT NULL").withColumn("cost", F.least(F.col("cost").cast("long"), F.lit(burst).cast("long")))
    r = r.withColumn("_block", F.floor(F.col("at") / BLOCK_MS))
    within = W.partitionBy("host", "_block").orderBy("at", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    r = r.withColumn("_sum", F.sum("cost").over(within)).withColumn("_free", F.col("at") - (F.col("_sum") - F.col("cost")) * interval_ms)
    r = r.withColumn("_late", F.max("_free").over(within))
    before = W.partitionBy("host").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = r.groupBy("host", "_block").agg(F.sum("cost").alias("_all"), F.max("_free").alias("_most"))
    blocks = blocks.withColumn("_gone", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    blocks = blocks.withColumn("_since", F.max(F.col("_most") - F.col("_gone") * interval_ms).over(before)).select(F.col("host").alias("_host"), F.col("_block").alias("_of"), "_gone", "_since")
    joined = r.join(blocks, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_block") == F.col("_of")))
    due = (F.col("_gone") + F.col("_sum")) * interval_ms + F.greatest("_since", F.col("_late") - F.col("_gone") * interval_ms)
    return joined.select(*requests.columns, F.greatest(F.lit(0).cast("long"), due - burst * interval_ms - F.col("at")).alias("wait_ms"))


def planned(configured: Column, learned: Column, safety: float) -> Column:
    """The lower of a configured and a learned limit, with a margin: at least 1, unless it is 0."""
    lower = F.least(configured, learned)
    return F.when(lower == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(lower * safety))).cast("long")
