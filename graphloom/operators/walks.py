"""Walks along weighted edges: control with decay, cheapest paths, merges that keep the strongest, pruning in two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import distances
from graphloom.session import materialize, release

#: The share of strength left a hop (in tenths), the least strength and the longest chain.
DECAY, LEAST, HOPS = 7, 0.01, 4
#: Strengths of walks and of edges are whole numbers of these parts, so that rounding is the same everywhere.
WALKED, EDGE = 10**4, 10**6


def decayed(strength: str, edge: str, depth: int) -> str:
    """SQL of a walk's strength after one more edge at ``depth``, rounded half up; DIV is the integer division."""
    up, down = DECAY**depth, EDGE * 10**depth
    return f"((2 * {strength} * {edge} * {up} + {down}) DIV {2 * down})"


def control_walk(edges: DataFrame, starts: DataFrame, hops: int = HOPS, least: float = LEAST) -> DataFrame:
    """(person, target, strength, hops, path): the strongest walk from each start to each target.

    ``edges`` is (src, dst, strength), ``starts`` is (person). A walk's strength is the product of its edges'
    strengths and of 0.7 to the power of the depth of each edge, to four digits at every hop, and has to stay above ``least``. A walk goes on only where
    it beats what is known of its target; of equals the shorter and then the smaller path stays. Null ends take no part.
    """
    spark = edges.sparkSession
    links, _ = materialize(edges.where("src <> dst").groupBy("src", "dst").agg(F.max(F.round(F.col("strength") * EDGE).cast("long")).alias("edge")), "walk-links")
    front = starts.where("person IS NOT NULL").select("person").distinct().select("person", F.col("person").alias("target"), F.lit(WALKED).cast("long").alias("got"), F.array("person").alias("path"))
    reach, path = None, None
    for depth in range(hops):
        step = front.join(links, F.col("target") == F.col("src")).where("dst <> person")
        step = step.select("person", F.col("dst").alias("target"), F.expr(decayed("got", "edge", depth)).cast("long").alias("got"), F.concat("path", F.array("dst")).alias("path"))
        best = step.where(F.col("got") > least * WALKED).groupBy("person", "target").agg(F.min(F.struct((-F.col("got")).alias("less"), "path")).alias("best"))
        best = best.select("person", "target", (-F.col("best.less")).alias("got"), "best.path", F.lit(depth + 1).alias("hops"))
        if reach is not None:
            known = reach.select("person", "target", F.col("got").alias("known"))
            best = best.join(known, ["person", "target"], "left").where("known IS NULL OR got > known").drop("known")
        front, front_path = materialize(best, "walk-front")
        if reach is None:
            reach, path = front, None
            continue
        if front.isEmpty():
            break
        grown, new_path = materialize(reach.join(front, ["person", "target"], "left_anti").select(*front.columns).unionAll(front), "walk-reach")
        if path:
            release(spark, path)
        reach, path = grown, new_path
    return reach.select("person", "target", (F.col("got") / WALKED).alias("strength"), "hops", "path")


def cheapest_paths(edges: DataFrame, source: str, target: str, hops: int = HOPS, best: int = 3) -> DataFrame:
    """(cost, path): the ``best`` cheapest undirected simple paths, an edge costing 1.05 less its weight.

    ``edges`` is (src, dst, w) with weights in 0..1; of parallel edges the heaviest counts. A path goes on only to nodes
    from which the target is still within its hops. Of equal costs the smaller path comes first.
    """
    spark = edges.sparkSession
    ends = F.inline(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    near = edges.where("src <> dst").select(ends).groupBy("src", "dst").agg(F.max("w").alias("w"))
    near, near_path = materialize(near.select("src", "dst", F.round((1.05 - F.col("w")) * EDGE).cast("long").alias("price")), "price-links")
    left = distances(edges, spark.createDataFrame([(target,)], "node string"), hops - 1).select(F.col("node").alias("dst"), F.col("hops").alias("left"))
    front = spark.createDataFrame([(source, [source], 0)], "node string, path array<string>, cost long")
    found = spark.createDataFrame([], "cost long, path array<string>")
    for step in range(1, hops + 1):
        on = front.join(near, F.col("node") == F.col("src")).join(left.where(F.col("left") <= hops - step), "dst").where(~F.array_contains("path", F.col("dst")))
        front, _ = materialize(on.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("price")).alias("cost")), "price-front")
        found = found.unionAll(front.where(F.col("node") == target).select("cost", "path"))
        front = front.where(F.col("node") != target)
    return found.orderBy("cost", "path").limit(best).select((F.col("cost") / EDGE).alias("cost"), "path")


def merge_by_max(nodes: DataFrame, group: list[str], identifiers: list[str], counts: list[str]) -> DataFrame:
    """One row a group: its winner, members, the largest confidence, the first identifier by rank and the sums of evidence.

    Rank is by falling confidence, then by ``key``. Unlike a merge of independent observations the confidence doesn't grow with the members.
    """
    rank = [(-F.coalesce("confidence", F.lit(0.0))).alias("less"), F.col("key").alias("by")]
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(*rank, F.col(c).alias("value")))).getField("value").alias(c) for c in identifiers]
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counts]
    return nodes.groupBy(*group).agg(F.min(F.struct(*rank)).getField("by").alias("winner"), F.count("*").alias("members"), F.max("confidence").alias("confidence"), *firsts, *sums)


#: Largest degree, weight below which an edge is weak, least age in days; first pass, then escalated.
ORPHAN = (1, 0.3, 180)
ESCALATED = (2, 0.4, 90)
#: Fixed value: the share of the node limit above which the second pass runs.
TARGET = 0.85


def _orphans(nodes: DataFrame, edges: DataFrame, today: str, rule: tuple[int, float, int]) -> DataFrame:
    most, weak, age = rule
    ends = edges.select(F.explode(F.array("src", "dst")).alias("key"), "w").groupBy("key").agg(F.count("*").alias("degree"), F.min("w").alias("low"))
    old = nodes.where(F.col("last_seen") < F.date_sub(F.to_date(F.lit(today)), age))
    return old.join(ends, "key", "left").where(F.col("degree").isNull() | ((F.col("degree") <= most) & (F.col("low") < weak))).select("key")


def prune(nodes: DataFrame, edges: DataFrame, today: str, node_limit: int) -> DataFrame:
    """(key, round): orphans of a first pass and, if the nodes exceed their target, of a wider one over what is left.

    ``nodes`` is (key, last_seen), ``edges`` is (src, dst, w). Nodes without a date are never old.
    """
    first, _ = materialize(_orphans(nodes, edges, today, ORPHAN), "prune")
    done = first.withColumn("round", F.lit(1))
    if nodes.count() <= TARGET * node_limit:
        return done
    kept = edges.join(first.withColumnRenamed("key", "src"), "src", "left_anti").join(first.withColumnRenamed("key", "dst"), "dst", "left_anti")
    second = _orphans(nodes.join(first, "key", "left_anti"), kept, today, ESCALATED)
    return done.unionAll(second.withColumn("round", F.lit(2)))
