"""Connected components by contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable vertex of every vertex that an edge names: columns ``vertex``, ``component``.

    Every round hooks each vertex on its smallest neighbour, shortcuts the hooks until they are
    flat, and contracts the edges on the roots, so the vertices at least halve and the number of
    rounds is logarithmic in the longest chain. A hub's edges meet in a partial aggregate before
    the shuffle; joins against one row a vertex are of the kind that adaptive execution can split.
    Each round's tables are written to the shared folder, so a lost executor costs one round.
    Edges with a null end are left out; self-loops give a component of one vertex.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    current, current_path = materialize(
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges"
    )
    label, label_path = materialize(
        current.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("root", F.col("vertex")),
        "cc-label",
    )
    while True:
        links = current.where("a <> b")
        if links.isEmpty():
            break
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook, hook_path = materialize(
            both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("up")),
            "cc-hook",
        )
        while True:  # pointer jumping: a chain of n hooks is flat after log n of these
            above = hook.select(F.col("v").alias("up"), F.col("up").alias("top"))
            jumped, jumped_path = materialize(
                hook.join(above, "up", "left").select("v", "up", F.coalesce("top", "up").alias("top")), "cc-jump"
            )
            moved = not jumped.where("up <> top").isEmpty()
            release(spark, hook_path)
            hook, hook_path = jumped.select("v", F.col("top").alias("up")), jumped_path
            if not moved:
                break
        merged, merged_path = materialize(
            label.join(hook.select(F.col("v").alias("root"), "up"), "root", "left").select(
                "vertex", F.coalesce("up", "root").alias("root")
            ),
            "cc-label",
        )
        ends = links
        for side in ("a", "b"):
            ends = ends.join(hook.select(F.col("v").alias(side), F.col("up").alias(f"{side}_up")), side, "left")
        contracted, contracted_path = materialize(
            ends.select(F.coalesce("a_up", "a").alias("x"), F.coalesce("b_up", "b").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "cc-edges",
        )
        for path in (label_path, current_path, hook_path):
            release(spark, path)
        label, label_path, current, current_path = merged, merged_path, contracted, contracted_path
    release(spark, current_path)
    return label.select("vertex", F.col("root").alias("component"))
