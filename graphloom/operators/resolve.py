"""Entity resolution: blocks, scored pairs, decisions and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names, similarity
from graphloom.functions.vocab import IDENTIFIERS
from graphloom.operators.components import connected_components
from graphloom.session import materialize, release

#: Members of a block that is compared, and the scores that accept a pair.
MAX_BLOCK, ACCEPT, NEAR_WINKLER, NEAR_LEVENSHTEIN = 400, 0.88, 0.05, 0.10


def shared_identifier(left: str, right: str, identifiers: tuple[str, ...] = IDENTIFIERS) -> tuple[Column, Column]:
    """(the first identifier that both have and share, whether one that both have differs before it)."""
    shared, conflict = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name in reversed(identifiers):
        a, b = F.nullif(F.col(f"{left}.{name}"), F.lit("")), F.nullif(F.col(f"{right}.{name}"), F.lit(""))
        shared = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, F.lit(name))).otherwise(shared)
        conflict = F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(conflict)
    return shared, F.coalesce(conflict, F.lit(False))


def blocked_pairs(rows: DataFrame, most: int = MAX_BLOCK) -> DataFrame:
    """(a, b): pairs of keys of one type that share a block of at most ``most`` members.

    What a larger block has in common tells nobody apart; its members meet in their other blocks, if at all. Sizes
    are counted by a partial aggregate before any row is paired.
    """
    blocks = rows.select("key", "entity_type", F.explode(names.block_keys(F.col("name"), F.col("entity_type"))).alias("block"))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most))
    small = blocks.join(sizes, "block").select("block", "key")
    other = small.select("block", F.col("key").alias("b"))
    return small.withColumnRenamed("key", "a").join(other, "block").where("a < b").select("a", "b").distinct()


def score_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, jaro_winkler, levenshtein, score) of candidate pairs over folded names."""
    folded = rows.select("key", names.fold(F.col("name")).alias("folded"))
    joined = pairs.join(folded.select(F.col("key").alias("a"), F.col("folded").alias("fa")), "a").join(folded.select(F.col("key").alias("b"), F.col("folded").alias("fb")), "b")
    scored = joined.withColumn("jaro_winkler", similarity.jaro_winkler(F.col("fa"), F.col("fb"))).withColumn("levenshtein", similarity.levenshtein_ratio(F.col("fa"), F.col("fb")))
    return scored.select("a", "b", "jaro_winkler", "levenshtein", F.greatest("jaro_winkler", "levenshtein").alias("score"))


def decide(scored: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """Accepted pairs: the score and both similarities near the threshold."""
    return scored.where((F.col("score") >= threshold) & (F.col("jaro_winkler") >= threshold - NEAR_WINKLER) & (F.col("levenshtein") >= threshold - NEAR_LEVENSHTEIN))


def classes(accepted: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, winner): members of each class and its best-attested one."""
    parts = connected_components(accepted, "a", "b").withColumnRenamed("vertex", "key")
    attested = parts.join(rows.select("key", "mentions", "confidence", "name"), "key")
    order = F.struct(-F.col("mentions"), -F.col("confidence"), -F.length("name"), "key")
    best = attested.groupBy("component").agg(F.min_by("key", order).alias("winner"))
    return attested.join(best, "component").select("key", "winner")


def mutual_best(scored: DataFrame) -> DataFrame:
    """One round of matching: pairs that are each other's best, strongest first, ties by keys."""
    ends = scored.select(F.inline(F.array(F.struct(F.col("a").alias("k"), "a", "b", "score"), F.struct(F.col("b").alias("k"), "a", "b", "score"))))
    best = ends.groupBy("k").agg(F.min_by(F.struct("a", "b", "score"), F.struct(-F.col("score"), "a", "b")).alias("p"))
    return best.select("p.a", "p.b", "p.score").groupBy("a", "b", "score").agg(F.count("*").alias("n")).where("n = 2").select("a", "b", "score")


def greedy_matching(accepted: DataFrame) -> DataFrame:
    """All pairs that a greedy choice takes, strongest first, ties by keys; each key is claimed once.

    Rounds of ``mutual_best`` until no pair with two free keys is left.
    """
    spark = accepted.sparkSession
    rest, rest_path = materialize(accepted.select("a", "b", "score").where("a <> b"), "match-rest")
    taken = None
    while not rest.isEmpty():
        best, _ = materialize(mutual_best(rest), "match-best")
        taken = best if taken is None else taken.unionAll(best)
        claimed = best.select(F.explode(F.array("a", "b")).alias("k"))
        free = rest
        for side in ("a", "b"):
            free = free.join(claimed.withColumnRenamed("k", side), side, "left_anti")
        left, left_path = materialize(free.select("a", "b", "score"), "match-rest")
        release(spark, rest_path)
        rest, rest_path = left, left_path
    return rest if taken is None else taken


#: Members of a cell of a block: what one task pairs with another such cell at a time.
CELL = 1000


def pairs_in_blocks(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b) of rows (key, block, entity_type): pairs inside a block whose types agree or are unknown; with ``most``, only of blocks of so many rows.

    Blocks are dealt into cells of about ``CELL`` rows and cells are paired, so that no task gets a large block whole. A
    pair comes as often as its rows share a block.
    """
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > 1 if most is None else (F.col("n") > 1) & (F.col("n") <= most))
    cells = F.ceil(F.col("n") / CELL)
    dealt = rows.join(sizes, "block").select("block", "key", "entity_type", F.pmod(F.xxhash64("key"), cells).alias("cell"), F.sequence(F.lit(0).cast("long"), cells - 1).alias("others"))
    a = dealt.select("block", F.col("cell").alias("i"), F.explode("others").alias("j"), F.col("key").alias("a"), F.col("entity_type").alias("a_type"))
    b = dealt.select("block", F.explode("others").alias("i"), F.col("cell").alias("j"), F.col("key").alias("b"), F.col("entity_type").alias("b_type"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    a = a.repartition(tasks, "block", "i", "j")  # few rows make many pairs, so the number of tasks doesn't follow the bytes
    free = (F.col("a_type") == F.col("b_type")) | (F.col("a_type") == "") | (F.col("b_type") == "")
    return a.join(b, ["block", "i", "j"]).where((F.col("a") < F.col("b")) & free).select("a", "b")


#: Nodes and edges that a store holds, where it stops taking more, and the share it aims at.
NODE_LIMIT, EDGE_LIMIT, STOP, TARGET = 200_000, 400_000, 180_000, 0.85


def capacity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, shares of the limits, what is left, and whether the target or the stop is passed."""
    one = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("links")))  # one row each
    share = one.withColumns({"node_share": F.round(F.col("nodes") / NODE_LIMIT, 4), "edge_share": F.round(F.col("links") / EDGE_LIMIT, 4)})
    left = lambda limit: F.greatest(F.lit(0).cast("long"), limit - F.col("nodes"))
    stop = F.col("nodes") >= STOP
    return share.select(
        "nodes", "links", "node_share", "edge_share", left(NODE_LIMIT).alias("headroom"), left(STOP).alias("to_stop"), stop.alias("stop"),
        ((F.col("node_share") >= TARGET) | (F.col("edge_share") >= TARGET) | stop).alias("over_target"),
    )
