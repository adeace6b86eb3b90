"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in SQL only.

Every source's documents are laid on a line of words in a hashed order, epoch after epoch, and the line is
cut at the source's target into whole blocks, its quota. The tree splits the quotas among the output
shards: at each node a random part of its blocks, as large as the node's left share, goes left, so the
counts by source are a multivariate-hypergeometric draw and add up exactly. Each leaf, which is a shard,
then draws as many blocks of a source as its quota says from that source's permuted blocks, leaf after leaf, so
that draws are disjoint. A copy of a document is in the mix if a leaf drew the block under its midpoint,
goes to that leaf's shard, and is shuffled there by a hash.

Defined cases: a null or empty text has no words and is never drawn; a null source is a source of its
own and comes last; a null id hashes as the empty text; rows alike in id, source and text lie side by side on
the line and are drawn each by its own midpoint; an empty table gives an empty result; columns other than id, source and text are never
read, whatever their names, and ``mixed`` returns them as they are. Ids are whole numbers. Reruns agree, as all that is
random is a hash of the rows and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import free_names
from graphloom.session import materialize

#: Weights by the rank of the source, repeating; share of all words to draw; epochs at most.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Output shards, blocks of all lines together (with one more a source at most), and the seed. Sources are a
#: dimension: the tree and the targets sort one row a block and one a source.
SHARDS, BLOCKS, SEED = 16, 8192, 42
#: Hexadecimal digits of the hash by which a source's line is cut for counting: 4,096 groups a source.
SUB_DIGITS = 3
#: A word is a run of characters other than the six ASCII spaces.
WORD = "[^\\x20\\x09-\\x0D]+"
_SOURCE = ["no_source", "source"]
#: Rows alike that are numbered together.
ALIKE = 10_000


def units(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for all rows alike in id, source and text, with its words and its place in the order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.md5(text).alias("digest"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        )
        .groupBy("doc_id", *_SOURCE, "digest", "size").agg(F.count("*").alias("n"))
        .withColumn("at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")))
        .withColumn("sub", F.substring("at", 1, SUB_DIGITS))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``weight`` and ``target`` to one row a source (no_source, source, source_size).

    A target is the smaller of ``cap`` times the source's size and ``level`` times its weight, where
    the level makes the targets add up: that is where resharing the excess ends. Sources are a
    small dimension, so the windows over all of them hold one row each.
    """
    everything = W.orderBy(*_SOURCE)
    ranked = sizes.withColumn("rank", F.row_number().over(everything) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    )
    by_ratio = W.orderBy((cap * F.col("source_size") / F.col("weight")), *_SOURCE)
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    stepped = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (share * F.col("total") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") <= cap * F.col("source_size") / F.col("weight"))
        .withColumn("level", F.min(F.struct(~F.col("fits"), cap * F.col("source_size") / F.col("weight"), *_SOURCE, "level")).over(whole)["level"])
    )
    return stepped.select(*_SOURCE, "source_size", "weight", F.least(cap * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _hash(what: str, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(what), *(F.col(c).cast("string") for c in columns)))


def split(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The tree: from one row a source (no_source, source, quota) to (no_source, source, shard, quota)."""
    nodes = quotas.select(*_SOURCE, F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("unit")).withColumns({"low": F.lit(0), "high": F.lit(shards)})
    for level in range(max(shards - 1, 0).bit_length()):
        node = W.partitionBy("low", "high")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        nodes = (
            nodes.withColumn("middle", middle)
            .withColumn("rank", F.row_number().over(node.orderBy(_hash(f"{seed}/{level}", "no_source", "unit", "source"), *_SOURCE, "unit")))
            .withColumn("room", F.round(F.count("*").over(node) * (F.col("middle") - F.col("low")) / (F.col("high") - F.col("low"))))
            .withColumn("left", F.col("rank") <= F.col("room"))
            .withColumns({"low": F.when(F.col("left") | (F.col("high") - F.col("low") == 1), F.col("low")).otherwise(F.col("middle")),
                          "high": F.when(~F.col("left") | (F.col("high") - F.col("low") == 1), F.col("high")).otherwise(F.col("middle"))})
        )
    return nodes.groupBy(*_SOURCE, F.col("low").alias("shard")).agg(F.count("*").alias("quota"))


def draw(leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """(no_source, source, block, shard, place): each leaf's blocks out of the permuted ones of every source.

    Leaves draw one after the other, so no block is drawn twice; ``place`` is a block's turn in its shard.
    """
    source = W.partitionBy(*_SOURCE)
    spans = leaves.withColumn("end", F.sum("quota").over(source.orderBy("shard")))
    turns = spans.select(*_SOURCE, "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("turn"))
    blocks = leaves.groupBy(*_SOURCE).agg(F.sum("quota").alias("blocks")).select(*_SOURCE, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    permuted = blocks.withColumn("turn", F.row_number().over(source.orderBy(_hash(f"{seed}/blocks", "no_source", "block", "source"), "block")) - 1)
    shard = W.partitionBy("shard").orderBy(_hash(f"{seed}/place", "no_source", "block", "source"), *_SOURCE, "block")
    return turns.join(permuted, [*_SOURCE, "turn"]).withColumn("place", F.row_number().over(shard) - 1).select(*_SOURCE, "block", "shard", "place")


def lay(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row a row of ``docs``: its unit (doc_id, no_source, source, digest), ``n`` (rows alike) and
    ``row`` (its number among them), size, source_size, target, ``at``, and the array ``copies`` of (copy, shard, place),
    one for each epoch, with a null shard where no leaf drew the copy.
    """
    laid, _ = materialize(units(docs, seed), "mix-units")
    words = F.col("size") * F.col("n")
    groups = laid.groupBy(*_SOURCE, "sub").agg(F.sum(words).alias("words"))
    aims = targets(groups.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size")), weights, share, cap)
    per_block = F.greatest(F.lit(1.0), min(share, cap) * F.sum("source_size").over(W.partitionBy()) / blocks)
    quota = F.greatest(F.lit(1.0), F.round(F.col("target") / per_block)).cast("long")
    aims, _ = materialize(aims.withColumn("quota", F.when(F.col("target") > 0, quota)).withColumn("block_words", F.col("target") / F.col("quota")), "mix-targets")
    drawn, _ = materialize(draw(split(aims.where("quota > 0").select(*_SOURCE, "quota"), shards, seed), seed), "mix-draws")
    few = drawn.count() <= 4 * blocks  # or there are more sources than that, and the joins shuffle
    before = W.partitionBy(*_SOURCE).orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(aims, _SOURCE)
    inside = W.partitionBy(*_SOURCE, "sub").orderBy("at", "doc_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    rows = (
        laid.withColumn("start", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(offsets, [*_SOURCE, "sub"])
        .withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("middle", F.col("offset") + F.col("start") + F.col("row") * F.col("size") + F.col("size") / 2)
    )
    copies = []
    for copy in range(cap):
        spot = F.col("middle") + copy * F.col("source_size")
        inside_target = (F.col("size") > 0) & (spot < F.col("target"))
        rows = rows.withColumn("block", F.when(inside_target, F.least(F.floor(spot / F.col("block_words")), F.col("quota") - 1)))
        named = drawn.select(*_SOURCE, "block", F.struct(F.lit(copy).alias("copy"), "shard", "place").alias(f"copy_{copy}"))
        rows = rows.join(F.broadcast(named) if few else named, [*_SOURCE, "block"], "left").drop("block")
        copies.append(F.col(f"copy_{copy}"))
    return rows.select("doc_id", *_SOURCE, "digest", "n", "row", "size", "source_size", "target", "at", F.array(*copies).alias("copies"))


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``, and where its copies went.

    ``first_shard`` and ``first_place`` are those of its copy in the first epoch: the shard whose leaf drew its
    block, and that block's turn in the shard; ``second_...`` those in the second. Null where not drawn.
    """
    place = lambda copy, what: F.col("copies")[copy][what].cast("int").alias(f"{('first', 'second')[copy]}_{what}")
    times = F.size(F.filter("copies", lambda c: c["shard"].isNotNull()))
    return lay(docs).select(
        "doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), *(place(copy, what) for copy in (0, 1) for what in ("shard", "place"))
    )


def _numbered(docs: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Number rows alike in ``keys`` from 0, ``ALIKE`` of them in one group at most."""
    part, own, offset = free_names(docs, "part", "own", "offset")
    written, _ = materialize(docs.withColumn(part, F.floor(F.monotonically_increasing_id() / ALIKE)), "mix-alike")
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    counts = written.groupBy(*keys, part).agg(F.count("*").alias(own)).withColumn(offset, F.coalesce(F.sum(own).over(before), F.lit(0))).drop(own)
    order = W.partitionBy(*keys, part).orderBy(F.lit(0))
    ranked = written.withColumn(own, F.row_number().over(order) - 1)
    same = [ranked[k].eqNullSafe(counts[k]) for k in [*keys, part]]
    return ranked.join(counts, same).select(*(ranked[c] for c in docs.columns), (ranked[own] + counts[offset]).alias(row))


def mixed(docs: DataFrame, with_places: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix draws them, shuffled in each shard.

    Rows are dealt by shard and the first digits of the shuffle's hash, and sorted by that hash, so that
    a shard's files are in shuffled order and no task holds a whole shard. ``with_places`` adds the struct
    ``mix`` of copy, shard, place (its block's turn in the shard) and key (the hash).
    """
    rows, _ = materialize(lay(docs), "mix-rows")
    drawn = rows.withColumn("mix", F.explode(F.filter("copies", lambda c: c["shard"].isNotNull())))
    names = ["doc_id", *_SOURCE, "digest", "row"]
    keys = free_names(docs, *(f"mix_{c}" for c in names))
    place, sub = free_names(docs, "mix", "sub")
    order = F.md5(F.concat_ws(":", F.col("mix.shard").cast("string"), F.col("mix.copy").cast("string"), F.col("row").cast("string"), "at"))
    side = drawn.select(*(F.col(c).alias(k) for c, k in zip(names, keys)), F.struct("mix.copy", "mix.shard", "mix.place", order.alias("key")).alias(place))
    own = [docs["doc_id"].cast("long"), docs["source"].isNull(), F.coalesce(docs["source"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))]
    keyed = docs.select("*", *(column.alias(k) for column, k in zip(own, keys)))
    repeated = rows.where("n > 1 AND row = 0").select(*(F.col(c).alias(k) for c, k in zip(names[:-1], keys)))
    if repeated.isEmpty():
        numbered = keyed.withColumn(keys[-1], F.lit(0).cast("long"))
    else:
        same = lambda: [keyed[k].eqNullSafe(repeated[k]) for k in keys[:-1]]
        once = keyed.join(repeated, same(), "left_anti").withColumn(keys[-1], F.lit(0).cast("long"))
        numbered = once.unionAll(_numbered(keyed.join(repeated, same(), "left_semi"), keys[:-1], keys[-1]))
    joined = numbered.join(side, [numbered[k].eqNullSafe(side[k]) for k in keys])
    dealt = joined.select(*(numbered[c] for c in docs.columns), side[place]).withColumn(sub, F.substring(F.col(place)["key"], 1, SUB_DIGITS))
    shuffled = dealt.repartition(F.col(place)["shard"], sub).sortWithinPartitions(F.col(place)["shard"], F.col(place)["key"])
    return shuffled.select(*docs.columns, *([F.col(place).alias("mix")] if with_places else []))


def _levels() -> str:
    """SQL of the tree's levels; the number of shards is a power of two."""
    parts = [f"n0 AS (SELECT no_source, source, unnest(range(quota)) AS unit, 0 AS low, {SHARDS} AS high FROM q)"]
    for level in range((SHARDS - 1).bit_length()):
        key = f"md5('{SEED}/{level}:' || CAST(no_source AS VARCHAR) || ':' || unit || ':' || source)"
        parts.append(
            f"n{level + 1} AS (SELECT no_source, source, unit, CASE WHEN goes THEN low ELSE (low + high) // 2 END AS low, CASE WHEN goes THEN (low + high) // 2 ELSE high END AS high FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY low, high ORDER BY {key}, no_source, source, unit) <= round(count(*) OVER (PARTITION BY low, high) / 2) AS goes FROM n{level}))"
        )
    return ",\n".join(parts)


SQL = f"""
WITH r AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, md5(coalesce(text, '')) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
u AS (SELECT doc_id, no_source, source, digest, size, count(*) AS n,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest) AS spot FROM r GROUP BY ALL),
s AS (SELECT no_source, source, CAST(sum(size * n) AS BIGINT) AS source_size FROM u GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY no_source, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, CAST({CAP} * source_size AS DOUBLE) / weight AS ratio,
    ({SHARE} * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum({CAP} * source_size) OVER (ORDER BY CAST({CAP} * source_size AS DOUBLE) / weight, no_source, source
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY CAST({CAP} * source_size AS DOUBLE) / weight, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT level FROM l ORDER BY level > ratio, ratio, no_source, source LIMIT 1),
t AS (SELECT no_source, source, source_size, least(CAST({CAP} * source_size AS DOUBLE), f.level * weight) AS target FROM l, f),
q AS (SELECT *, target / quota AS block_words FROM (SELECT *, CASE WHEN target > 0 THEN CAST(greatest(1.0,
    round(target / greatest(1.0, {min(SHARE, CAP)} * CAST(sum(source_size) OVER () AS DOUBLE) / {BLOCKS}))) AS BIGINT) END AS quota FROM t)),
{_levels()},
turns AS (SELECT no_source, source, low AS shard, row_number() OVER (PARTITION BY no_source, source ORDER BY low, unit) AS turn FROM n{(SHARDS - 1).bit_length()}),
permuted AS (SELECT no_source, source, unit AS block,
    row_number() OVER (PARTITION BY no_source, source ORDER BY md5('{SEED}/blocks:' || CAST(no_source AS VARCHAR) || ':' || unit || ':' || source), unit) AS turn FROM n0),
d AS (SELECT no_source, source, block, shard, CAST(row_number() OVER (PARTITION BY shard
    ORDER BY md5('{SEED}/place:' || CAST(no_source AS VARCHAR) || ':' || block || ':' || source), no_source, source, block) - 1 AS INTEGER) AS place
    FROM turns JOIN permuted USING (no_source, source, turn)),
o AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY no_source, source ORDER BY spot, doc_id NULLS FIRST, digest
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
m AS (SELECT *, CAST(start + copy_no * size AS DOUBLE) + size / 2.0 AS middle FROM (SELECT *, unnest(range(n)) AS copy_no FROM o)),
b AS (SELECT m.doc_id, m.size, m.no_source, m.source, q.source_size, q.target,
    CASE WHEN size > 0 AND middle < target THEN least(CAST(floor(middle / block_words) AS BIGINT), quota - 1) END AS block_a,
    CASE WHEN size > 0 AND middle + source_size < target THEN least(CAST(floor((middle + source_size) / block_words) AS BIGINT), quota - 1) END AS block_b
    FROM m JOIN q USING (no_source, source))
SELECT b.doc_id, b.size, b.source_size, b.target, CAST(b.size * ((x.shard IS NOT NULL)::INT + (y.shard IS NOT NULL)::INT) AS BIGINT) AS taken,
    x.shard AS first_shard, x.place AS first_place, y.shard AS second_shard, y.place AS second_place
FROM b LEFT JOIN d x ON x.no_source = b.no_source AND x.source = b.source AND x.block = b.block_a
    LEFT JOIN d y ON y.no_source = b.no_source AND y.source = b.source AND y.block = b.block_b
"""
