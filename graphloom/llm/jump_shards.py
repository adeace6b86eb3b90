"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions only.

A key's shard follows from the key and the number of shards, with no table of a ring; when a shard is
appended, keys move into it alone. Rows are also numbered without gaps inside each shard, in the order
of a hash, so that numbering is spread over the groups of the hash's first digits and no shard is sorted as
a whole. Rows alike in key, crc and size are one row with a count until they have their slots.

Defined cases: a null key counts as 0; a null text has the size 1 and the crc of the empty text;
repeated rows get slots of their own, in any order among themselves as they are equal; an empty table
gives an empty result. Columns other than the key and the text are never read, whatever their names. Ids
are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import free_names

#: Hexadecimal digits of the slot order's hash that make a group at most, and groups of all shards at most.
SUB_DIGITS, GROUPS = 3, 1 << 18
#: The multiplier of the generator in the published algorithm (a fixed value), in 32-bit halves.
_HIGH, _LOW = divmod(2862933555777941757, 2**32)
_MASK = "4294967295L"


def _step(hi: str, lo: str) -> tuple[str, str]:
    """SQL for the halves of ``x * multiplier + 1`` modulo 2**64; no product passes 63 bits."""
    a, b = _LOW & 0xFFFF, _LOW >> 16
    t = f"({lo} * {a}L + 1L)"
    u = f"({lo} * {b}L + shiftright({t}, 16))"
    low = f"(shiftleft({u} & 65535L, 16) | ({t} & 65535L))"
    cross = f"(({hi} * {a}L) + shiftleft(({hi} * {b}L) & 65535L, 16))"
    high = f"((shiftright({u}, 16) + {lo} * {_HIGH}L + {cross}) & {_MASK})"
    return high, low


def with_jump(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """``rows`` with int columns ``shard`` and ``grown``, the shard once one more is appended.

    Each step jumps ahead by one at least, so ``shards + 1`` guarded steps are always enough; both
    results come from the same steps, as a further shard only lets the last jump count.
    """
    if not 1 <= shards < 2**16:
        raise ValueError("shards must be between 1 and 65535")
    high, low = _step("s.hi", "s.lo")
    new_jump = "cast(floor((s.j + 1) * (2147483648D / cast(shiftright(n.hi, 1) + 1 AS double))) AS bigint)"
    key_sql = f"coalesce(cast(`{key}` AS bigint), 0L)"
    start = (
        f"named_struct('hi', shiftrightunsigned({key_sql}, 32), 'lo', {key_sql} & {_MASK}, 'j', 0L, 'shard', 0L, 'grown', 0L)"
    )
    # per step: the generator's next state n, then the jump m read from it
    step = f"""aggregate(array(named_struct('hi', {high}, 'lo', {low})), s, (z, n) ->
        aggregate(array({new_jump}), s, (y, m) -> named_struct('hi', n.hi, 'lo', n.lo, 'j', m,
            'shard', IF(m < {shards}, m, s.shard), 'grown', IF(m <= {shards}, m, s.grown))))"""
    fold = f"aggregate(sequence(0, {shards}), {start}, (s, i) -> IF(s.j > {shards}, s, {step}))"
    (state,) = free_names(rows, "jump")
    return rows.withColumn(state, F.expr(fold)).withColumns({c: F.col(state)[c].cast("int") for c in ("shard", "grown")}).drop(state)


def shard_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row a row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The order of slots in a shard is that of md5("doc_id:crc"), then doc_id, crc and size.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = rows.withColumn("at", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))))
    digits = max(d for d in range(SUB_DIGITS + 1) if d == 0 or shards * 16**d <= GROUPS)
    placed = with_jump(rows, "doc_id", shards).withColumn("sub", F.substring("at", 1, digits))
    # the counts: GROUPS rows at most, whatever the input's size, hence broadcast
    counts = placed.groupBy("shard", "sub").agg(F.sum("n").alias("rows"))
    before = W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "sub", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    order = W.partitionBy("shard", "sub").orderBy("at", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("rank", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return ranked.join(F.broadcast(offsets), ["shard", "sub"]).withColumn("alike", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("rank") + F.col("alike")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"),
    )
