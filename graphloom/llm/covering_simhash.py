"""SimHash near-dedup by covering locality-sensitive hashing (Pagh, 2016).

Fifteen bit masks are built from a code so that any two fingerprints that differ in three bits or
fewer agree under one mask at least: no link can be missed. Equal fingerprints are merged before
anything else, so groups of copies cost one row. In a bucket of one mask, members are linked by a
search that sends on a tree of each connected part, not its pairs. A bucket of more than
``BUCKET`` members is cut again by fifteen masks over the bits that its first mask left out, for which
the same guarantee holds; what then shares a key differs in 16 bits at most, so that a group has a
proven bound of 2**16 members and nothing is capped.

Defined cases: a null text counts as the empty one, whose fingerprint is zero and links like any
other; rows with a null id take part, and a group without any id has a null component; repeated rows
come out as often as they go in; an empty table gives an empty result; columns other than the id and
the text are never read, whatever their names, and ``keep`` returns them as they are. Ids are whole
numbers. A fingerprint or a component that a third of all rows share is joined by ``join_spread``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free_names, join_spread, map_arrow
from graphloom.operators.components import connected_components
from graphloom.session import materialize

RADIUS, SHINGLE, SEED, BITS = 3, 3, 42, 64
#: Members of a bucket that are compared without cutting it again.
BUCKET = 2048


def fingerprint(text: str | None) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes, count = np.zeros(BITS, np.int64), len(starts)
    stops = ends[SHINGLE - 1 :].tolist()
    for i in range(0, count, 65536):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[i : i + 65536], stops[i : i + 65536])), np.uint64)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > count).tolist())


def covering(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions``: whichever ``radius`` of them differ, some mask leaves all of those out.

    Position p carries a nonzero vector of radius + 1 bits; the mask of v holds the positions whose
    vector has an odd product with v. Vectors of ``radius`` positions span less than the whole space,
    so some v is orthogonal to them all.
    """
    size = 2 ** (radius + 1) - 1
    vector = {p: i % size + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(mask: int) -> int:
    return mask - 2**BITS if mask >= 2 ** (BITS - 1) else mask


def masks() -> tuple[list[int], list[list[int]]]:
    """The first masks, and for each of them those of the second cut, as signed longs."""
    first = covering(list(range(BITS)))
    second = [[m | s for s in covering([p for p in range(BITS) if not m >> p & 1])] for m in first]
    return [_signed(m) for m in first], [[_signed(s) for s in row] for row in second]


def _forest(members: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a tree, of three edges a vertex at most, for each connected part of one bucket."""
    left, right = [], []
    rest = members
    while len(rest) > 1:
        found, rest = [rest[:1]], rest[1:]
        at, size = 0, 1
        order = rest[:0]
        order = np.concatenate([order, found[0]])
        while at < size and len(rest):
            close = np.bitwise_count(rest ^ order[at]) <= radius
            if close.any():
                order = np.concatenate([order, rest[close]])
                rest = rest[~close]
                size = len(order)
            at += 1
        if size > 1:
            child = np.arange(1, size)
            left.append(order[(child - 1) // 2])
            right.append(order[child])
    return left, right


def _linker(radius: int):
    """Over sorted (bucket, key, fp) batches: edges between fingerprints of one bucket."""

    def run(batches):
        held = np.zeros((0, 3), np.int64)

        def flush(rows: np.ndarray) -> pa.RecordBatch | None:
            change = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(rows)))
            fps = rows[:, 2].astype(np.uint64)
            left, right = [], []
            pair = starts[sizes == 2]  # most buckets that are shared at all
            close = np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= radius
            left.append(fps[pair][close])
            right.append(fps[pair + 1][close])
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                a, b = _forest(fps[start : start + size], radius)
                left += a
                right += b
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"]) if len(a) else None

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            held = rows[cut:]
            if cut and (out := flush(rows[:cut])) is not None:
                yield out
        if len(held) and (out := flush(held)) is not None:
            yield out

    return run


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (src, dst) that connect all distinct values of ``fp`` within ``radius`` bits."""
    first, second = masks()
    tables = prints.select("fp", F.posexplode(F.array(*map(F.lit, first))).alias("t", "mask")).select(
        "t", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp"
    )
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    again = F.array(*(F.array(*map(F.lit, row)) for row in second))
    finer = F.transform(
        F.element_at(again, F.col("t") + 1),
        lambda mask, i: F.struct((16 * (F.col("t") + 1) + i).cast("long").alias("bucket"), mask.bitwiseAND(F.col("fp")).alias("key")),
    )
    same = F.array(F.struct(F.col("t").cast("long").alias("bucket"), F.col("key")))
    cells = tables.join(shared, ["t", "key"]).select("fp", F.explode(F.when(F.col("n") > bucket, finer).otherwise(same)).alias("cell"))
    dealt = cells.select("cell.bucket", "cell.key", "fp").repartition("bucket", "key").sortWithinPartitions("bucket", "key", "fp")
    return dealt.mapInArrow(_linker(radius), "src long, dst long").distinct()


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``, and the text's SHA-256 if asked for; fp is the fingerprint as a signed long."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            return {"doc_id": batch.column(0), "fp": values.view(np.int64)} | ({"digest": batch.column(2)} if digest else {})

        return each

    more = [_digest(F.col("text")).alias("digest")] if digest else []
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return map_arrow(plain, "doc_id long, fp long" + ", digest binary" * digest, make, plain.columns)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _grouped(distinct: DataFrame, lowest: str) -> DataFrame:
    """Add to one row a fingerprint (fp, ``lowest``, n) the smallest ``lowest`` of its group, as ``group_low``."""
    parts = connected_components(links(distinct.select("fp")))
    first, _ = materialize(distinct.join(parts.select(F.col("vertex").alias("fp"), "component"), "fp", "left"), "simhash-parts")
    groups = first.where("component IS NOT NULL").groupBy("component").agg(F.min(lowest).alias("group_low"), F.count("*").alias("members"))
    named = join_spread(first, materialize(groups, "simhash-groups")[0], "component", "members")
    return named.withColumn("group_low", F.when(F.col("component").isNull(), F.col(lowest)).otherwise(F.col("group_low")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    prints, _ = materialize(fingerprints(docs), "simhash-prints")
    distinct, _ = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    named, _ = materialize(_grouped(distinct, "first").select("fp", F.col("group_low").alias("component_id"), "n"), "simhash-named")
    return join_spread(prints, named, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, with all its columns, for each group of near duplicates.

    The row with the smallest id stays, rows without an id coming last; an id that is repeated or
    missing is told apart by its text, so unrelated texts that share it stay each. If a row is
    repeated, one of its rows stays.
    """
    prints, _ = materialize(fingerprints(docs, digest=True), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), "digest")
    distinct, _ = materialize(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp")))
    group = distinct.join(parts.select(F.col("vertex").alias("fp"), "component"), "fp", "left").groupBy(F.coalesce("component", "fp"))
    key = free_names(docs, "none", "key", "digest")
    stays, _ = materialize(group.agg(F.min("first").alias("first")).select(*(F.col(f"first.{c}").alias(k) for c, k in zip(("none", "key", "digest"), key))), "simhash-stays")
    number = docs["doc_id"].cast("long")
    keyed = docs.select("*", number.isNull().alias(key[0]), F.coalesce(number, F.lit(0).cast("long")).alias(key[1]), _digest(docs["text"]).alias(key[2]))
    # the sort of the join serves dropDuplicates too: the texts are shuffled once
    return keyed.join(stays, key, "left_semi").dropDuplicates(key).select(*(docs[c] for c in docs.columns))
