"""Exact top-k search on an impact-ordered, score-at-a-time index (after Anh and Moffat, 2006).

Vectors are packed into blocks. In a block, each dimension has a list of posting segments by rising value: a
segment holds the members whose value falls in one quantised step, and all of them get the same impact.
Twice a score is (|w|^2 t + |v|^2 / t) - sum of (t w - v)^2 / t, whatever t is: a query's impact on a segment is
the least (t w - v)^2 of its values, what its members lose for certain. Segments are processed by descending
impact, so the most that a member's score can still be is what its length allows less what it has lost. The members
that lost least so far are scored exactly, and the k-th of them is a lower bound of the k-th best score; a member that can't reach it is out. A band
of the postings is used at a time, until a fourth of the members at most are left, which are scored exactly. Where that
never comes, all segments are used up: the result is the same. Every query is searched in one block first, and the
k-th score found there is such a lower bound in all others.

The index is shuffled once, a block to a task. Queries are sent to every block, so what is moved is the index and the
queries times the blocks, and work is that of the stated query set against all rows.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors of
unequal length are compared as if padded with zeros; rows with a null id take no part; every row that repeats a
vec_id is a member, none of them is a candidate of a query with that id, and of rows that make one query the
smallest vector counts; ties go to the smaller vec_id; queries with fewer than k candidates get all; an empty
table gives an empty result. Scores are 64-bit integers. Columns other than vec_id and embedding are never
read, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import reach
from graphloom.session import materialize

SCALE, K, EVERY = 64, 20, 20
#: Members of an index block, queries of a query block, and quantised steps of a list at most.
BLOCK, QUERIES, STEPS = 16_384, 1_024, 256
#: Steps that a query's impacts are ranked by, and shares of the postings by which a proof is tried.
LEVELS = 4_096
SHARES = (1 / 8, 3 / 16, 1 / 4, 5 / 16, 3 / 8, 1 / 2, 3 / 4, 1)
#: A band is a sixteenth of the postings where proofs are likely, and a posting takes the time of about four exact products:
#: one in so many members is scored in the time of such a band.
FEWER = 4
#: Floats below which products and sums of whole numbers are exact.
_EXACT, _EXACT_32 = float(2**53), float(2**24)


@dataclass
class Index:
    """One block: ``ids`` (n), ``vectors`` (n, d) of whole numbers, and its posting segments.

    ``postings`` lists the members by dimension, inside it by rising value. Segment s is
    ``postings[start[s] : start[s + 1]]``, lies in dimension ``dim[s]`` and holds values from ``low[s]``
    to ``high[s]``; ``first[d]`` is the first segment of dimension d.
    """

    ids: np.ndarray
    vectors: np.ndarray
    postings: np.ndarray
    start: np.ndarray
    dim: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    floats: np.ndarray
    #: Squared lengths of the vectors, and room for the postings of a band.
    norms: np.ndarray
    room: np.ndarray
    #: The largest component, whatever its sign.
    peak: int
    #: Postings that the searches so far used, of those that they could have.
    used: int = 0
    asked: int = 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Index:
        n, width = vectors.shape
        postings, starts, dims, low, high, first = [], [], [], [], [], []
        for d, column in enumerate(np.ascontiguousarray(_narrow(vectors).T)):
            order = np.argsort(column, kind="stable")
            ranked = column[order].astype(np.int64)
            size = max(1, -(-(int(ranked[-1]) - int(ranked[0]) + 1) // STEPS))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff((ranked - ranked[0]) // size)) + 1, [n]])
            first.append(len(dims))
            postings.append(order.astype(np.uint16 if n <= 1 << 16 else np.int64))
            starts += (cuts[:-1] + d * n).tolist()
            dims += [d] * (len(cuts) - 1)
            low.append(ranked[cuts[:-1]])
            high.append(ranked[cuts[1:] - 1])
        empty, floats = np.zeros(0, np.int64), vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", floats, floats)
        peak = int(np.abs(vectors).max(initial=0))
        return cls(
            ids, vectors, np.concatenate(postings) if postings else empty, np.array([*starts, n * width], np.int64), np.array(dims, np.int64),
            np.concatenate([*low, empty]), np.concatenate([*high, empty]), np.array(first, np.int64),
            floats.astype(np.float32) if width * peak * peak < _EXACT_32 else floats, norms, np.empty(n * width, np.intp), peak,
        )

    def search(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) of the block for one query, without members called ``own``.

        ``least`` is a score that the k-th best of all blocks reaches; members below it may be left out.
        """
        n = len(self.ids)
        weights = query.astype(np.int64)
        self.asked += len(self.postings)
        if not weights.any() or not self.norms.any() or n <= 4 * k:  # every score is zero, or every member may belong
            self.used += len(self.postings)
            return self._best(np.arange(n), weights, own, k, least)
        w = weights.astype(np.float64)
        # twice the score is (|w|^2 t + |v|^2 / t) less the sum of (t w - v)^2 / t, whatever t is; the bounds are tightest
        # where t w is as long as v. All is counted in units of 1 / t
        length = float(w @ w)
        t = float(np.sqrt(self.norms.mean() / length))
        centre = (t * w)[self.dim]
        away = np.maximum(np.maximum(self.low - centre, centre - self.high), 0)
        impact = away * away  # what each member of a segment loses at least
        sizes = np.diff(self.start)
        # impacts in LEVELS steps, and how many postings each step and those above it hold
        level = (impact * ((LEVELS - 1) / max(float(impact.max()), 1e-300))).astype(np.int64)
        held = np.cumsum(np.bincount(level, sizes, LEVELS)[::-1])
        cuts = LEVELS - 1 - np.searchsorted(held, np.array(SHARES) * held[-1])
        best = self.norms + t * t * length  # the most that twice a member's score can be
        whole = float(best.max()) * 1e-9  # far more than sums of so few floats can err by
        bar = least
        done = np.zeros(len(level), bool)
        possible = np.arange(n)
        for cut in [*cuts.tolist(), None]:
            if bar is not None:
                possible = np.flatnonzero(best >= 2 * t * bar - abs(2 * t * bar) * 1e-9 - whole)
            if cut is None:
                break  # all segments are used up
            if len(possible) * FEWER <= n:
                break  # scoring these exactly takes no longer than the next band
            # the next segments by falling impact; those that lie side by side are read at once
            band = np.flatnonzero((level >= cut) & ~done)
            if not len(band):
                continue
            runs = np.flatnonzero(np.diff(band) > 1) + 1
            heads, tails = band[np.concatenate([[0], runs])], band[np.concatenate([runs - 1, [len(band) - 1]])]
            members = self.room[: int(sizes[band].sum())]
            np.concatenate([self.postings[a:b] for a, b in zip(self.start[heads].tolist(), self.start[tails + 1].tolist())], out=members)
            best -= np.bincount(members, np.repeat(impact[band], sizes[band]), n)
            self.used += len(members)
            done[band] = True
            if least is None:  # the k-th best of any members is a lower bound; those that lost least are likely ones
                likely = np.argpartition(-best, 4 * k)[: 4 * k]
                likely = likely[self.ids[likely] != own]
                if len(likely) >= k:
                    kth = int(np.partition(self._scores(likely, weights), len(likely) - k)[len(likely) - k])
                    bar = kth if bar is None else max(bar, kth)
        return self._best(possible, weights, own, k, least)

    def _scores(self, members: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores: products and sums of whole numbers that floats hold, and fast."""
        rows = self.floats[members]
        if rows.dtype == np.float32 and rows.shape[1] * self.peak * int(np.abs(weights).max(initial=0)) >= _EXACT_32:
            rows = rows.astype(np.float64)
        return (rows @ weights.astype(rows.dtype)).astype(np.int64)

    def _best(self, members: np.ndarray, weights: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the members that may belong to the result, the k best of them."""
        members = members[self.ids[members] != own]
        scores = self._scores(members, weights)
        if least is not None:
            members, scores = members[scores >= least], scores[scores >= least]
        order = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][order], scores[order]


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * component) as longs, of the vectors that take part."""
    component = F.transform("embedding", lambda x: x.cast("double"))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), component.alias("e")).where(
        F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    return usable.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _narrow(rows: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest signed type that holds them all."""
    for kind in (np.int8, np.int16, np.int32):
        if not rows.size or (rows.min() >= np.iinfo(kind).min and rows.max() <= np.iinfo(kind).max):
            return rows.astype(kind)
    return rows


def _pack(most: int):
    """Pack a task's rows (vec_id, v, least, no) into blocks: ``most`` rows at most, all of one ``no``."""

    def block(rows: list[dict], made: int) -> pa.RecordBatch:
        width = max(len(r["v"]) for r in rows)
        packed = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            packed[i, : len(r["v"])] = r["v"]
        number = (TaskContext.get().partitionId() << 32) + made
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]), pa.array([len(rows)], pa.int32()), pa.array([width], pa.int32()), pa.array([np.array([r["vec_id"] for r in rows], np.int64).tobytes()], pa.binary()),
                pa.array([_narrow(packed).tobytes()], pa.binary()), pa.array([[r["least"] for r in rows]], pa.list_(pa.int64())), pa.array([rows[0]["no"]], pa.int32()),
            ],
            names=["block", "n", "d", "ids", "rows", "least", "no"],
        )

    def run(batches):
        rows: list[dict] = []
        made = 0
        for row in (row for batch in batches for row in batch.to_pylist()):
            if rows and (len(rows) == most or rows[0]["no"] != row["no"]):
                yield block(rows, made)
                rows, made = [], made + 1
            rows.append(row)
        if rows:
            yield block(rows, made)

    return run


_PACKED = "block long, n int, d int, ids binary, rows binary, least array<long>, no int"
_FOUND = "query_id long, vec_id long, score long"


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    cells = row["n"] * row["d"]
    kind = np.dtype(f"i{len(row['rows']) // cells}") if cells else np.dtype(np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], kind).astype(np.int64).reshape(row["n"], row["d"])


def _search(k: int):
    """Over rows sorted by block, the index's own row first: the k best members for each query."""

    def run(batches):
        index, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                numbers, vectors = _unpack(row)
                if row["turn"] < 0:
                    index, held = Index.build(numbers, vectors), row["no"]
                    continue
                if held != row["no"]:
                    raise ValueError(f"queries came to block {row['no']} before its vectors")
                large = max(1, vectors.shape[1]) * int(np.abs(vectors).max(initial=0)) * int(np.abs(index.vectors).max(initial=0)) >= _EXACT
                engine = _Plain(index.ids, index.vectors) if large else index  # beyond exact machine arithmetic
                width = index.vectors.shape[1]
                shared = min(width, vectors.shape[1])
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for q, vector, least in zip(numbers.tolist(), vectors, row["least"]):
                    full = np.zeros(width, np.int64)
                    full[:shared] = vector[:shared]
                    found, scores = engine.search(full, q, k, least)
                    out.append((q, found, scores))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(f), q, np.int64) for q, f, _ in out]) if out else [], pa.int64()),
                        pa.array(np.concatenate([f for _, f, _ in out]), pa.int64()),
                        pa.array([int(s) for _, _, scores in out for s in scores], pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return run


class _Plain:
    """A block with numbers too large for exact machine arithmetic: scored one by one."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors

    def search(self, query: np.ndarray, own: int, k: int, least: int | None = None):
        scores = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in self.vectors]
        fit = (i for i in range(len(scores)) if self.ids[i] != own and (least is None or scores[i] >= least))
        order = sorted(fit, key=lambda i: (-scores[i], self.ids[i]))[:k]
        return self.ids[order], [scores[i] for i in order]


def _meet(index: DataFrame, queries: DataFrame, count: int, k: int) -> DataFrame:
    """Search packs of queries (with ``no``, the block they go to): a block's vectors and its queries come to one task."""
    rows = index.withColumn("turn", F.lit(-1).cast("long")).unionByName(queries.withColumn("turn", F.col("block")))
    dealt = rows.select("no", "turn", "n", "d", "ids", "rows", "least").repartitionById(count, "no").sortWithinPartitions("no", "turn")
    return dealt.mapInArrow(_search(k), _FOUND)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query (vec_id divisible by ``every``).

    Blocks and packs of queries are of bounded size. A pack goes to one block first; with the k-th scores
    found there it goes to all others, which return only members that reach them.
    """
    spark = reach(vectors.sparkSession)
    numbers = whole_numbers(vectors, scale)
    n = vectors.count()
    unbound = numbers.select("vec_id", "v", F.lit(None).cast("long").alias("least"), F.lit(None).cast("int").alias("no"))
    packed, _ = materialize(unbound.repartition(max(1, -(-n // BLOCK))).mapInArrow(_pack(BLOCK), _PACKED), "impact-blocks")
    named = packed.select("block").withColumn("no", F.row_number().over(W.orderBy("block")) - 1)  # one row a block
    index, _ = materialize(packed.drop("no").join(named, "block"), "impact-index")
    count = index.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    home = F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    asked, _ = materialize(numbers.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("no", home), "impact-queries")

    def packs(queries: DataFrame) -> DataFrame:
        return queries.select("vec_id", "v", "least", "no").repartitionById(count, "no").sortWithinPartitions("no").mapInArrow(_pack(QUERIES), _PACKED)

    found, _ = materialize(_meet(index, packs(asked.withColumn("least", F.lit(None).cast("long"))), count, k), "impact-found")
    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    bounded, _ = materialize(packs(asked.join(kth, F.col("vec_id") == F.col("query_id"), "left")), "impact-bounded")
    sent = bounded.withColumnRenamed("no", "home").withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).where("no <> home").drop("home")
    if count > 1:
        found = found.unionAll(_meet(index, sent, count, k))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * coalesce(c.v[i], 0))) AS BIGINT) AS score
    FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % {EVERY} = 0 GROUP BY vec_id) AS q JOIN v AS c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {K}
"""
