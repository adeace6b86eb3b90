"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from a bounded labelled sample (``MAX_LABELLED`` rows of two dozen
numbers) and flattened into arrays, which score whole Arrow batches by vectorised traversal.

Defined cases: a null or empty text has statistics of zero and is scored like any other; ties and
repeated rows score alike; an empty table gives an empty result; with no usable label every score is
0.5, with labels of one class only that class's smoothed share. Columns other than the id and the
text are never read, whatever their names; ``keep`` returns them as they are. Ids are whole numbers.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fold_of, labelled, labelled_texts, map_arrow, text_score

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "newline", "symbol", "bang", "stop_mark",
    "comma", "pipe", "other_mark", "wide", "byte_entropy", "distinct_words", "top_word", "top_ten_words",
    "distinct_pairs", "distinct_lines", "line_length", "long_words", "short_words", "deflated",
)
FOLDS, HELD = 5, 0


def _byte_classes() -> np.ndarray:
    """One row a byte value, one column a class of bytes."""
    table = np.zeros((256, 11))
    classes = [range(65, 91), range(48, 58), b" \t", b"\n", b"#*$%&<>", b"!", b".?", b",;:", b"|"]
    for column, members in enumerate(classes):
        table[list(members), column] = 1
    marks = [b for b in range(33, 127) if not chr(b).isalnum() and not table[b].any()]
    table[marks, 9] = 1
    table[128:, 10] = 1
    return table


_CLASSES = _byte_classes()


def statistics(text: str | None) -> np.ndarray:
    """The numbers of ``FEATURES`` for one whole text."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    n = len(raw)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = histogram @ _CLASSES / n
    used = histogram[histogram > 0] / n
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    out[0], out[1] = np.log1p(n), np.log1p(len(words))
    out[3:14] = share
    out[14] = -(used * np.log2(used)).sum()
    if words:
        counts: dict[bytes, int] = {}
        for word in words:
            counts[word] = counts.get(word, 0) + 1
        ranked = sorted(counts.values(), reverse=True)
        lengths = np.fromiter(map(len, counts), np.int64, len(counts))
        weights = np.fromiter(counts.values(), np.int64, len(counts))
        out[2] = lengths @ weights / len(words)
        out[15] = len(counts) / len(words)
        out[16] = ranked[0] / len(words)
        out[17] = sum(ranked[:10]) / len(words)
        out[18] = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
        out[21] = weights[lengths > 12].sum() / len(words)
        out[22] = weights[lengths < 3].sum() / len(words)
    if lines:
        out[19] = len(set(lines)) / len(lines)
        out[20] = np.log1p(n / len(lines))
    packer = zlib.compressobj(1)  # in pieces, so that a very long text needs no second copy
    out[23] = (sum(len(packer.compress(raw[i : i + 65536])) for i in range(0, n, 65536)) + len(packer.flush())) / n
    return out


@dataclass
class Forest:
    """Complete binary trees as arrays: node k's children are 2k+1 and 2k+2.

    ``feature`` and ``cut`` are (trees, inner nodes), ``leaf`` is (trees, leaves), ``base`` a log-odds.
    """

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0) -> Forest:
    """Boost ``trees`` histogram trees of a fixed depth on the logistic loss."""
    inner = 2**depth - 1
    empty = Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y):
        return empty
    share = (y.sum() + 0.5) / (len(y) + 1)
    empty.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return empty
    width = x.shape[1]
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0)  # (bins - 1, width)
    binned = np.stack([np.searchsorted(edges[:, f], x[:, f], side="left") for f in range(width)], axis=1)
    margin, forest = np.full(len(y), empty.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            side = np.zeros(count, np.int64)
            at = np.full(count, bins - 1)
            for f in range(width):
                cell = local * bins + binned[:, f]
                g = np.bincount(cell, gradient, count * bins).reshape(count, bins).cumsum(1)
                h = np.bincount(cell, hessian, count * bins).reshape(count, bins).cumsum(1)
                left = g[:, :-1] ** 2 / (h[:, :-1] + ridge)
                right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + ridge)
                gain = left + right - (g[:, -1:] ** 2 / (h[:, -1:] + ridge))
                gain[(h[:, :-1] < 1) | (h[:, -1:] - h[:, :-1] < 1)] = 0
                pick = gain.argmax(1)
                value = gain[np.arange(count), pick]
                better = value > best
                best[better], side[better], at[better] = value[better], f, pick[better]
            found = best > 1e-6
            feature[first : first + count] = side
            cut[first : first + count][found] = edges[at[found], side[found]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, gradient, inner + 1) / (np.bincount(slot, hessian, inner + 1) + ridge)
        margin += leaf[slot]
        forest.append((feature, cut, leaf))
    return Forest(empty.base, *(np.stack(part) for part in zip(*forest, strict=True)))


def _measure():
    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "y": batch.column(1), "stats": [statistics(t) for t in batch.column(2).to_pylist()]}

    return each


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "quality") -> Forest:
    """Fit on the labelled documents outside the held-out fold, ``MAX_LABELLED`` of them at most."""
    sample = labelled(spark, labels, target, FOLDS, HELD)
    measured = map_arrow(labelled_texts(docs, sample), "doc_id long, y int, stats array<double>", _measure, ["doc_id", "y", "text"])
    # one row a document even where a document is repeated, so what is collected stays bounded
    rows = measured.groupBy("doc_id", "y").agg(F.min("stats").alias("stats")).orderBy("doc_id").collect()
    x = np.array([r.stats for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.y for r in rows], float))


def _scores(forest: Forest, texts: list[str | None]) -> np.ndarray:
    return forest.predict(np.stack([statistics(t) for t in texts]))


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # bounded by trees and depth

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "score": _scores(shared.value, batch.column(1).to_pylist())}

        return each

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, "doc_id long, score double", make, ["doc_id", "text"]).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    return docs.where(text_score(lambda: lambda texts: _scores(shared.value, texts).tolist())(docs["text"]) >= threshold)
