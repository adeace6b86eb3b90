"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps homoglyphs to Latin letters, digit and sign substitutions to the letters they stand
for, and i, l, 1 and | to one class. The lexicon is a short seed list plus terms and word stems learnt
from labelled documents; a match counts at the start of a word and, for whole terms, at its end.
Matches inside an exception phrase are dropped. The weight of what matched is normalised by the
length of the text and calibrated by a logistic curve.

What is learnt is bounded by parameters, not by the corpus: ``MAX_LABELLED`` labelled documents and the
``MAX_TERMS`` entries that explain most of their toxic texts. A term that explains fewer than
``least`` of them (three, or one in two hundred) isn't learnt, however often other texts hold it.

Defined cases: a null or empty text matches nothing and gets the score of such texts; ties between
terms go to the smaller term; repeated rows score alike; an empty table gives an empty result; with no
usable label the seed list and a fixed curve score. Columns other than id and text are never read,
whatever their names; ``keep`` returns them as they are. Ids are whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fold_of, labelled, labelled_texts, map_arrow, text_score
from graphloom.session import materialize

FOLDS, HELD = 4, 2
#: Plain insults in English, with the weight they have without any label.
SEED = {w: 2.0 for w in ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "loser", "scum", "trash", "clown")}
#: Phrases that hold a term but insult nobody.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "idiot proof", "clown fish", "clownfish", "loser bracket", "scum line")
#: Look-alike characters and the letters they are read as.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ҽ": "e", "һ": "h", "і": "i", "ӏ": "l", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ӓ": "ä", "ӧ": "ö",
}
#: Digits and signs and the letters they are read as.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
#: Zero-width characters, which are dropped.
_HIDDEN = "​‌‍⁠﻿­"
STEM_LENGTHS = (4, 5, 6)
MAX_TERMS = 400


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): None for c in _HIDDEN}
    table |= {ord(k): SUBSTITUTES.get(v, v) for k, v in HOMOGLYPHS.items()}
    table |= {ord(k): v for k, v in SUBSTITUTES.items()}
    for offset in range(26):  # full-width Latin letters
        letter = chr(97 + offset)
        table[0xFF41 + offset] = SUBSTITUTES.get(letter, letter)
    return table


_FOLD = _table()
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Lower case, look-alikes and substitutes read as letters."""
    return (text or "").lower().translate(_FOLD)


@dataclass
class Lexicon:
    """``terms``: folded term to weight, stems with a trailing ``*``. ``curve``: intercept and slopes."""

    terms: dict[str, float] = field(default_factory=lambda: {fold(k): v for k, v in SEED.items()})
    curve: tuple[float, ...] = (-3.5, 1.2, 1.0)

    def matcher(self):
        """A function from a text to (sum of weights, distinct terms, largest weight, words)."""
        automaton = ahocorasick.Automaton()
        for term, weight in sorted(self.terms.items()):
            stem = term.endswith("*")
            body = term.rstrip("*")
            known = automaton.get(body, None)
            automaton.add_word(body, (body, len(body), stem or bool(known and known[2]), max(weight, known[3]) if known else weight, False))
        for phrase in EXCEPTIONS:
            body = fold(phrase)
            if body not in automaton:
                automaton.add_word(body, (body, len(body), False, 0.0, True))
        automaton.make_automaton()

        def match(text: str | None) -> tuple[float, int, float, int]:
            folded = fold(text)
            hits, spared = [], []
            for end, (body, length, stem, weight, exception) in automaton.iter(folded):
                start = end - length + 1
                if start and folded[start - 1].isalpha():
                    continue
                if not stem and end + 1 < len(folded) and folded[end + 1].isalpha():
                    continue
                (spared.append((start, end)) if exception else hits.append((start, end, body, weight)))
            if spared:
                hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
            best: dict[int, tuple[str, float]] = {}  # of several terms at one start, the heaviest counts
            for start, _, body, weight in hits:
                if start not in best or weight > best[start][1]:
                    best[start] = (body, weight)
            weights = [w for _, w in best.values()]
            return sum(weights), len({b for b, _ in best.values()}), max(weights, default=0.0), len(folded.split())

        return match

    def scorer(self):
        match = self.matcher()
        curve = np.array(self.curve)

        def scores(texts: list[str | None]) -> np.ndarray:
            margin = inputs([match(t) for t in texts]) @ curve
            return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

        return scores


def inputs(found: list[tuple[float, int, float, int]]) -> np.ndarray:
    """Constant, weight a hundred words on a log scale, and weight of the text whatever its length."""
    x = np.array(found, float).reshape(len(found), 4)
    return np.stack([np.ones(len(x)), np.log1p(100 * x[:, 0] / (x[:, 3] + 10)), np.log1p(x[:, 0]) * np.minimum(x[:, 1], 3) / 3], axis=1)


def entries_of(text: str | None) -> set[str]:
    """The folded words of a text and the stems they start with."""
    out: set[str] = set()
    for word in set(_WORD.findall(fold(text))):
        if len(word) >= 3:
            out.add(word)
        for n in STEM_LENGTHS:
            if len(word) > n:
                out.add(word[:n] + "*")
    return out


def sketches(text: str | None) -> tuple[int, int]:
    """Two min-hashes of the words: near copies of one text mostly share them and count once."""
    words = {w.encode("utf-8", "surrogatepass") for w in (text or "").split()} or {b""}
    return min(xxhash.xxh32_intdigest(w, 1) for w in words), min(xxhash.xxh32_intdigest(w, 2) for w in words)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method with a small ridge; slopes below zero are not allowed."""
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    b[1:] = np.maximum(b[1:], 0)
    return tuple(float(v) for v in b)


def _counts():
    """Entries of a batch with the toxic and clean texts that hold them, counted before any shuffle."""

    def each(batch: pa.RecordBatch) -> dict:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            (toxic if y else clean).update(entries_of(text))
        # an entry with no toxic text in this batch may have some in another, so both are sent on
        names = sorted(toxic.keys() | clean.keys())
        return {"entry": names, "toxic": [toxic[k] for k in names], "clean": [clean[k] for k in names]}

    return each


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Lexicon:
    """Learn terms, weights and the curve from labelled documents outside the held-out fold.

    At most ``MAX_LABELLED`` labelled documents are used. Entries that toxic texts hold at 50 times the
    rate of clean ones or more are chosen greedily while each explains toxic texts that the terms
    before it leave with fewer than four matches.
    """
    sample = labelled(spark, labels, target, FOLDS, HELD)
    # written once: what follows reads the sample, not the corpus
    texts, _ = materialize(labelled_texts(docs, sample).groupBy("doc_id", "y").agg(F.min("text").alias("text")), "toxic-sample")
    # of copies, and of near copies that share both sketches, one text stays
    marked = map_arrow(
        texts, "doc_id long, y int, text string, a long, b long", lambda: _with_sketches, ["doc_id", "y", "text"]
    )
    one, _ = materialize(
        marked.groupBy("y", "a", "b").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("d.doc_id", "y", "d.text"), "toxic-distinct"
    )
    totals = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positives, negatives = totals.get(1, 0), totals.get(0, 0)
    lexicon = Lexicon()
    if not positives or not negatives:
        return lexicon
    counted = map_arrow(one, "entry string, toxic long, clean long", _counts, ["doc_id", "y", "text"])
    summed = counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(3, positives // 200)
    rate = (F.col("toxic") / positives) / ((F.col("clean") + 0.5) / (negatives + 1))
    ranked = (F.col("toxic") >= least) & ((rate >= 50) | ((F.col("clean") == 0) & (rate >= 10)))
    is_seed = F.col("entry").isin(*lexicon.terms)
    # read once and written nowhere: seeds stand before the ranked entries, so the limit leaves none of either out
    found = summed.select("*", ranked.alias("ranked"), is_seed.alias("seed")).where("ranked OR seed")
    found = found.orderBy(F.desc("seed"), F.desc("toxic"), "clean", "entry").limit(MAX_TERMS * 10 + len(lexicon.terms)).collect()
    candidates = sorted((r for r in found if r.ranked), key=lambda r: (-r.toxic, r.clean, r.entry))[: MAX_TERMS * 10]
    weight = {r.entry: float(np.log(r.toxic / positives) - np.log((r.clean + 0.5) / (negatives + 1))) for r in candidates}
    chosen = _greedy(one, weight, least)
    if chosen:
        # a seed term that clean texts hold as often as toxic ones has no place; one never seen stays
        seen = {r.entry: (r.toxic, r.clean) for r in found if r.seed}
        seeds = {k: v for k, v in lexicon.terms.items() if seen.get(k, (1, 0))[0] > seen.get(k, (1, 0))[1]}
        lexicon = Lexicon(seeds | {k: weight[k] for k in chosen})
    shared = spark.sparkContext.broadcast(lexicon)  # bounded by MAX_TERMS

    def make():
        match = shared.value.matcher()

        def each(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "y": batch.column(1), "found": [list(map(float, match(t))) for t in batch.column(2).to_pylist()]}

        return each

    rows = map_arrow(texts, "doc_id long, y int, found array<double>", make, ["doc_id", "y", "text"]).orderBy("doc_id").collect()
    lexicon.curve = _logistic(inputs([tuple(r.found) for r in rows]), np.array([r.y for r in rows], float))
    return lexicon


def _with_sketches(batch: pa.RecordBatch) -> dict:
    texts = batch.column(2)
    pairs = [sketches(t) for t in texts.to_pylist()]
    return {"doc_id": batch.column(0), "y": batch.column(1), "text": texts, "a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}


def _greedy(one: DataFrame, weight: dict[str, float], least: int, deep: int = 4) -> list[str]:
    """Choose entries by how many toxic texts of the bounded sample they help to explain."""
    if not weight:
        return []
    names = sorted(weight)
    place = {k: i for i, k in enumerate(names)}
    shared = one.sparkSession.sparkContext.broadcast(place)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            known = shared.value
            return {"doc_id": batch.column(0), "held": [sorted(known[e] for e in entries_of(t) if e in known) for t in batch.column(2).to_pylist()]}

        return each

    rows = map_arrow(one.where("y = 1"), "doc_id long, held array<int>", make, ["doc_id", "y", "text"]).collect()
    holders: list[list[int]] = [[] for _ in names]
    for i, r in enumerate(rows):
        for e in r.held:
            holders[e].append(i)
    need = np.full(len(rows), deep)
    members = [np.array(h, np.int64) for h in holders]
    chosen: list[str] = []
    while len(chosen) < MAX_TERMS:
        gains = [int((need[m] > 0).sum()) if len(m) else 0 for m in members]
        best = max(range(len(names)), key=lambda i: (gains[i], not names[i].endswith("*"), len(names[i]), weight[names[i]]))
        if gains[best] < least:
            break
        chosen.append(names[best])
        need[members[best]] -= 1
        body, held = names[best].rstrip("*"), members[best]
        for i, name in enumerate(names):  # a stem and what begins with it explain a text once
            other = name.rstrip("*")
            if body.startswith(other) or other.startswith(body):
                members[i] = np.setdiff1d(members[i], held)
    return chosen


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        scores = shared.value.scorer()

        def each(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "score": scores(batch.column(1).to_pylist())}

        return each

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, "doc_id long, score double", make, ["doc_id", "text"]).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        scores = shared.value.scorer()
        return lambda texts: scores(texts).tolist()

    return docs.where(text_score(make)(docs["text"]) < threshold)
