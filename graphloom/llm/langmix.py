"""Language ID by multilingual mixture inference.

A document is a mixture of languages, each with a distribution over hashed byte n-grams that is learnt
from documents with a known language. Expectation-maximisation estimates the proportions from the
n-gram likelihoods of all documents of a batch at once, as matrix products; the set of languages is
chosen by penalised likelihood: a language leaves the set when that costs less than a penalty that
grows with the logarithm of the number of n-grams.

Every language that occurs is learnt. The model holds one row of numbers for each, so a column with more
values than ``MAX_LANGUAGES``, which no list of the world's languages reaches, is an error.

Defined cases: a null text, an empty one or one without a letter is ``und`` with score 0, as is every
text when no language could be learnt; ties go to the smaller name; repeated rows come out as often as
they go in; an empty table gives an empty result. Columns other than the text are never read
for a prediction, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.common import fold_of, map_arrow
from graphloom.session import materialize

FOLDS, HELD = 4, 2
#: Hashed n-grams: buckets, lengths in bytes.
BUCKETS, LENGTHS = 4096, (1, 2, 3)
#: Documents learnt from for each language at most, and distinct values above which a column isn't one of languages.
MAX_DOCS, MAX_LANGUAGES = 2_000, 10_000
ITERATIONS, SMOOTHING, PENALTY = 12, 0.5, 4.0
#: Documents whose proportions are estimated at once, and characters that are counted at once, up to the next space.
ROWS, STRETCH = 128, 1 << 20
#: What a document's counts add up to when it is learnt from.
WEIGHT = 1_000_000
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_SPACE = regex.compile(r"\s")


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of the letters of one whole text; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    out = np.zeros(BUCKETS, np.int64)
    tail = np.zeros(0, np.uint32)  # the last bytes before a stretch, which its first n-grams begin with
    start, more = 0, True
    while more:
        cut = _SPACE.search(text, start + STRETCH) if len(text) - start > STRETCH else None
        more = cut is not None
        letters = _OTHER.sub(" ", text[start : cut.start() if more else None].lower()).strip()
        start = cut.start() if more else len(text)
        raw = (" " + letters if letters else "") + ("" if more else " ")
        codes = np.concatenate([tail, np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)])
        rolled = np.zeros(len(codes), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            rolled = rolled[: max(0, len(codes) - n + 1)] * np.uint32(257) + codes[n - 1 :]
            if n in LENGTHS:
                mixed = (rolled[max(0, len(tail) - n + 1) :] + np.uint32(n)) * np.uint32(2654435761)
                out += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
        tail = codes[max(0, len(codes) - max(LENGTHS) + 1) :]
    return out


@dataclass
class Languages:
    names: list[str]
    #: (languages, buckets): probability of each bucket.
    rates: np.ndarray

    def infer(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions by (document, language), zero outside the chosen set, and the log-likelihoods."""
        documents, languages = len(grams), len(self.names)
        allowed = np.ones((documents, languages), bool)
        shares, fit = self._em(grams, allowed)
        open_ = np.ones(documents, bool)
        price = PENALTY * np.log(grams.sum(1) + 2)
        for _ in range(languages - 1):
            # of each document that still may lose a language, try without the least of its set
            at = np.flatnonzero(open_ & (allowed.sum(1) > 1))
            if not len(at):
                break
            least = np.where(allowed[at], shares[at], np.inf).argmin(1)
            trial = allowed[at].copy()
            trial[np.arange(len(at)), least] = False
            new_shares, new_fit = self._em(grams[at], trial)
            better = new_fit > fit[at] - price[at]
            allowed[at[better]], shares[at[better]], fit[at[better]] = trial[better], new_shares[better], new_fit[better]
            open_[at[~better]] = False
        return shares, fit

    def _em(self, grams: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shares = allowed / allowed.sum(1, keepdims=True)
        total = np.maximum(grams.sum(1, keepdims=True), 1)
        single = allowed.sum(1).max(initial=0) <= 1
        for _ in range(0 if single else ITERATIONS):
            shares = shares * ((grams / np.maximum(shares @ self.rates, 1e-30)) @ self.rates.T) / total
            shares /= np.maximum(shares.sum(1, keepdims=True), 1e-30)
        return shares, (grams * np.log(np.maximum(shares @ self.rates, 1e-30))).sum(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        for start in range(0, len(texts), ROWS):
            found = [(i, c) for i in range(start, min(start + ROWS, len(texts))) if (c := counts(texts[i])) is not None]
            if not found:
                continue
            shares, _ = self.infer(np.stack([c for _, c in found]).astype(np.float64))
            for (i, _), best, row in zip(found, shares.argmax(1).tolist(), shares, strict=True):
                names[i], scores[i] = self.names[best], float(min(1.0, row[best]))
        return names, scores


def learn(docs: DataFrame) -> Languages:
    """Learn from documents with a language outside the held-out fold.

    At most ``MAX_DOCS`` documents a language, in the order of a hash of the id, each by its whole
    text; every document weighs alike, however long. Texts are read once, for the sample that is written.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD)
    )
    tally = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(tally) > MAX_LANGUAGES:
        raise ValueError(f"the column lang has more than {MAX_LANGUAGES} values")
    if not tally:
        return Languages([], np.zeros((0, BUCKETS)))
    # a hash threshold takes about half as many again as are wanted, so the exact choice sorts a bounded number
    chance = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 1.5 * MAX_DOCS / r.n)) for r in tally], "lang string, chance double")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    near = known.where("text IS NOT NULL").join(F.broadcast(chance), "lang").where(spread <= F.col("chance"))
    near, _ = materialize(near.groupBy("doc_id", "lang").agg(F.max("text").alias("text")), "language-sample")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = near.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= MAX_DOCS).drop("rank")
    sample = near.join(picked, [near["lang"] == picked["lang"], near["doc_id"].eqNullSafe(picked["doc_id"])], "left_semi")
    names = sorted(r.lang for r in tally)
    place = {k: i for i, k in enumerate(names)}
    schema = "at int, sums array<long>"

    def sent(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["at", "sums"])

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = counts(text)
                if found is not None:  # whole numbers, so that sums don't depend on the order
                    sums[place[lang]] = sums.get(place[lang], 0) + found * WEIGHT // found.sum()
        yield sent(sums)

    # a language's sample, which MAX_DOCS bounds, is counted in one task: one row a language
    parts = sample.select("lang", "text").repartition(len(names), "lang").mapInArrow(count, schema).collect()
    found = sorted((r.at, r.sums) for r in parts)
    rates = np.array([r for _, r in found], float).reshape(len(found), BUCKETS) * 1000 / WEIGHT + SMOOTHING
    return Languages([names[i] for i, _ in found], rates / rates.sum(1, keepdims=True))


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)  # languages times BUCKETS numbers

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "lang_pred": names, "score": scores}

        return each

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, "doc_id long, lang_pred string, score double", make, ["doc_id", "text"]).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score"
    )


def proportions(docs: DataFrame, languages: Languages) -> DataFrame:
    """(doc_id, lang, share) for each language of each document's chosen set."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            model, sets = shared.value, []
            for text in batch.column(1).to_pylist():
                found = counts(text) if model.names else None
                row = model.infer(found[None].astype(np.float64))[0][0] if found is not None else []
                sets.append([{"lang": n, "share": float(s)} for n, s in zip(model.names, row) if s > 0])
            return {"doc_id": batch.column(0), "langs": sets}

        return each

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nested = map_arrow(plain, "doc_id long, langs array<struct<lang: string, share: double>>", make, ["doc_id", "text"])
    return nested.select("doc_id", F.inline("langs"))
