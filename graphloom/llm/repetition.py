"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths.

A text's words are hashed to 64 bits and windows of n words roll up to one number each, in numpy. A
window whose number occurs again is compared word by word before it counts, so a collision can't
change a result. Covered characters are those inside windows or lines that occur twice or more.

Defined cases: a null text counts as the empty one; an empty text has zeros everywhere and fails the
base rule (fewer than 10 words); repeated rows are judged each by itself; an empty table gives an
empty result. Columns other than the id and the text are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_arrow

#: Window lengths and the largest share of word characters that repeated windows may cover.
LENGTHS = {5: 0.50, 8: 0.45, 10: 0.40}
#: The largest share of word characters in lines that occur twice or more, and of symbols a word.
MAX_LINE_SHARE, MAX_SYMBOLS_A_WORD = 0.40, 0.5
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[bytes]) -> np.ndarray:
    """One number a distinct word, in the order of first sight."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeated_windows(codes: np.ndarray, n: int) -> np.ndarray:
    """True for each start of a window of ``n`` codes that occurs twice or more, exactly."""
    count = len(codes) - n + 1
    if count < 2:
        return np.zeros(max(count, 0), bool)
    mixed = _mixed(codes)
    rolled = np.zeros(count, np.uint64)
    for i in range(n):  # a polynomial in an odd number, modulo 2**64
        rolled = rolled * np.uint64(0x100000001B3) + mixed[i : i + count]
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return np.zeros(count, bool)
    a, b = order[:-1][same], order[1:][same]
    agree = np.ones(len(a), bool)
    for i in range(n):
        agree &= codes[a + i] == codes[b + i]
    repeated = np.zeros(count, bool)
    if agree.all():
        repeated[a] = repeated[b] = True
        return repeated
    windows = np.stack([codes[i : i + count] for i in range(n)], axis=1)  # two windows share a number: sort them themselves
    _, inverse, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    return times[inverse.reshape(-1)] > 1


def covered(repeated: np.ndarray, n: int, words: int) -> np.ndarray:
    """True for each word inside a repeated window."""
    change = np.zeros(words + 1, np.int32)
    change[: len(repeated)] += repeated
    change[n : n + len(repeated)] -= repeated
    return change[:-1].cumsum() > 0


def measure(text: str | None) -> dict:
    """All counts and shares of one whole text, and the verdicts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    total = len(words)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()] if total else []
    times: dict[bytes, int] = {}
    for line in lines:
        times[line] = times.get(line, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, total)
    if not raw.isascii():
        lengths -= np.fromiter((0 if w.isascii() else sum(c & 0xC0 == 0x80 for c in w) for w in words), np.int64, total)
    word_chars = int(lengths.sum())
    out = {"n_words": total, "word_chars": word_chars, "n_symbols": len(_SYMBOL.findall(raw)), "n_dup_lines": len(lines) - len(times)}
    codes = _codes(words)
    for n in LENGTHS:
        inside = covered(repeated_windows(codes, n), n, total)
        if n == 5:
            out["n_repeat_words"] = int(inside.sum())
        out[f"covered_{n}"] = int(lengths[inside].sum())
    twice = b"\n".join(line for line in lines if times[line] > 1)
    out["covered_lines"] = len(b"".join(twice.split()).decode("utf-8", "surrogatepass"))
    out["base_failed"] = total < 10 or 100 * out["n_repeat_words"] > 20 * total
    out["kept"] = not (
        out["base_failed"]
        or any(out[f"covered_{n}"] > most * word_chars for n, most in LENGTHS.items())
        or out["covered_lines"] > MAX_LINE_SHARE * word_chars
        or out["n_symbols"] > MAX_SYMBOLS_A_WORD * total
    )
    return out


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"covered_{n} long" for n in LENGTHS)
    + ", covered_lines long"
)
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Counts, covered characters and verdicts of every row of ``docs`` (doc_id, text)."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            found = [measure(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0)} | {k: [x[k] for x in found] for k in _NAMES[1:]}

        return each

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, SCHEMA, make, ["doc_id", "text"])
