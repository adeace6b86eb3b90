"""String similarity. Levenshtein is built in; Jaro is not, so it runs over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matches(a: str, b: str) -> tuple[int, int]:
    """Characters that match within the window, and those of them out of order."""
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = bytearray(len(b))
    first = []
    for i, sign in enumerate(a):
        at = b.find(sign, max(0, i - reach), i + reach + 1)
        while at >= 0 and taken[at]:
            at = b.find(sign, at + 1, i + reach + 1)
        if at >= 0:
            taken[at] = 1
            first.append(sign)
    second = [b[j] for j in range(len(b)) if taken[j]]
    return len(first), sum(x != y for x, y in zip(first, second, strict=True))


def jaro_of(a: str | None, b: str | None, whole: bool = False) -> float:
    """Jaro similarity; ``whole`` counts full transpositions only. Empty texts match nothing."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    found, moved = _matches(a, b)
    if not found:
        return 0.0
    swaps = moved // 2 if whole else moved / 2
    return (found / len(a) + found / len(b) + (found - swaps) / found) / 3


def winkler_of(a: str | None, b: str | None, whole: bool = False, floor: float = 0.7) -> float:
    """Jaro with a bonus for up to four common first letters, above ``floor`` only."""
    jaro = jaro_of(a, b, whole)
    if jaro <= floor:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_of(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def jaro_whole(a: pd.Series, b: pd.Series) -> pd.Series:
    """Transpositions count in pairs."""
    return pd.Series([jaro_of(x, y, whole=True) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """The bonus applies above 0.7 only: for deduplication."""
    return pd.Series([winkler_of(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def jaro_winkler_always(a: pd.Series, b: pd.Series) -> pd.Series:
    """The bonus always applies and transpositions count in pairs: for resolution."""
    return pd.Series([winkler_of(x, y, whole=True, floor=-1.0) for x, y in zip(a, b)])


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """One less the distance over the longer length; nothing matches an empty text."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0) | a.isNull() | b.isNull(), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def match_score(jaro_winkler_score: Column, levenshtein_score: Column) -> Column:
    return F.round(0.6 * jaro_winkler_score + 0.4 * levenshtein_score, 6)


def token_similarity_of(left: list[str], right: list[str], least: int = 4, near: float = 0.92) -> float:
    """Share of the shorter list's identity tokens that find a partner of their own in the other."""
    a = [t for t in left if len(t) >= least]
    b = [t for t in right if len(t) >= least]
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    free, found = list(b), 0
    for token in a:
        partner = next((t for t in free if t == token or winkler_of(token, t) >= near), None)
        if partner is not None:
            free.remove(partner)
            found += 1
    return found / len(a)


@F.pandas_udf(T.DoubleType())
def token_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([token_similarity_of(list(x), list(y)) for x, y in zip(left, right)])
