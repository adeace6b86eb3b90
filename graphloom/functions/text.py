"""Texts: cleaning, counting and excerpts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column, most: int = 400_000) -> Column:
    """Zero-width signs dropped, control characters and odd spaces made spaces, line ends unified, cut."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\u200b-\\u200d\\u2060\\ufeff]", "")
    out = F.regexp_replace(out, "\\r\\n?", "\n")
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0b-\\x1f\\x7f]", " ")
    out = F.regexp_replace(out, "[\\t\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000 ]+", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(out, " ?\\n ?", "\n"), "\\n{3,}", "\n\n")), 1, most)


def squash(text: Column, most: int) -> Column:
    """White space collapsed, trimmed and cut."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")), 1, most)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """Words and punctuation signs: what a tokenizer would give at least."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+|[^\\sA-Za-z0-9]"))


def distinct_lines(text: Column, least: int = 1) -> Column:
    """Trimmed lines of ``least`` characters or more, the first of equals, in order."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line))
    return F.array_join(F.array_distinct(F.filter(lines, lambda line: F.length(line) >= least)), "\n")


def snippet(text: Column, query: str, size: int = 90) -> Column:
    """About ``size`` characters around the first match, null without one."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(at - size // 2, F.lit(1))
    return F.when(at > 0, F.substring(text, start, F.lit(size)))


def strip_markup(fragment: Column) -> Column:
    """Tags out, the common entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(fragment, F.lit("")), "<[^>]*>", " ")
    for entity, sign in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def fuzzy_substring(query: str, value: Column) -> Column:
    """2000 less the position, 500 more at the start; null if the query isn't part of the value."""
    at = F.instr(F.lower(value), query.lower()) - 1
    return F.when(at >= 0, 2000 - F.least(at, F.lit(999)) + F.when(at == 0, 500).otherwise(0))
