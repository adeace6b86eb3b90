"""The algebra of confidence: composing it, and merging independent observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Steps of a logarithm's unit.
GRAIN = 1e10


def clamp01(value: Column) -> Column:
    """Into 0..1; null and NaN become 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))))


def compose(source_weight: Column, method: Column, evidence: Column) -> Column:
    """Source weight by method factor by evidence, six digits; co-occurrence counts 0.8, others 1."""
    factor = F.when(method == "cooccurrence", F.lit(0.8)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(source_weight * factor * evidence, 6)))


def noisy_or(a: Column, b: Column) -> Column:
    """Probability that one of two independent observations holds, six digits."""
    return F.round(1 - F.exp((_grain(a) + _grain(b)) / GRAIN), 6)


def _grain(value: Column) -> Column:
    """The logarithm of the probability that an observation doesn't hold, in whole steps."""
    return F.round(F.log(F.greatest(1 - clamp01(value), F.lit(1e-12))) * GRAIN).cast("long")


def noisy_or_all(value: Column) -> Column:
    """Aggregate: the same for any number of observations, rounded once.

    Logarithms are added as whole numbers, so the result doesn't depend on the order of the rows.
    """
    return F.round(1 - F.exp(F.sum(_grain(value)) / GRAIN), 6)


def noisy_or_sql(value: str) -> str:
    """``noisy_or_all`` in DuckDB's SQL."""
    return f"round(1 - exp(sum(CAST(round(ln(greatest(1 - {value}, 1e-12::DOUBLE)) * {GRAIN:.0f}) AS BIGINT)) / {GRAIN:.0f}::DOUBLE), 6)"


def strength(weight: Column, confidence: Column) -> Column:
    """Edge strength for projections: weight in .05..1 by confidence in .1..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), weight)) * F.least(F.lit(1.0), F.greatest(F.lit(0.1), confidence))


def corroboration_is_new(stored_docs: Column, doc_id: Column) -> Column:
    """Whether a document is new evidence for an edge; one without an id always is."""
    doc = F.trim(F.coalesce(doc_id, F.lit("")))
    return (doc == "") | stored_docs.isNull() | ~F.array_contains(F.coalesce(stored_docs, F.array().cast("array<string>")), doc)


def remember_doc(stored_docs: Column, doc_id: Column, most: int = 20) -> Column:
    """The bounded list of an edge's documents, the newest last."""
    kept = F.filter(F.coalesce(stored_docs, F.array().cast("array<string>")), lambda d: d != "")
    doc = F.trim(F.coalesce(doc_id, F.lit("")))
    longer = F.when((doc == "") | F.array_contains(kept, doc), kept).otherwise(F.concat(kept, F.array(doc)))
    return F.slice(longer, F.greatest(F.size(longer) - most + 1, F.lit(1)), most)
