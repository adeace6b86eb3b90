"""The registry of sources: which of them a run asks for. Rows have id, adapter and cadence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cadences of a schedule; the last two ask for every source.
CADENCES = ("hourly", "daily", "weekly", "all")


def resolve(specs: DataFrame, requested: Iterable[str] | None = None) -> DataFrame:
    """The sources that are called or served as requested, each once; all where nothing is asked for."""
    wanted = [str(r).strip().lower() for r in requested or ()]
    if not wanted:
        return specs
    return specs.where(F.lower("id").isin(*wanted) | F.lower("adapter").isin(*wanted))


def for_tier(specs: DataFrame, tier: str | None = None) -> DataFrame:
    """The sources of one run of a schedule: hourly and daily runs take their own only, weekly ones and ``all`` take every one."""
    name = (tier or "all").strip().lower()
    if name not in CADENCES:
        raise ValueError(f"unknown tier {tier!r}, expected one of {', '.join(CADENCES)}")
    return specs if name in ("weekly", "all") else specs.where(F.lower("cadence") == name)
