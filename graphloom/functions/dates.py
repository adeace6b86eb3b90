"""Dates: tolerant parsing and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """ISO, plain date, RFC 822 and epoch seconds; null for anything else."""
    value = F.trim(text)
    iso = F.when(value.rlike("^\\d{4}-\\d{2}-\\d{2}"), F.try_to_timestamp(value))
    rfc = F.when(
        value.rlike("^[A-Za-z]{3}, \\d{1,2} [A-Za-z]{3} \\d{4}"),
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), " (GMT|UT)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")),
    )
    epoch = F.when(value.rlike("^\\d{9,10}$"), F.timestamp_seconds(F.try_to_number(value, F.lit("9999999999")).cast("long")))
    return F.coalesce(iso, rfc, epoch)


def months_before(reference: Column, months: int) -> Column:
    """The same day so many months earlier, or that month's last day."""
    return F.add_months(reference, -months)


def recent_or_unknown(moment: Column, now: Column, days: int) -> Column:
    return moment.isNull() | (moment >= now - F.make_interval(days=F.lit(days)))
