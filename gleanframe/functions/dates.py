"""Lenient last-modified dates and strict filter dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import trimmed


def lastmod_date(value: Column) -> Column:
    """The date a last-modified string starts with: full time, day, month or year, whichever first succeeds.

    Only the first 19, 10, 7 or 4 characters count, so a zone or junk behind them is ignored; null where nothing fits
    or the year is before 1.
    """
    s = trimmed(value)
    found = F.coalesce(
        F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-M-d'T'H:m:s")).cast("date"),
        F.try_to_date(F.substring(s, 1, 10), "yyyy-M-d"),
        F.try_to_date(F.substring(s, 1, 7), "yyyy-M"),
        F.try_to_date(F.substring(s, 1, 4), "yyyy"),
    )
    return F.when(F.year(found) >= 1, found)


def in_range(day: Column, start: date | None, end: date | None, strict: bool = False) -> Column:
    """Within both bounds, inclusive; without bounds everything is, and a null day is unless ``strict``."""
    if start is None and end is None:
        return F.lit(True)
    ok = F.lit(True)
    if start is not None:
        ok = ok & (day >= F.lit(start))
    if end is not None:
        ok = ok & (day <= F.lit(end))
    return F.coalesce(ok, F.lit(not strict))
