"""Epoch-second time helpers (session time zone must be UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_ts(c) -> Column:
    """FN-5: epoch seconds -> timestamp."""
    return F.timestamp_seconds(_c(c))


def epoch_year(c) -> Column:
    return F.year(epoch_to_ts(c)).cast("short")


def epoch_month(c) -> Column:
    return F.month(epoch_to_ts(c)).cast("byte")


def week_start(c) -> Column:
    """FN-6: Monday-start week of an epoch-second column, as a date."""
    return F.to_date(F.date_trunc("week", epoch_to_ts(c)))


def month_start(c) -> Column:
    """FN-7: first day of the month of an epoch-second column, as a date."""
    return F.to_date(F.date_trunc("month", epoch_to_ts(c)))


def in_range(c, start: str, end: str) -> Column:
    """FLT-4: half-open ``[start, end)`` date range test."""
    return (_c(c) >= F.lit(start).cast("date")) & (_c(c) < F.lit(end).cast("date"))
