"""Numeric labels and guards (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's.
CASUAL_MAX = 20
REGULAR_MAX = 100
POSITIVE_RATING = 4.0
RATING_MIN = 0.5
RATING_MAX = 5.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """FN-8: clamp; null stays null (``least``/``greatest`` alone would skip nulls)."""
    x = _c(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def segment_label(n, casual_max: int = CASUAL_MAX, regular_max: int = REGULAR_MAX) -> Column:
    """FN-20: n <= casual_max casual, <= regular_max regular, else power."""
    x = _c(n)
    return (F.when(x <= casual_max, F.lit("casual"))
            .when(x <= regular_max, F.lit("regular"))
            .otherwise(F.lit("power")))


def reward_label(rating, positive: float = POSITIVE_RATING) -> Column:
    """FN-21: 1 when rating >= positive else 0 (byte)."""
    return (_c(rating) >= positive).cast("byte")


def rescale_vote(avg, lo: float = RATING_MIN, hi: float = RATING_MAX) -> Column:
    """FN-22: half-even round of a 0-10 average, halve, clamp to [lo, hi]."""
    return clip(F.bround(_c(avg), 0) / 2.0, lo, hi)


def pct(num, den) -> Column:
    """FN-26: safe percentage (null when the denominator is 0)."""
    return F.try_divide(_c(num).cast("double") * 100.0, _c(den).cast("double"))
