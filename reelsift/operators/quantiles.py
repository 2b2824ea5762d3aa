"""Exact quantiles without a sort of the data and without a buffer of all distinct values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

SKETCH_K = 800          # rank error of a KLL sketch about 0.4 %
SELECT_ROWS = 100_000   # a bracket of so many rows is sorted by one task


def _counts(x, lo, hi):
    """One pass: rows below ``lo``, equal to it, strictly inside, equal to ``hi``, all rows up to ``hi``."""
    return (F.count_if(x < lo).alias("below"), F.count_if(x == lo).alias("at_lo"),
            F.count_if((x > lo) & (x < hi)).alias("inside"), F.count_if(x <= hi).alias("upto"))


def kth(values: DataFrame, rank: int, rows: int, select_rows: int = SELECT_ROWS, k: int = SKETCH_K) -> float:
    """The value with 0-based ``rank`` among the ``rows`` rows of ``values`` (one double column ``x``
    without nulls and NaN).

    A KLL sketch brackets the rank; one pass counts below, at the ends of and inside the bracket. The
    rank is then an end, or lies strictly inside, where the search goes on: each turn leaves a few
    hundredths of the rows, and values that many rows share are ends of a bracket, so they never
    stand in its way. A bracket that misses the rank (a sketch is only probably that near) is widened."""
    x = F.col("x")
    inside, before, left, margin = values, 0, rows, 0.01
    while left > select_rows:
        near = [min(1.0, max(0.0, (rank - before) / left + d)) for d in (-margin, margin)]
        ends = inside.agg(F.kll_sketch_agg_double("x", k).alias("s")).select(
            *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(n) for q, n in zip(near, ("lo", "hi"))]).first()
        c = inside.agg(*_counts(x, ends.lo, ends.hi)).first()
        place = rank - before
        if not c.below <= place < c.upto:
            margin *= 2
            continue
        if place < c.below + c.at_lo:
            return ends.lo
        if place >= c.below + c.at_lo + c.inside:
            return ends.hi
        inside, before, left = inside.where((x > ends.lo) & (x < ends.hi)), before + c.below + c.at_lo, c.inside
    by_value = inside.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))  # ``select_rows`` values at most
    return by_value.withColumn("upto", upto).where(F.col("upto") > rank - before).orderBy("x").limit(1).first().x


def exact_quantile(df: DataFrame, col, p: float = 0.5, select_rows: int = SELECT_ROWS) -> float | None:
    """The interpolated quantile ``p`` of a numeric column, as ``percentile`` gives it: nulls are
    skipped, NaN counts as larger than all numbers; None without values. A handful of passes over one
    column, with a sketch or five counts as their only state, however many distinct values there are."""
    col = F.col(col) if isinstance(col, str) else col
    v = df.select(col.cast("double").alias("x")).where("x IS NOT NULL")
    n, odd = v.agg(F.count(F.lit(1)), F.count_if(F.isnan("x"))).first()
    if not n:
        return None
    place = p * (n - 1)
    low, high, numbers = math.floor(place), math.ceil(place), v.where(~F.isnan("x"))
    if high >= n - odd:
        return math.nan
    first = kth(numbers, low, n - odd, select_rows)
    if low == high:
        return first
    upto, after = numbers.agg(F.count_if(F.col("x") <= first), F.min(F.when(F.col("x") > first, F.col("x")))).first()
    second = first if upto > high else after
    return first + (second - first) * (place - low)
