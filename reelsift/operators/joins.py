"""Join building blocks: semi/anti filters, remaps, grids. Join strategies are left to AQE."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

def filter_min_count(df: DataFrame, key: str, k: int) -> DataFrame:
    """JN-1: keep rows whose ``key`` has at least ``k`` rows (count, then semi join).
    Both sides are partitioned on ``key``, so the semi join reuses the aggregate's exchange."""
    keep = df.groupBy(key).count().where(F.col("count") >= k).select(key)
    return df.join(keep, key, "left_semi")


def keep_known(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN-2: semi join against a set of known ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def drop_known(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN-3: anti join: drop rows whose id is in ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def remap_ids(df: DataFrame, id_map: DataFrame, col: str, old: str = "old_id",
              new: str = "new_id") -> DataFrame:
    """JN-11: replace ids found in the map (left join + coalesce), keep the rest."""
    m = id_map.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    out = df.join(m, df[col] == m["_old"], "left")
    return out.withColumn(col, F.coalesce(F.col("_new"), F.col(col)).cast(df.schema[col].dataType)) \
              .drop("_old", "_new")


def week_grid(keys: DataFrame, key: str, lo, hi, step: str = "7 days",
              out: str = "week_start") -> DataFrame:
    """JN-14: every key x every period from ``lo`` to ``hi`` (scalar Columns), generated by
    ``explode(sequence)`` per key row -- the output is the grid itself, no pair join."""
    return keys.select(key, F.explode(F.sequence(lo, hi, F.expr(f"interval {step}"))).alias(out))


def full_grid(df: DataFrame, dim: str, period: str = "week_start", step: str = "7 days") -> DataFrame:
    """JN-14: every value of ``dim`` x every period between the global first and last period
    of ``df`` (bounds as scalar subqueries)."""
    lo = df.agg(F.min(period)).scalar()
    hi = df.agg(F.max(period)).scalar()
    return week_grid(df.select(dim).distinct(), dim, lo, hi, step, period)
