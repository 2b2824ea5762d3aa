"""Partial aggregates that are kept and merged (AG-1..3): new days never read the old ratings again.

A store is a folder of runs. A run holds, per key and day, what merges exactly (count, sum, sum of
squares, least, greatest) and sketches of what does not (HyperLogLog of the other side's ids, KLL of
the ratings). ``add_days`` writes a run, ``merged`` adds all runs up, ``compact`` makes them one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EXACT = {"n": F.sum, "total": F.sum, "squares": F.sum, "least": F.min, "greatest": F.max}
SKETCHES = {"others": F.hll_union_agg, "values": F.kll_merge_agg_double}


def day_partials(ratings: DataFrame, key: str, other: str) -> DataFrame:
    """(key, day, partials) of ``ratings``; rows without a rating count for no key."""
    r = F.col("rating").cast("double")
    day = F.to_date(F.timestamp_seconds("timestamp")).alias("day")
    return (ratings.where(F.col("rating").isNotNull()).groupBy(key, day)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("total"), F.sum(r * r).alias("squares"), F.min(r).alias("least"),
                 F.max(r).alias("greatest"), F.hll_sketch_agg(F.col(other).cast("long")).alias("others"), F.kll_sketch_agg_double(r).alias("values")))


def add_days(ratings: DataFrame, path: str, key: str, other: str, run: str) -> None:
    """Write the partials of ``ratings`` (the new rows only) as run ``run`` of the store at ``path``.
    A run that is written again takes the place of the first, so a repeated batch counts once."""
    day_partials(ratings, key, other).write.mode("overwrite").parquet(f"{path}/run={run}")


def _store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def _together(store: DataFrame, by: list[str]) -> DataFrame:
    return store.groupBy(*by).agg(*[f(c).alias(c) for c, f in {**EXACT, **SKETCHES}.items()])


def merged(spark: SparkSession, path: str, key: str, since=None, until=None) -> DataFrame:
    """Statistics per key over all runs, or over the days ``since`` <= day < ``until`` of them:
    total_ratings, avg_rating, rating_std (0 for one rating), min_rating, max_rating as from the
    ratings themselves; others_about (distinct other ids) and median_about from the sketches."""
    store = _store(spark, path)
    if since is not None:
        store = store.where(F.col("day") >= F.lit(since))
    if until is not None:
        store = store.where(F.col("day") < F.lit(until))
    n, mean = F.col("n"), F.col("total") / F.col("n")
    spread = F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0))
    return _together(store, [key]).select(
        key, n.cast("int").alias("total_ratings"), mean.alias("avg_rating"),
        F.when(n > 1, F.sqrt(spread / F.when(n > 1, n - 1))).otherwise(0.0).alias("rating_std"),
        F.col("least").alias("min_rating"), F.col("greatest").alias("max_rating"),
        F.hll_sketch_estimate("others").alias("others_about"), F.kll_sketch_get_quantile_double("values", F.lit(0.5)).alias("median_about"))


def compact(spark: SparkSession, path: str, target: str, key: str, run: str = "base") -> None:
    """All runs of ``path`` as one run, still per key and day, of a new store ``target``."""
    _together(_store(spark, path), [key, "day"]).write.mode("overwrite").parquet(f"{target}/run={run}")
