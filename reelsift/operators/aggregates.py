"""Feature aggregates: user/movie stats, genre counts, favourite genre, genre-week counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelsift.functions.dates import week_start
from reelsift.functions.labels import POSITIVE_RATING


def _std0(c: str):
    """Sample std with n = 1 -> 0 (Spark's stddev_samp is NULL there)."""
    return F.coalesce(F.stddev_samp(F.col(c).cast("double")), F.lit(0.0))


def user_stats(ratings: DataFrame, positive: float = POSITIVE_RATING) -> DataFrame:
    """AG-1: per user count, mean, sample std (0 if n = 1), min, max, mean reward."""
    r = F.col("rating").cast("double")
    return ratings.groupBy("userId").agg(
        F.count(F.lit(1)).cast("int").alias("total_ratings"),
        F.avg(r).alias("avg_rating"),
        _std0("rating").alias("rating_std"),
        F.min(r).alias("min_rating"),
        F.max(r).alias("max_rating"),
        F.avg((r >= positive).cast("double")).alias("avg_reward"))


def movie_stats(ratings: DataFrame) -> DataFrame:
    """AG-2: per movie count, mean, sample std (0 if n = 1)."""
    return ratings.groupBy("movieId").agg(
        F.count(F.lit(1)).cast("int").alias("total_ratings"),
        F.avg(F.col("rating").cast("double")).alias("avg_rating"),
        _std0("rating").alias("rating_std"))


def user_genre_counts(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """AG-4: rows per (user, genre). A user rates a movie about once, so the rows are joined as they
    are and the partial aggregate on (user, genre) does the combining."""
    return (ratings.select("userId", "movieId").join(pairs, "movieId")
            .groupBy("userId", "genre").agg(F.count(F.lit(1)).alias("count")))


def favorite_genre(counts: DataFrame) -> DataFrame:
    """AG-5: arg-max genre per user; ties -> alphabetically first genre."""
    return counts.groupBy("userId").agg(
        F.min_by("genre", F.struct((-F.col("count")).alias("k"), F.col("genre").alias("g")))
        .alias("favorite_genre"))


def genre_week_counts(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """AG-6: ratings and rating sum per (genre, Monday week). Aggregated per (movie, week)
    first so the genre fan-out multiplies the aggregate, not the raw ratings."""
    mw = (ratings.select("movieId", week_start("timestamp").alias("week_start"),
                         F.col("rating").cast("double").alias("rating"))
          .groupBy("movieId", "week_start")
          .agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s")))
    return (mw.join(pairs, "movieId")
            .groupBy("genre", "week_start")
            .agg(F.sum("n").alias("rating_count"), F.sum("s").alias("rating_sum")))
