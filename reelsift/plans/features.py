"""Feature tables: forecasting grid (flagship), user features, movie features, interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelsift.functions.labels import CASUAL_MAX, POSITIVE_RATING, REGULAR_MAX, reward_label, segment_label
from reelsift.operators.aggregates import (favorite_genre, genre_week_counts, movie_stats, user_genre_counts,
                                           user_stats)
from reelsift.operators.explore import explode_genres
from reelsift.operators.joins import week_grid
from reelsift.operators.windows import lag_features, recent_items, rolling_features
from reelsift.session import cut_lineage

RECENT_HISTORY_LEN = 5


def forecast_grid(counts: DataFrame, lags=(1, 2, 3), rolls=(3, 6), include_current: bool = True) -> DataFrame:
    """WN-8: genre x week counts -> dense genre x week grid (gap weeks: count 0, mean null)
    -> lags and trailing means per genre -> is_synthetic = 0.

    The grid spans the global first..last week for every genre: genres come from the
    aggregate, the bounds are scalar subqueries, and each genre row expands its own week
    sequence (no cross join). The aggregate is genres x weeks in size, independent of the
    number of ratings, so the per-genre window is cheap at any scale."""
    # the aggregate has genres x weeks rows; checkpoint it so the genre list, the week
    # bounds and the join read it instead of re-running the pass over the ratings
    gw = cut_lineage(counts.select("genre", "week_start", "rating_count",
                                   (F.col("rating_sum") / F.col("rating_count")).alias("avg_rating")))
    lo = gw.agg(F.min("week_start")).scalar()
    hi = gw.agg(F.max("week_start")).scalar()
    grid = week_grid(gw.select("genre").distinct(), "genre", lo, hi)
    full = (grid.join(gw, ["genre", "week_start"], "left")
            .withColumn("rating_count", F.coalesce(F.col("rating_count"), F.lit(0)).cast("int")))
    full = lag_features(full, "genre", "week_start", "rating_count", lags)
    full = rolling_features(full, "genre", "week_start", "rating_count", rolls, include_current)
    cols = (["genre", "week_start", "rating_count", "avg_rating"] + [f"lag_{k}" for k in lags]
            + [f"rolling_{n}week_avg" for n in rolls])
    return full.select(*cols, F.lit(0).alias("is_synthetic"))


def forecasting_features(ratings: DataFrame, movies: DataFrame, **kw) -> DataFrame:
    """AG-6 + WN-8 from cleaned ratings and the movie catalogue."""
    return forecast_grid(genre_week_counts(ratings, explode_genres(movies)), **kw)


def user_features(ratings: DataFrame, movies: DataFrame, positive: float = POSITIVE_RATING,
                  casual_max: int = CASUAL_MAX, regular_max: int = REGULAR_MAX,
                  n_recent: int = RECENT_HISTORY_LEN, float32: bool = False) -> DataFrame:
    """PL-7: AG-1 stats + segment + favourite genre + last-n movies, one row per user.
    All three branches are keyed by userId, so the joins are co-partitioned."""
    st = user_stats(ratings, positive)
    fav = favorite_genre(user_genre_counts(ratings, explode_genres(movies)))
    rec = recent_items(ratings, n_recent)
    out = (st.withColumn("user_segment", segment_label("total_ratings", casual_max, regular_max))
           .join(fav, "userId", "left").join(rec, "userId", "left"))
    stats = ["avg_rating", "rating_std", "min_rating", "max_rating"]
    conv = (lambda c: F.col(c).cast("float").alias(c)) if float32 else (lambda c: F.round(c, 6).alias(c))
    return out.select("userId", "total_ratings", *[conv(c) for c in stats], "favorite_genre", "user_segment",
                      *[F.col(f"recent_movie_{i}").cast("int") for i in range(1, n_recent + 1)],
                      conv("avg_reward"))


def segment_counts(user_feats: DataFrame) -> DataFrame:
    """AG-33: users per segment."""
    return user_feats.groupBy("user_segment").agg(F.count(F.lit(1)).alias("users"))


def movie_features(ratings: DataFrame, movies: DataFrame, embeddings: DataFrame | None = None,
                   float32: bool = False) -> DataFrame:
    """PL-8: AG-2 stats + genres (+ genome embedding columns, 0.0 when a movie has none)."""
    st = movie_stats(ratings).join(movies.select("movieId", "genres"), "movieId", "left")
    conv = (lambda c: F.col(c).cast("float").alias(c)) if float32 else (lambda c: F.round(c, 6).alias(c))
    out = st.select("movieId", "total_ratings", conv("avg_rating"), conv("rating_std"), "genres")
    if embeddings is None:
        return out
    emb_cols = [c for c in embeddings.columns if c != "movieId"]
    return out.join(embeddings, "movieId", "left").na.fill(0.0, subset=emb_cols)


def interaction_log(ratings: DataFrame, user_feats: DataFrame, positive: float = POSITIVE_RATING) -> DataFrame:
    """PL-9: every rating row + reward + the user's segment (left join on userId)."""
    seg = user_feats.select("userId", "user_segment")
    return (ratings.select("userId", "movieId", "rating", "timestamp")
            .withColumn("reward", reward_label("rating", positive))
            .join(seg, "userId", "left"))


def interaction_log_from_ratings(ratings: DataFrame, positive: float = POSITIVE_RATING,
                                 casual_max: int = CASUAL_MAX, regular_max: int = REGULAR_MAX) -> DataFrame:
    """PL-9 when only the segment is needed: per-user count -> segment, joined back."""
    seg = (ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
           .select("userId", segment_label("n", casual_max, regular_max).alias("user_segment")))
    return (ratings.select("userId", "movieId", "rating", "timestamp")
            .withColumn("reward", reward_label("rating", positive))
            .join(seg, "userId", "left"))
