"""Feature-table queries: forecasting grid (flagship), user/movie features, interaction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.operators import aggregates as ag
from reelsift.operators import windows as wn
from reelsift.operators.explore import explode_genres
from reelsift.plans import features as pf
from reelsift.queries import register
from reelsift.queries.sql import with_tables

# Test-data thresholds (FIXTURES.md): segments 20/40 instead of 20/100.
SEG_CASUAL, SEG_REGULAR = 20, 40

_MW = """mw AS (
  SELECT movieId, CAST(date_trunc('week', make_timestamp("timestamp" * 1000000)) AS DATE) AS week_start,
         count(*) AS n, sum(CAST(rating AS DOUBLE)) AS s
  FROM ratings GROUP BY ALL),
gw AS (
  SELECT genre, week_start, CAST(sum(n) AS BIGINT) AS rating_count, sum(s) AS rating_sum
  FROM mw JOIN genre_pairs USING (movieId) GROUP BY ALL)"""

FORECAST_SQL = with_tables("ratings", "genre_pairs", extra=_MW + """,
grid AS (
  SELECT g.genre, CAST(w.w AS DATE) AS week_start
  FROM (SELECT DISTINCT genre FROM gw) g,
       (SELECT unnest(generate_series((SELECT min(week_start) FROM gw)::TIMESTAMP,
                                      (SELECT max(week_start) FROM gw)::TIMESTAMP, INTERVAL 7 DAY)) AS w) w),
full_grid AS (
  SELECT grid.genre, grid.week_start, CAST(coalesce(gw.rating_count, 0) AS INTEGER) AS rating_count,
         gw.rating_sum / gw.rating_count AS avg_rating
  FROM grid LEFT JOIN gw USING (genre, week_start))""") + """
SELECT genre, week_start, rating_count, avg_rating,
       CAST(lag(rating_count, 1) OVER w AS DOUBLE) AS lag_1,
       CAST(lag(rating_count, 2) OVER w AS DOUBLE) AS lag_2,
       CAST(lag(rating_count, 3) OVER w AS DOUBLE) AS lag_3,
       avg(rating_count) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3week_avg,
       avg(rating_count) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_6week_avg,
       0 AS is_synthetic
FROM full_grid WINDOW w AS (PARTITION BY genre ORDER BY week_start)"""


@register("forecast_features", FORECAST_SQL)
def q_forecast_features(spark, sf):
    """WN-8 (flagship): weekly genre demand grid with lags and trailing means."""
    return pf.forecasting_features(adapt.ratings(spark, sf), adapt.movies(spark, sf))


@register("forecast_features_no_leak", FORECAST_SQL
          .replace("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING")
          .replace("ROWS BETWEEN 5 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING"))
def q_forecast_features_no_leak(spark, sf):
    """WN-2 option: trailing means over the previous weeks only (no target leakage)."""
    return pf.forecasting_features(adapt.ratings(spark, sf), adapt.movies(spark, sf), include_current=False)


_GW_SQL = with_tables("ratings", "genre_pairs", extra=_MW) + "SELECT genre, week_start, rating_count, rating_sum FROM gw"


@register("genre_week_counts", _GW_SQL)
def q_genre_week_counts(spark, sf):
    """AG-6."""
    return ag.genre_week_counts(adapt.ratings(spark, sf), explode_genres(adapt.movies(spark, sf)))


@register("user_stats", with_tables("ratings") + """
SELECT userId, CAST(count(*) AS INTEGER) AS total_ratings,
       round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating,
       round(coalesce(stddev_samp(CAST(rating AS DOUBLE)), 0), 6) AS rating_std,
       CAST(min(rating) AS DOUBLE) AS min_rating, CAST(max(rating) AS DOUBLE) AS max_rating,
       round(avg(CASE WHEN rating >= 4.0 THEN 1.0 ELSE 0.0 END), 6) AS avg_reward
FROM ratings GROUP BY userId""")
def q_user_stats(spark, sf):
    """AG-1."""
    s = ag.user_stats(adapt.ratings(spark, sf))
    return s.select("userId", "total_ratings", *[F.round(c, 6).alias(c) for c in ("avg_rating", "rating_std")],
                    "min_rating", "max_rating", F.round("avg_reward", 6).alias("avg_reward"))


@register("movie_stats", with_tables("ratings") + """
SELECT movieId, CAST(count(*) AS INTEGER) AS total_ratings,
       round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating,
       round(coalesce(stddev_samp(CAST(rating AS DOUBLE)), 0), 6) AS rating_std
FROM ratings GROUP BY movieId""")
def q_movie_stats(spark, sf):
    """AG-2."""
    s = ag.movie_stats(adapt.ratings(spark, sf))
    return s.select("movieId", "total_ratings", F.round("avg_rating", 6).alias("avg_rating"),
                    F.round("rating_std", 6).alias("rating_std"))


_UGC = """ugc AS (SELECT userId, genre, count(*) AS "count" FROM ratings JOIN genre_pairs USING (movieId)
                GROUP BY ALL)"""


@register("user_genre_counts", with_tables("ratings", "genre_pairs", extra=_UGC) +
          'SELECT userId, genre, "count" FROM ugc')
def q_user_genre_counts(spark, sf):
    """AG-4."""
    return ag.user_genre_counts(adapt.ratings(spark, sf), explode_genres(adapt.movies(spark, sf)))


_FAV = _UGC + """,
fav AS (SELECT userId, first(genre ORDER BY "count" DESC, genre ASC) AS favorite_genre FROM ugc GROUP BY userId)"""


@register("favorite_genre", with_tables("ratings", "genre_pairs", extra=_FAV) + "SELECT * FROM fav")
def q_favorite_genre(spark, sf):
    """AG-5."""
    r = adapt.ratings(spark, sf)
    return ag.favorite_genre(ag.user_genre_counts(r, explode_genres(adapt.movies(spark, sf))))


_RECENT = """rk AS (SELECT userId, movieId,
       row_number() OVER (PARTITION BY userId ORDER BY "timestamp" DESC, movieId DESC) AS r FROM ratings),
recent AS (SELECT userId,
       max(CASE WHEN r = 1 THEN movieId END) AS recent_movie_1, max(CASE WHEN r = 2 THEN movieId END) AS recent_movie_2,
       max(CASE WHEN r = 3 THEN movieId END) AS recent_movie_3, max(CASE WHEN r = 4 THEN movieId END) AS recent_movie_4,
       max(CASE WHEN r = 5 THEN movieId END) AS recent_movie_5
  FROM rk WHERE r <= 5 GROUP BY userId)"""


@register("recent_items", with_tables("ratings", extra=_RECENT) + "SELECT * FROM recent")
def q_recent_items(spark, sf):
    """WN-3."""
    return wn.recent_items(adapt.ratings(spark, sf))


_USER_FEATURES = _FAV + ",\n" + _RECENT + f""",
st AS (SELECT userId, CAST(count(*) AS INTEGER) AS total_ratings,
       round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating,
       round(coalesce(stddev_samp(CAST(rating AS DOUBLE)), 0), 6) AS rating_std,
       round(CAST(min(rating) AS DOUBLE), 6) AS min_rating, round(CAST(max(rating) AS DOUBLE), 6) AS max_rating,
       round(avg(CASE WHEN rating >= 4.0 THEN 1.0 ELSE 0.0 END), 6) AS avg_reward
  FROM ratings GROUP BY userId),
uf AS (SELECT st.userId, total_ratings, avg_rating, rating_std, min_rating, max_rating, favorite_genre,
       CASE WHEN total_ratings <= {SEG_CASUAL} THEN 'casual' WHEN total_ratings <= {SEG_REGULAR} THEN 'regular'
            ELSE 'power' END AS user_segment,
       recent_movie_1, recent_movie_2, recent_movie_3, recent_movie_4, recent_movie_5, avg_reward
  FROM st LEFT JOIN fav USING (userId) LEFT JOIN recent USING (userId))"""


@register("user_features", with_tables("ratings", "genre_pairs", extra=_USER_FEATURES) + "SELECT * FROM uf")
def q_user_features(spark, sf):
    """PL-7."""
    return pf.user_features(adapt.ratings(spark, sf), adapt.movies(spark, sf),
                            casual_max=SEG_CASUAL, regular_max=SEG_REGULAR)


@register("segment_counts", with_tables("ratings", "genre_pairs", extra=_USER_FEATURES) +
          "SELECT user_segment, count(*) AS users FROM uf GROUP BY user_segment")
def q_segment_counts(spark, sf):
    """AG-33."""
    uf = pf.user_features(adapt.ratings(spark, sf), adapt.movies(spark, sf),
                          casual_max=SEG_CASUAL, regular_max=SEG_REGULAR)
    return pf.segment_counts(uf)


@register("movie_features", with_tables("ratings", "movies") + """
SELECT s.movieId, total_ratings, avg_rating, rating_std, m.genres FROM (
  SELECT movieId, CAST(count(*) AS INTEGER) AS total_ratings,
         round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating,
         round(coalesce(stddev_samp(CAST(rating AS DOUBLE)), 0), 6) AS rating_std
  FROM ratings GROUP BY movieId) s LEFT JOIN movies m USING (movieId)""")
def q_movie_features(spark, sf):
    """PL-8 (statistics and genres; the embedding columns are checked in ``movie_features_genome``)."""
    return pf.movie_features(adapt.ratings(spark, sf), adapt.movies(spark, sf))


@register("interaction_log", with_tables("ratings") + f"""
SELECT r.userId, r.movieId, r.rating, r."timestamp",
       CAST(CASE WHEN r.rating >= 4.0 THEN 1 ELSE 0 END AS TINYINT) AS reward,
       CASE WHEN c.n <= {SEG_CASUAL} THEN 'casual' WHEN c.n <= {SEG_REGULAR} THEN 'regular' ELSE 'power' END AS user_segment
FROM ratings r LEFT JOIN (SELECT userId, count(*) AS n FROM ratings GROUP BY userId) c USING (userId)""")
def q_interaction_log(spark, sf):
    """PL-9."""
    return pf.interaction_log_from_ratings(adapt.ratings(spark, sf), casual_max=SEG_CASUAL,
                                           regular_max=SEG_REGULAR)
