"""Split queries: temporal by period, temporal by row, leave-last-n-out, random (sizes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.operators import splits as sp
from reelsift.plans import features as pf
from reelsift.queries import register
from reelsift.queries.features import FORECAST_SQL, SEG_CASUAL, SEG_REGULAR
from reelsift.queries.sql import with_tables

_LOG_SQL = f"""log AS (
  SELECT r.userId, r.movieId, r.rating, r."timestamp",
         CAST(CASE WHEN r.rating >= 4.0 THEN 1 ELSE 0 END AS TINYINT) AS reward,
         CASE WHEN c.n <= {SEG_CASUAL} THEN 'casual' WHEN c.n <= {SEG_REGULAR} THEN 'regular' ELSE 'power' END AS user_segment
  FROM ratings r LEFT JOIN (SELECT userId, count(*) AS n FROM ratings GROUP BY userId) c USING (userId))"""


def _log(spark, sf):
    return pf.interaction_log_from_ratings(adapt.ratings(spark, sf), casual_max=SEG_CASUAL, regular_max=SEG_REGULAR)


@register("forecast_split", "WITH ff AS (" + FORECAST_SQL + """),
wk AS (SELECT week_start, row_number() OVER (ORDER BY week_start DESC) AS r, count(*) OVER () AS p
       FROM (SELECT DISTINCT week_start FROM ff)),
lab AS (SELECT week_start, CASE WHEN r <= greatest(1, round_even(p * 0.1, 0)) THEN 'test'
                               WHEN r <= 2 * greatest(1, round_even(p * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM wk)
SELECT ff.*, lab.split FROM ff JOIN lab USING (week_start)""")
def q_forecast_split(spark, sf):
    """SP-3: last 10 % of weeks test, previous 10 % val, rest train."""
    ff = pf.forecasting_features(adapt.ratings(spark, sf), adapt.movies(spark, sf))
    return sp.temporal_split_periods(ff, "week_start")


@register("rl_temporal_split", with_tables("ratings", extra=_LOG_SQL) + """
SELECT * EXCLUDE (rk, n), CASE WHEN rk >= n - round_even(n * 0.1, 0) THEN 'test'
                            WHEN rk >= n - 2 * round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", userId, movieId, rating) - 1 AS rk,
             count(*) OVER () AS n FROM log)""")
def q_rl_temporal_split(spark, sf):
    """SP-4: global time order, last 10 % of rows test, previous 10 % val (exact cut)."""
    return sp.temporal_split_rows(_log(spark, sf), ["timestamp", "userId", "movieId", "rating"])


@register("rec_leave_last_n_out", with_tables("ratings", extra=_LOG_SQL) + """
SELECT * EXCLUDE (r, n), CASE WHEN r < 5 THEN 'test' WHEN r < 10 THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY "timestamp" DESC, movieId, rating) - 1 AS r,
             count(*) OVER (PARTITION BY userId) AS n FROM log) WHERE n >= 11""")
def q_rec_leave_last_n_out(spark, sf):
    """WN-4: per user newest 5 test, next 5 val, rest train; users with >= 11 ratings."""
    return sp.leave_last_n_out(_log(spark, sf))


@register("rec_leave_last_n_out_raw", with_tables("raw_ratings") + """
SELECT * EXCLUDE (r, n), CASE WHEN r < 5 THEN 'test' WHEN r < 10 THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY "timestamp" DESC NULLS LAST, movieId NULLS FIRST, rating NULLS FIRST) - 1 AS r,
             count(*) OVER (PARTITION BY userId) AS n FROM raw_ratings) WHERE n >= 11""")
def q_rec_leave_last_n_out_raw(spark, sf):
    """WN-4 before cleaning: duplicate rows and null ratings keep their places."""
    return sp.leave_last_n_out(adapt.raw_ratings(spark, sf))


@register("rec_split_users", with_tables("ratings") + """
SELECT count(*) FILTER (WHERE n >= 11) AS eligible_users, count(*) AS total_users,
       count(*) FILTER (WHERE n < 11) AS excluded_users
FROM (SELECT userId, count(*) AS n FROM ratings GROUP BY userId)""")
def q_rec_split_users(spark, sf):
    """WN-4 counts: eligible / total / excluded users."""
    return sp.leave_out_counts(adapt.ratings(spark, sf))


_SPLIT_CUTS = """CAST(round_even(CAST(n AS DOUBLE) * 0.8, 0) AS BIGINT) AS ntr,
       CAST(round_even((n - round_even(CAST(n AS DOUBLE) * 0.8, 0)) * (CAST(0.1 AS DOUBLE) / (1 - CAST(0.8 AS DOUBLE))), 0) AS BIGINT) AS nva"""


@register("user_random_split_sizes", with_tables("ratings") + f"""
SELECT split, rows FROM (
  SELECT 'train' AS split, ntr AS rows FROM (SELECT {_SPLIT_CUTS} FROM (SELECT count(DISTINCT userId) AS n FROM ratings))
  UNION ALL SELECT 'val', nva FROM (SELECT {_SPLIT_CUTS} FROM (SELECT count(DISTINCT userId) AS n FROM ratings))
  UNION ALL SELECT 'test', n - ntr - nva FROM (SELECT n, {_SPLIT_CUTS} FROM (SELECT count(DISTINCT userId) AS n FROM ratings)))""")
def q_user_random_split_sizes(spark, sf):
    """SP-2: exact 80/10/10 sizes of the seeded random split of the user feature table."""
    uf = pf.user_features(adapt.ratings(spark, sf), adapt.movies(spark, sf),
                          casual_max=SEG_CASUAL, regular_max=SEG_REGULAR)
    return sp.random_split(uf, "userId").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@register("movie_random_split", with_tables("ratings", "movies") + f"""
, mf AS (SELECT s.movieId, total_ratings, avg_rating, rating_std, m.genres FROM (
  SELECT movieId, CAST(count(*) AS INTEGER) AS total_ratings,
         round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating,
         round(coalesce(stddev_samp(CAST(rating AS DOUBLE)), 0), 6) AS rating_std
  FROM ratings GROUP BY movieId) s LEFT JOIN movies m USING (movieId)),
rk AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', CAST(movieId AS VARCHAR), '42')), movieId) - 1 AS rk
       FROM mf),
cuts AS (SELECT {_SPLIT_CUTS} FROM (SELECT count(*) AS n FROM mf))
SELECT rk.* EXCLUDE (rk), CASE WHEN rk < ntr THEN 'train' WHEN rk < ntr + nva THEN 'val' ELSE 'test' END AS split
FROM rk, cuts""")
def q_movie_random_split(spark, sf):
    """SP-2: seeded exact-size random split of the movie feature table (md5 order)."""
    mf = pf.movie_features(adapt.ratings(spark, sf), adapt.movies(spark, sf))
    return sp.random_split(mf, "movieId")
