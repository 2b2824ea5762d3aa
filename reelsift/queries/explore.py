"""Exploratory-analysis queries (distributions, concentration, genres, time, tags, genome)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.operators import explore as ex
from reelsift.operators import partials
from reelsift.operators import windows as wn
from reelsift.operators.quantiles import exact_quantile
from reelsift.queries import register
from reelsift.queries.sql import with_tables
from reelsift.session import cut_lineage, ensure_checkpoint_dir

# Test-data thresholds (FIXTURES.md): movies have 14..49 ratings, so the quality list uses
# >= 30 ratings and "blockbusters" >= 40; the three periods fall inside 1995..2001.
QUALITY_MIN = 30
BLOCKBUSTER = 40
PERIODS = ("1997-01-01", "1999-01-01", "2000-06-01")
TAG_QUERY = "tag 1"

_TS = 'make_timestamp("timestamp" * 1000000)'


def _r(spark, sf):
    return adapt.ratings(spark, sf)


def _m(spark, sf):
    return adapt.movies(spark, sf)


@register("dataset_overview", with_tables("ratings", "movies", "tags", "genome_tags") + f"""
SELECT r.n AS total_ratings, CAST(make_timestamp(r.lo * 1000000) AS DATE) AS ratings_first_date,
       CAST(make_timestamp(r.hi * 1000000) AS DATE) AS ratings_last_date,
       round(floor((r.hi - r.lo) / 86400) / 365.25, 6) AS span_years, r.u AS unique_users,
       (SELECT count(*) FROM movies) AS movies_in_catalog, r.m AS movies_rated,
       t.n AS tag_applications, CAST(make_timestamp(t.lo * 1000000) AS DATE) AS tags_first_date,
       CAST(make_timestamp(t.hi * 1000000) AS DATE) AS tags_last_date, t.u AS tag_users, t.m AS tagged_movies,
       (SELECT count(DISTINCT movieId) FROM genome_scores) AS genome_movies,
       (SELECT count(*) FROM genome_tags) AS genome_tag_vocabulary,
       round(r.n / r.u, 6) AS avg_ratings_per_user, round(r.n / r.m, 6) AS avg_ratings_per_movie
FROM (SELECT count(*) n, count(DISTINCT userId) u, count(DISTINCT movieId) m, min("timestamp") lo, max("timestamp") hi FROM ratings) r,
     (SELECT count(*) n, count(DISTINCT userId) u, count(DISTINCT movieId) m, min("timestamp") lo, max("timestamp") hi FROM tags) t""")
def q_dataset_overview(spark, sf):
    """AG-7."""
    return ex.dataset_overview(_r(spark, sf), _m(spark, sf), adapt.tags(spark, sf),
                               adapt.genome_scores(spark, sf), adapt.genome_tags(spark, sf))


@register("rating_distribution", with_tables("ratings") +
          'SELECT CAST(rating AS DOUBLE) AS rating, count(*) AS "count" FROM ratings GROUP BY 1')
def q_rating_distribution(spark, sf):
    """AG-8."""
    return ex.rating_distribution(_r(spark, sf))


@register("rating_summary", with_tables("ratings") + """
SELECT round(avg(CAST(rating AS DOUBLE)), 6) AS mean_rating, median(CAST(rating AS DOUBLE)) AS median_rating,
       (SELECT CAST(rating AS DOUBLE) FROM ratings GROUP BY rating ORDER BY count(*) DESC, rating LIMIT 1) AS mode_rating,
       round(avg(CASE WHEN rating > 3 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_above
FROM ratings""")
def q_rating_summary(spark, sf):
    """AG-9."""
    return ex.rating_summary(_r(spark, sf))


@register("per_user_activity", with_tables("ratings") + """
SELECT count(*) AS users, median(CAST(n AS DOUBLE)) AS median_per_user, max(n) AS max_per_user
FROM (SELECT userId, count(*) AS n FROM ratings GROUP BY userId)""")
def q_per_user_activity(spark, sf):
    """AG-10."""
    return ex.per_user_activity(_r(spark, sf))


@register("per_movie_popularity", with_tables("ratings") + f"""
SELECT count(*) AS movies, median(CAST(n AS DOUBLE)) AS median_per_movie, max(n) AS max_per_movie,
       count(*) FILTER (WHERE n < 10) AS n_long_tail,
       round(count(*) FILTER (WHERE n < 10) * 100.0 / count(*), 6) AS pct_long_tail,
       count(*) FILTER (WHERE n >= {BLOCKBUSTER}) AS n_blockbuster
FROM (SELECT movieId, count(*) AS n FROM ratings GROUP BY movieId)""")
def q_per_movie_popularity(spark, sf):
    """AG-11."""
    return ex.per_movie_popularity(_r(spark, sf), blockbuster=BLOCKBUSTER)


@register("genre_movie_counts", with_tables("genre_pairs") +
          "SELECT genre, count(DISTINCT movieId) AS num_movies FROM genre_pairs GROUP BY genre")
def q_genre_movie_counts(spark, sf):
    """AG-12 (FN-4, FLT-3)."""
    return ex.genre_movie_counts(_m(spark, sf))


_MT = """mt AS (SELECT movieId, count(*) AS num_ratings, sum(CAST(rating AS DOUBLE)) AS rating_sum
               FROM ratings GROUP BY movieId),
gstats AS (SELECT genre, CAST(sum(num_ratings) AS BIGINT) AS total_ratings, round(sum(rating_sum), 6) AS rating_sum,
                  count(DISTINCT movieId) AS num_movies, round(sum(rating_sum) / sum(num_ratings), 6) AS avg_rating
           FROM mt JOIN genre_pairs USING (movieId) GROUP BY genre)"""


@register("genre_rating_stats", with_tables("ratings", "genre_pairs", extra=_MT) + "SELECT * FROM gstats")
def q_genre_rating_stats(spark, sf):
    """AG-13 (JN-4, JN-5)."""
    return ex.genre_rating_stats(_r(spark, sf), _m(spark, sf))


@register("monthly_volume", with_tables("ratings") +
          f"SELECT CAST(date_trunc('month', {_TS}) AS DATE) AS month, count(*) AS \"count\" FROM ratings GROUP BY 1")
def q_monthly_volume(spark, sf):
    """AG-14 (FN-7)."""
    return ex.monthly_volume(_r(spark, sf))


@register("yearly_avg_rating", with_tables("ratings") +
          f"SELECT CAST(year({_TS}) AS INTEGER) AS year, round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating FROM ratings GROUP BY 1")
def q_yearly_avg_rating(spark, sf):
    """AG-15."""
    return ex.yearly_avg_rating(_r(spark, sf))


_MV = f"""mv AS (SELECT CAST(date_trunc('month', {_TS}) AS DATE) AS month, count(*) AS n FROM ratings GROUP BY 1)"""


@register("peak_month", with_tables("ratings", extra=_MV) +
          'SELECT first(month ORDER BY n DESC, month) AS month, max(n) AS "count" FROM mv')
def q_peak_month(spark, sf):
    """AG-16."""
    return ex.peak_month(_r(spark, sf))


@register("period_comparison", with_tables("ratings", extra=_MV + f""",
p AS (SELECT avg(n) FILTER (WHERE month >= DATE '{PERIODS[0]}' AND month < DATE '{PERIODS[1]}') AS a,
             avg(n) FILTER (WHERE month >= DATE '{PERIODS[1]}' AND month < DATE '{PERIODS[2]}') AS b,
             avg(n) FILTER (WHERE month >= DATE '{PERIODS[2]}') AS c FROM mv)""") + """
SELECT round(a, 6) AS first_period, round(b, 6) AS second_period, round(c, 6) AS third_period,
       round(b / nullif(a, 0) * 100 - 100, 6) AS second_vs_first_pct,
       round(c / nullif(a, 0) * 100 - 100, 6) AS third_vs_first_pct FROM p""")
def q_period_comparison(spark, sf):
    """AG-17 (FLT-4)."""
    return ex.period_comparison(_r(spark, sf), PERIODS)


_GY = f"""my AS (SELECT movieId, CAST(year({_TS}) AS INTEGER) AS year, count(*) AS n FROM ratings GROUP BY ALL),
gy AS (SELECT year, genre, CAST(sum(n) AS BIGINT) AS "count" FROM my JOIN genre_pairs USING (movieId) GROUP BY ALL)"""


@register("genre_year_counts", with_tables("ratings", "genre_pairs", extra=_GY) + "SELECT * FROM gy")
def q_genre_year_counts(spark, sf):
    """AG-18."""
    return ex.genre_year_counts(_r(spark, sf), _m(spark, sf))


_GY8_SQL = with_tables("ratings", "genre_pairs", extra=_GY + ",\n" + _MT + """,
top AS (SELECT genre FROM gstats ORDER BY total_ratings DESC, genre LIMIT 8),
yrs AS (SELECT DISTINCT year FROM gy WHERE genre IN (SELECT genre FROM top))""") + """
SELECT yrs.year, top.genre, coalesce(gy."count", 0) AS "count"
FROM yrs CROSS JOIN top LEFT JOIN gy ON gy.year = yrs.year AND gy.genre = top.genre"""


@register("genre_year_top8", _GY8_SQL)
def q_genre_year_top8(spark, sf):
    """AG-19: years x top-8 genres pivot (missing -> 0), shown long."""
    return ex.genre_year_top_long(_r(spark, sf), _m(spark, sf), 8)


@register("genre_trend_change", with_tables("ratings", "genre_pairs", extra=_GY + """,
sh AS (SELECT year, genre, "count" * 1.0 / sum("count") OVER (PARTITION BY year) AS share FROM gy),
yr AS (SELECT year, row_number() OVER (ORDER BY year) AS a, row_number() OVER (ORDER BY year DESC) AS d
       FROM (SELECT DISTINCT year FROM gy)),
e AS (SELECT genre, avg(share) FILTER (WHERE a <= 3) AS early, avg(share) FILTER (WHERE d <= 3) AS recent
      FROM sh JOIN yr USING (year) GROUP BY genre)""") + """
SELECT genre, round(early, 6) AS early_share, round(recent, 6) AS recent_share,
       round((recent - early) * 100, 6) AS change_pp
FROM e WHERE early IS NOT NULL AND recent IS NOT NULL""")
def q_genre_trend_change(spark, sf):
    """AG-20 (WN-7 share of total, JN-15)."""
    return ex.genre_trend_change(_r(spark, sf), _m(spark, sf), 3)


@register("top_tags", with_tables("tags") + """
SELECT lower(trim(tag)) AS tag, count(*) AS "count" FROM tags WHERE tag IS NOT NULL
GROUP BY 1 ORDER BY "count" DESC, tag LIMIT 20""")
def q_top_tags(spark, sf):
    """AG-21 (FN-18, TK-1)."""
    return ex.top_tags(adapt.tags(spark, sf))


@register("monthly_tag_volume", with_tables("tags") + f"""
SELECT CAST(date_trunc('month', {_TS}) AS DATE) AS month, count(*) AS "count" FROM tags WHERE tag IS NOT NULL GROUP BY 1""")
def q_monthly_tag_volume(spark, sf):
    """AG-22."""
    return ex.monthly_tag_volume(adapt.tags(spark, sf))


@register("movie_tag_counts", with_tables("tags", "movies") + """
SELECT t.movieId, t.num_tags, m.title FROM (
  SELECT movieId, count(*) AS num_tags FROM tags WHERE tag IS NOT NULL GROUP BY movieId
  ORDER BY num_tags DESC, movieId LIMIT 20) t LEFT JOIN movies m USING (movieId)""")
def q_movie_tag_counts(spark, sf):
    """AG-23."""
    return ex.movie_tag_counts(adapt.tags(spark, sf), _m(spark, sf))


@register("tag_relevance_mean", with_tables("genome_tags") + """
SELECT t.tagId, t.relevance, g.tag FROM (
  SELECT tagId, round(avg(CAST(relevance AS DOUBLE)), 6) AS relevance FROM genome_scores GROUP BY tagId
  ORDER BY relevance DESC, tagId LIMIT 20) t LEFT JOIN genome_tags g USING (tagId)""")
def q_tag_relevance_mean(spark, sf):
    """AG-24."""
    return ex.tag_relevance_mean(adapt.genome_scores(spark, sf), adapt.genome_tags(spark, sf))


@register("relevance_summary", with_tables("genome_scores") + """
SELECT round(avg(CAST(relevance AS DOUBLE)), 6) AS mean_relevance,
       round(median(CAST(relevance AS DOUBLE)), 6) AS median_relevance,
       round(avg(CASE WHEN relevance >= 0.5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_relevant FROM genome_scores""")
def q_relevance_summary(spark, sf):
    """AG-25."""
    return ex.relevance_summary(adapt.genome_scores(spark, sf))


def _hist_sql(src: str, expr: str, bins: int) -> str:
    return f"""
SELECT bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi, count(*) AS "count"
FROM (SELECT CAST(CASE WHEN b.hi = b.lo THEN 0 ELSE least(floor((x - b.lo) / ((b.hi - b.lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin,
             b.lo AS lo, (b.hi - b.lo) / {bins} AS w
      FROM (SELECT {expr} AS x FROM {src}) v,
           (SELECT min({expr}) AS lo, max({expr}) AS hi FROM {src}) b WHERE x IS NOT NULL)
GROUP BY bin, lo, w"""


@register("relevance_histogram", with_tables("genome_scores") +
          _hist_sql("genome_scores", "CAST(relevance AS DOUBLE)", 50))
def q_relevance_histogram(spark, sf):
    """AG-26: 50 equal-width bins of genome relevance (the max falls in the last bin)."""
    return ex.histogram(adapt.genome_scores(spark, sf), "relevance", 50)


@register("user_activity_log_histogram", with_tables("ratings", extra="""
pu AS (SELECT userId, count(*) AS n FROM ratings GROUP BY userId)""") +
          _hist_sql("pu", "log10(CAST(n AS DOUBLE))", 60))
def q_user_activity_log_histogram(spark, sf):
    """AG-26 (log bins): 60 bins of log10(ratings per user)."""
    pu = _r(spark, sf).groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    return ex.histogram(pu, "n", 60, log=True)


@register("movie_popularity_log_histogram", with_tables("ratings", extra="""
pm AS (SELECT movieId, count(*) AS n FROM ratings GROUP BY movieId)""") +
          _hist_sql("pm", "log10(CAST(n AS DOUBLE))", 60))
def q_movie_popularity_log_histogram(spark, sf):
    """AG-26 (log bins): 60 bins of log10(ratings per movie)."""
    pm = _r(spark, sf).groupBy("movieId").agg(F.count(F.lit(1)).alias("n"))
    return ex.histogram(pm, "n", 60, log=True)


@register("matrix_sparsity", with_tables("ratings") + """
SELECT users, movies, users * movies AS possible, observed,
       round((1 - observed / (users * movies)) * 100, 6) AS sparsity_pct,
       round(observed / (users * movies) * 100, 6) AS density_pct
FROM (SELECT count(DISTINCT userId) AS users, count(DISTINCT movieId) AS movies, count(*) AS observed FROM ratings)""")
def q_matrix_sparsity(spark, sf):
    """AG-27."""
    return ex.matrix_sparsity(_r(spark, sf))


@register("popularity_quality_corr", with_tables("ratings", extra=_MT.split(",\ngstats")[0]) + f"""
SELECT count(*) AS qualified, round(corr(CAST(num_ratings AS DOUBLE), rating_sum / num_ratings), 6) AS corr
FROM mt WHERE num_ratings >= {QUALITY_MIN}""")
def q_popularity_quality_corr(spark, sf):
    """AG-28."""
    return ex.popularity_quality_corr(_r(spark, sf), QUALITY_MIN)


_TOP_POP = """SELECT movieId, num_ratings, rating_sum FROM mt ORDER BY num_ratings DESC, movieId LIMIT 20"""
_TOP_Q = f"""SELECT movieId, num_ratings, rating_sum FROM mt WHERE num_ratings >= {QUALITY_MIN}
             ORDER BY rating_sum / num_ratings DESC, movieId LIMIT 20"""


@register("most_rated", with_tables("ratings", "movies", extra=_MT.split(",\ngstats")[0]) + f"""
SELECT t.movieId, m.title, t.num_ratings, round(t.rating_sum / t.num_ratings, 6) AS avg_rating
FROM ({_TOP_POP}) t LEFT JOIN movies m USING (movieId)""")
def q_most_rated(spark, sf):
    """TK-2 (TK-1)."""
    return ex.most_rated(_r(spark, sf), _m(spark, sf))


@register("best_rated", with_tables("ratings", "movies", extra=_MT.split(",\ngstats")[0]) + f"""
SELECT t.movieId, m.title, t.num_ratings, round(t.rating_sum / t.num_ratings, 6) AS avg_rating
FROM ({_TOP_Q}) t LEFT JOIN movies m USING (movieId)""")
def q_best_rated(spark, sf):
    """TK-3."""
    return ex.best_rated(_r(spark, sf), _m(spark, sf), min_n=QUALITY_MIN)


@register("topk_overlap", with_tables("ratings", extra=_MT.split(",\ngstats")[0]) + f"""
SELECT count(*) AS overlap FROM (SELECT movieId FROM ({_TOP_POP}) INTERSECT SELECT movieId FROM ({_TOP_Q}))""")
def q_topk_overlap(spark, sf):
    """ST-2: overlap of the most-rated and best-rated top-20 lists."""
    r, m = _r(spark, sf), _m(spark, sf)
    return ex.topk_overlap(ex.most_rated(r, m), ex.best_rated(r, m, min_n=QUALITY_MIN))


@register("tag_query_top", with_tables("genome_tags", "movies") + f"""
SELECT g.tag, s.movieId, m.title, round(CAST(s.relevance AS DOUBLE), 6) AS relevance
FROM (SELECT * FROM genome_scores WHERE tagId = (
        SELECT min(tagId) FROM genome_tags
        WHERE contains(trim(regexp_replace(lower(tag), '[-\\s]+', ' ', 'g')), '{TAG_QUERY}'))
      ORDER BY relevance DESC, movieId LIMIT 10) s
LEFT JOIN genome_tags g USING (tagId) LEFT JOIN movies m USING (movieId)""")
def q_tag_query_top(spark, sf):
    """TK-4 (FN-17, FN-19)."""
    return ex.tag_query_top(adapt.genome_scores(spark, sf), adapt.genome_tags(spark, sf), _m(spark, sf), TAG_QUERY)


_BY_N = """pu AS (SELECT userId, count(*) AS n FROM ratings GROUP BY userId),
bn AS (SELECT n, count(*) AS m FROM pu GROUP BY n)"""


@register("pareto_curve", with_tables("ratings", extra=_BY_N) + """
SELECT n AS activity, m AS entities,
       round(sum(m) OVER w * 100.0 / sum(m) OVER (), 6) AS pct_entities,
       round(sum(n * m) OVER w * 100.0 / sum(n * m) OVER (), 6) AS pct_ratings
FROM bn WINDOW w AS (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_pareto_curve(spark, sf):
    """WN-5."""
    return wn.pareto_curve(_r(spark, sf))


@register("users_for_share", with_tables("ratings") + """
SELECT CAST(count(*) AS BIGINT) AS users_for_share FROM (
  SELECT sum(n) OVER (ORDER BY n DESC, userId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1.0
         / sum(n) OVER () AS cum FROM (SELECT userId, count(*) AS n FROM ratings GROUP BY userId))
WHERE cum <= 0.8""")
def q_users_for_share(spark, sf):
    """WN-6: users whose cumulative share of ratings (most active first) stays <= 80 %."""
    return wn.users_for_share(_r(spark, sf), share=0.8)


@register("ratings_date_range", with_tables("ratings") + f"""
SELECT CAST(min({_TS}) AS DATE) AS first_date, CAST(max({_TS}) AS DATE) AS last_date FROM ratings""")
def q_ratings_date_range(spark, sf):
    """AG-30."""
    return ex.date_range(_r(spark, sf))


@register("movie_sample", with_tables("ratings", "movies", extra=_MT.split(",\ngstats")[0]) + f"""
SELECT movieId, num_ratings, rating_sum, rating_sum / num_ratings AS avg_rating, title
FROM mt LEFT JOIN movies USING (movieId) WHERE num_ratings >= {QUALITY_MIN}
ORDER BY md5(concat_ws(':', CAST(movieId AS VARCHAR), '42')), movieId LIMIT 50""")
def q_movie_sample(spark, sf):
    """SP-1: fixed-size seeded sample of the qualified movies (md5 order)."""
    t = ex.movie_quality(_r(spark, sf), _m(spark, sf)).where(F.col("num_ratings") >= QUALITY_MIN)
    return ex.sample_n(t, "movieId", 50, seed=42)


_PIVOT8 = ", ".join(f"max(CASE WHEN rk = {i} THEN genre END) AS genre_{i}, CAST(sum(CASE WHEN rk = {i} THEN \"count\" ELSE 0 END) AS BIGINT) AS count_{i}" for i in range(1, 9))


@register("genre_year_pivot", "WITH g8 AS (" + _GY8_SQL + f"""),
rk AS (SELECT genre, row_number() OVER (ORDER BY sum("count") DESC, genre) AS rk FROM g8 GROUP BY genre)
SELECT year, {_PIVOT8} FROM g8 JOIN rk USING (genre) GROUP BY year""")
def q_genre_year_pivot(spark, sf):
    """AG-19 wide: the top-8 genres by rank, a name and a count each."""
    return ex.genre_year_pivot(_r(spark, sf), _m(spark, sf), 8)


@register("movie_stats_refreshed", with_tables("ratings") + """
SELECT movieId, CAST(count(rating) AS INTEGER) AS total_ratings, round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating,
       round(coalesce(stddev_samp(CAST(rating AS DOUBLE)), 0), 6) AS rating_std,
       CAST(min(rating) AS DOUBLE) AS min_rating, CAST(max(rating) AS DOUBLE) AS max_rating
FROM ratings GROUP BY movieId""")
def q_movie_stats_refreshed(spark, sf):
    """AG-3 kept up to date: the ratings come in two parts by time, the second is added to the written
    partials of the first, and the statistics come from the partials alone."""
    ratings, path = adapt.ratings(spark, sf), f"{ensure_checkpoint_dir(spark)}/partials-{uuid.uuid4().hex[:16]}"
    cut = ratings.agg(F.avg("timestamp")).first()[0]
    partials.add_days(ratings.where(F.col("timestamp") < cut), path, "movieId", "userId", "first")
    partials.add_days(ratings.where(F.col("timestamp") >= cut), path, "movieId", "userId", "second")
    return partials.merged(spark, path, "movieId").select(
        "movieId", "total_ratings", F.round("avg_rating", 6).alias("avg_rating"), F.round("rating_std", 6).alias("rating_std"), "min_rating", "max_rating")


_PER_USER = "(SELECT CAST(count(*) AS DOUBLE) AS n FROM ratings GROUP BY userId)"


@register("user_activity_quantiles", with_tables("ratings") + " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS p, quantile_cont(n, {p}) AS ratings_per_user FROM {_PER_USER}" for p in (0.25, 0.5, 0.9)))
def q_user_activity_quantiles(spark, sf):
    """AG-10/AG-25: exact quantiles of the ratings per user, each selected without a sort of the users."""
    n = cut_lineage(adapt.ratings(spark, sf).groupBy("userId").agg(F.count(F.lit(1)).alias("n")), "activity")
    found = [(p, exact_quantile(n, "n", p)) for p in (0.25, 0.5, 0.9)]
    return spark.createDataFrame(found, "p double, ratings_per_user double")
