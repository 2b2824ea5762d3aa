"""Streaming queries: each runs its stream to the end of the input, then returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsift.queries import register
from reelsift.queries.features import _GW_SQL, SEG_CASUAL, SEG_REGULAR
from reelsift.queries.sql import with_tables
from reelsift.streaming import jobs as ss
from reelsift.functions.labels import segment_label


@register("stream_event_weeks", with_tables("ev") + """
SELECT event_type AS genre, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS event_count,
       round(sum(value), 6) AS value_sum FROM ev GROUP BY ALL""")
def q_stream_event_weeks(spark, sf):
    """SS-1: watermarked weekly event-time windows per event type (update mode, keyed sink)."""
    out = ss.scratch(spark, "event_weeks")
    ss.run_available(ss.stream_genre_week(ss.events_stream(spark, sf)), out, keys=["genre", "week_start"])
    d = ss.current(spark, out, ["genre", "week_start"])
    return d.select("genre", "week_start", "event_count", F.round("value_sum", 6).alias("value_sum"))


@register("stream_genre_week_counts", _GW_SQL)
def q_stream_genre_week_counts(spark, sf):
    """SS-1 on ratings: watermarked weekly windows per genre (update mode) equal to AG-6."""
    from reelsift import adapt
    from reelsift.operators.explore import explode_genres
    out = ss.scratch(spark, "genre_week")
    pairs = explode_genres(adapt.movies(spark, sf))
    ss.run_available(ss.stream_genre_week_ratings(ss.ratings_stream(spark, sf), pairs), out, keys=["genre", "week_start"])
    return ss.current(spark, out, ["genre", "week_start"])


@register("stream_user_stats", with_tables("ratings") + """
SELECT userId, CAST(count(*) AS INTEGER) AS total_ratings,
       round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating,
       round(coalesce(stddev_samp(CAST(rating AS DOUBLE)), 0), 6) AS rating_std,
       CAST(min(rating) AS DOUBLE) AS min_rating, CAST(max(rating) AS DOUBLE) AS max_rating,
       round(avg(CASE WHEN rating >= 4.0 THEN 1.0 ELSE 0.0 END), 6) AS avg_reward
FROM ratings GROUP BY userId""")
def q_stream_user_stats(spark, sf):
    """SS-2: running user statistics (update mode) equal to the batch AG-1."""
    out = ss.scratch(spark, "user_stats")
    ss.run_available(ss.stream_user_stats(ss.ratings_stream(spark, sf)), out, keys=["userId"])
    d = ss.current(spark, out, ["userId"])
    return d.select("userId", "total_ratings", F.round("avg_rating", 6).alias("avg_rating"),
                    F.round("rating_std", 6).alias("rating_std"), "min_rating", "max_rating",
                    F.round("avg_reward", 6).alias("avg_reward"))


@register("stream_recent_items", with_tables("ratings", extra="""rk AS (SELECT userId, movieId,
       row_number() OVER (PARTITION BY userId ORDER BY "timestamp" DESC, movieId DESC) AS r FROM ratings)""") + """
SELECT userId,
       max(CASE WHEN r = 1 THEN movieId END) AS recent_movie_1, max(CASE WHEN r = 2 THEN movieId END) AS recent_movie_2,
       max(CASE WHEN r = 3 THEN movieId END) AS recent_movie_3, max(CASE WHEN r = 4 THEN movieId END) AS recent_movie_4,
       max(CASE WHEN r = 5 THEN movieId END) AS recent_movie_5
FROM rk WHERE r <= 5 GROUP BY userId""")
def q_stream_recent_items(spark, sf):
    """SS-3: newest items per user, kept batch by batch, equal to the batch WN-3."""
    out = ss.scratch(spark, "recent_items")
    ss.run_recent_items(ss.ratings_stream(spark, sf), out)
    return ss.recent_items_now(spark, out)


@register("stream_interaction_log", with_tables("ratings") + f"""
SELECT r.userId, r.movieId, r.rating, r."timestamp",
       CAST(CASE WHEN r.rating >= 4.0 THEN 1 ELSE 0 END AS TINYINT) AS reward,
       CASE WHEN c.n <= {SEG_CASUAL} THEN 'casual' WHEN c.n <= {SEG_REGULAR} THEN 'regular' ELSE 'power' END AS user_segment
FROM ratings r LEFT JOIN (SELECT userId, count(*) AS n FROM ratings GROUP BY userId) c USING (userId)""")
def q_stream_interaction_log(spark, sf):
    """SS-4: stream-static left join with the user segments, appended to parquet."""
    from reelsift import adapt
    seg = (adapt.ratings(spark, sf).groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
           .select("userId", segment_label("n", SEG_CASUAL, SEG_REGULAR).alias("user_segment")))
    out = ss.scratch(spark, "interaction_log")
    ss.run_available(ss.stream_interaction_log(ss.ratings_stream(spark, sf), seg), out, mode="append")
    return spark.read.parquet(out + "/data").select("userId", "movieId", "rating", "timestamp", "reward", "user_segment")


@register("stream_dedup", with_tables("ratings") + """
SELECT DISTINCT * FROM (SELECT * FROM ratings UNION ALL SELECT * FROM ratings WHERE rating = 5.0)""")
def q_stream_dedup(spark, sf):
    """SS-5: duplicates dropped within the watermark (here the 5.0 ratings arrive twice)."""
    r = ss.ratings_stream(spark, sf)
    raw = r.unionByName(r.where(F.col("rating") == 5.0))
    out = ss.scratch(spark, "dedup")
    ss.run_available(ss.stream_dedup(raw), out, mode="append")
    return spark.read.parquet(out + "/data")


@register("stream_dedup_late", with_tables("ratings", extra="""rb AS (SELECT *, movieId % 3 AS batch FROM ratings),
nb AS (SELECT batch, (SELECT max("timestamp") FROM rb p WHERE p.batch < b.batch) AS newest FROM (SELECT DISTINCT batch FROM rb) b)""") + """
SELECT DISTINCT userId, movieId, rating, "timestamp", coalesce("timestamp" < newest - 30 * 86400, false) AS late FROM rb JOIN nb USING (batch)""")
def q_stream_dedup_late(spark, sf):
    """SS-5 over three micro-batches out of order (by movie): distinct ratings, late ones in a table of
    their own; here the 5.0 ratings come twice. A batch is a folder of files that all tasks write; the
    stream is run to the end of its input after each, and goes on from its checkpoint."""
    from reelsift import adapt
    r, base = adapt.ratings(spark, sf), ss.scratch(spark, "dedup_late")
    for i in range(3):
        own = r.where(F.col("movieId") % 3 == i)
        own.unionByName(own.where(F.col("rating") == 5.0)).write.parquet(f"{base}/in/{i}")
        ss.run_dedup(spark.readStream.schema(r.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in"), base)
    return ss.dedup_rows_now(spark, base)
