"""Source/sink queries: typed CSV round trips, parquet counts, summary and output report."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.plans import features as pf
from reelsift.plans import reconcile as rc
from reelsift.queries import register
from reelsift.queries.features import FORECAST_SQL, SEG_CASUAL, SEG_REGULAR
from reelsift.queries.reconcile import _MERGE_SQL
from reelsift.queries.sql import with_tables
from reelsift.sources import readers as rd
from reelsift.sources import sinks as sk
from reelsift.streaming.jobs import scratch


@register("csv_roundtrip_ratings", with_tables("ratings") + "SELECT * FROM ratings")
def q_csv_roundtrip_ratings(spark, sf):
    """SNK-1 + SRC-1 (SRC-13 splits): ratings written as CSV and read back with the schema."""
    path = scratch(spark, "ratings_csv")
    sk.write_csv(adapt.ratings(spark, sf), path)
    return rd.read_ratings(spark, path)


def _through_csv(spark, df, name, read):
    path = scratch(spark, name)
    sk.write_csv(df, path)
    return read(spark, path)


def _combined(spark, sf):
    """Both tables of the merge, written as CSV and read back."""
    movies, ratings = rc.merge_sources(adapt.movies(spark, sf), adapt.ratings(spark, sf), adapt.second_movies(spark, sf),
                                       adapt.second_ratings(spark, sf))[:2]
    mp, rp = scratch(spark, "combined_movies"), scratch(spark, "combined_ratings")
    sk.write_csv(movies, mp)
    sk.write_csv(ratings, rp)
    return rd.read_combined(spark, mp, rp)


@register("csv_roundtrip_combined_movies", _MERGE_SQL + "SELECT * FROM cm")
def q_csv_roundtrip_combined_movies(spark, sf):
    """SNK-1 + SRC-8: merged catalogue through CSV (quoted text, booleans)."""
    return _combined(spark, sf)[0]


@register("csv_roundtrip_combined_ratings", _MERGE_SQL + "SELECT * FROM cr")
def q_csv_roundtrip_combined_ratings(spark, sf):
    """SNK-1 + SRC-8: merged ratings of both sources through CSV."""
    return _combined(spark, sf)[1]


def _second(spark, sf, columns=None):
    mp, rp = scratch(spark, "movies2"), scratch(spark, "ratings2")
    sk.write_csv(adapt.second_movies(spark, sf), mp)
    sk.write_csv(adapt.second_ratings(spark, sf), rp)
    return rd.read_second_catalog(spark, mp, rp, columns=columns)


@register("csv_roundtrip_second_catalog", with_tables("movies2") +
          "SELECT movieId, title, nullif(release_date, '') AS release_date FROM movies2")
def q_csv_roundtrip_second_catalog(spark, sf):
    """SNK-1 + SRC-7: second catalogue through CSV, pruned to three columns at read (an empty
    field reads back as null)."""
    return _second(spark, sf, ["movieId", "title", "release_date"])[0]


@register("csv_roundtrip_second_ratings", with_tables("ratings2") + "SELECT * FROM ratings2")
def q_csv_roundtrip_second_ratings(spark, sf):
    """SNK-1 + SRC-7: second-source ratings through CSV."""
    return _second(spark, sf)[1]


@register("csv_roundtrip_titles", """
SELECT CAST(p_partkey AS INTEGER) AS movieId,
       CASE p_partkey % 6 WHEN 0 THEN 'He said "' || p_name || '", ok (1999)' WHEN 1 THEN '  ' || p_name || ' (2000) '
            WHEN 2 THEN p_name || ' \\' WHEN 3 THEN p_name || chr(10) || 'second line, The (2001)'
            WHEN 4 THEN '"' || p_name || '"' ELSE 'a\\"b, ' || p_name END AS title,
       replace(p_name, ' ', '|') AS genres
FROM part""")
def q_csv_roundtrip_titles(spark, sf):
    """SNK-1 + SRC-2: titles with quotes, commas, backslashes, outer spaces and line breaks."""
    m, name, k = adapt.movies(spark, sf), F.substring_index("title", " (", 1), F.pmod("movieId", F.lit(6))
    odd = (F.when(k == 0, F.concat(F.lit('He said "'), name, F.lit('", ok (1999)'))).when(k == 1, F.concat(F.lit("  "), name, F.lit(" (2000) ")))
           .when(k == 2, F.concat(name, F.lit(" \\"))).when(k == 3, F.concat(name, F.lit("\nsecond line, The (2001)")))
           .when(k == 4, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.concat(F.lit('a\\"b, '), name)))
    return _through_csv(spark, m.withColumn("title", odd), "titles", rd.read_movies)


@register("csv_roundtrip_tags", with_tables("tags") + "SELECT * FROM tags")
def q_csv_roundtrip_tags(spark, sf):
    """SNK-1 + SRC-3."""
    return _through_csv(spark, adapt.tags(spark, sf), "tags", rd.read_tags)


@register("csv_roundtrip_links", with_tables("links") + "SELECT * FROM links")
def q_csv_roundtrip_links(spark, sf):
    """SNK-1 + SRC-4 (null tmdb ids)."""
    return _through_csv(spark, adapt.links(spark, sf), "links", rd.read_links)


@register("csv_roundtrip_genome_scores", with_tables("genome_scores") + "SELECT * FROM genome_scores")
def q_csv_roundtrip_genome_scores(spark, sf):
    """SNK-1 + SRC-5."""
    return _through_csv(spark, adapt.genome_scores(spark, sf), "genome_scores", rd.read_genome_scores)


@register("csv_roundtrip_genome_tags", with_tables("genome_tags") + "SELECT * FROM genome_tags")
def q_csv_roundtrip_genome_tags(spark, sf):
    """SNK-1 + SRC-6."""
    return _through_csv(spark, adapt.genome_tags(spark, sf), "genome_tags", rd.read_genome_tags)


@register("csv_roundtrip_forecasting", FORECAST_SQL)
def q_csv_roundtrip_forecasting(spark, sf):
    """SNK-1 + SRC-9: forecasting features through CSV with a typed date column."""
    path = scratch(spark, "forecasting_csv")
    sk.write_csv(pf.forecasting_features(adapt.ratings(spark, sf), adapt.movies(spark, sf)), path)
    return rd.read_forecasting(spark, path)


@register("interaction_log_parquet_count", with_tables("ratings") + "SELECT count(*) AS rows FROM ratings")
def q_interaction_log_parquet_count(spark, sf):
    """SNK-3 + SRC-12 + SRC-10: interaction log written in bounded files, counted from footers."""
    path = scratch(spark, "interaction_log")
    log = pf.interaction_log_from_ratings(adapt.ratings(spark, sf), casual_max=SEG_CASUAL, regular_max=SEG_REGULAR)
    sk.write_parquet(log, path, max_records_per_file=20000)
    n = rd.parquet_row_count(spark, path)
    return rd.read_features(spark, path, ["userId"]).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") == n)


@register("ingest_summary", with_tables("ratings", "movies", "tags") + """
SELECT 'ratings_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM ratings
UNION ALL SELECT 'ratings_columns', '4'
UNION ALL SELECT 'movies_rows', CAST(count(*) AS VARCHAR) FROM movies
UNION ALL SELECT 'movies_columns', '3'
UNION ALL SELECT 'tags_rows', CAST(count(*) AS VARCHAR) FROM tags
UNION ALL SELECT 'tags_columns', '4'
UNION ALL SELECT 'first_rating_date', CAST(CAST(make_timestamp(min("timestamp") * 1000000) AS DATE) AS VARCHAR) FROM ratings
UNION ALL SELECT 'last_rating_date', CAST(CAST(make_timestamp(max("timestamp") * 1000000) AS DATE) AS VARCHAR) FROM ratings
UNION ALL SELECT 'unique_users', CAST(count(DISTINCT userId) AS VARCHAR) FROM ratings
UNION ALL SELECT 'unique_movies', CAST(count(DISTINCT movieId) AS VARCHAR) FROM ratings""")
def q_ingest_summary(spark, sf):
    """SNK-5: ingest summary as (metric, value) rows."""
    return sk.summary(adapt.ratings(spark, sf), adapt.movies(spark, sf), adapt.tags(spark, sf))


@register("output_report", "WITH ff AS (" + FORECAST_SQL + ")," + with_tables("ratings").replace("WITH ", "") + """
SELECT 'forecasting_features' AS output, count(*) AS rows, 10 AS columns, min(week_start) AS min_date,
       max(week_start) AS max_date FROM ff
UNION ALL SELECT 'rl_features', count(*), 6, CAST(make_timestamp(min("timestamp") * 1000000) AS DATE),
       CAST(make_timestamp(max("timestamp") * 1000000) AS DATE) FROM ratings""")
def q_output_report(spark, sf):
    """SNK-6 + SNK-2: written outputs with rows, columns and date range (bytes are in
    ``output_report_bytes``)."""
    r, m = adapt.ratings(spark, sf), adapt.movies(spark, sf)
    fp, lp = scratch(spark, "forecasting"), scratch(spark, "rl_features")
    sk.write_parquet(pf.forecasting_features(r, m), fp)
    sk.write_parquet(pf.interaction_log_from_ratings(r, casual_max=SEG_CASUAL, regular_max=SEG_REGULAR), lp)
    rep = sk.output_report(spark, {"forecasting_features": fp, "rl_features": lp},
                           date_cols={"forecasting_features": "week_start"}, epoch_cols={"rl_features": "timestamp"})
    return rep.drop("bytes")


@register("output_report_bytes")
def q_output_report_bytes(spark, sf):
    """SNK-6: bytes on disk per output (file metadata), with the row counts."""
    r = adapt.ratings(spark, sf)
    lp = scratch(spark, "rl_features")
    sk.write_parquet(pf.interaction_log_from_ratings(r, casual_max=SEG_CASUAL, regular_max=SEG_REGULAR), lp,
                     max_records_per_file=20000)
    return sk.output_report(spark, {"rl_features": lp}, epoch_cols={"rl_features": "timestamp"})
