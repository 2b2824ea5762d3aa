"""Schemas of record for the domain tables (always passed to readers; no inference)."""

from pyspark.sql import types as T

RATINGS = T.StructType([
    T.StructField("userId", T.IntegerType()),
    T.StructField("movieId", T.IntegerType()),
    T.StructField("rating", T.FloatType()),
    T.StructField("timestamp", T.LongType()),
])

MOVIES = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])

TAGS = T.StructType([
    T.StructField("userId", T.IntegerType()),
    T.StructField("movieId", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])

LINKS = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("imdbId", T.IntegerType()),
    T.StructField("tmdbId", T.LongType()),
])

GENOME_SCORES = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("tagId", T.ShortType()),
    T.StructField("relevance", T.FloatType()),
])

GENOME_TAGS = T.StructType([
    T.StructField("tagId", T.ShortType()),
    T.StructField("tag", T.StringType()),
])

SECOND_MOVIES = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("popularity", T.DoubleType()),
    T.StructField("vote_average", T.DoubleType()),
    T.StructField("vote_count", T.IntegerType()),
])

COMBINED_MOVIES = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
    T.StructField("is_duplicate_title_year", T.BooleanType()),
    T.StructField("source", T.StringType()),
])

COMBINED_RATINGS = T.StructType(RATINGS.fields + [T.StructField("source", T.StringType())])

CATALOG_RESULT = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("genre_ids", T.ArrayType(T.IntegerType())),
    T.StructField("release_date", T.StringType()),
    T.StructField("popularity", T.DoubleType()),
    T.StructField("vote_average", T.DoubleType()),
    T.StructField("vote_count", T.IntegerType()),
])

CATALOG_PAGE = T.StructType([
    T.StructField("results", T.ArrayType(CATALOG_RESULT)),
])

GENRE_LIST = T.StructType([
    T.StructField("genres", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
    ]))),
])

FORECASTING = T.StructType([
    T.StructField("genre", T.StringType()),
    T.StructField("week_start", T.DateType()),
    T.StructField("rating_count", T.IntegerType()),
    T.StructField("avg_rating", T.DoubleType()),
    T.StructField("lag_1", T.DoubleType()),
    T.StructField("lag_2", T.DoubleType()),
    T.StructField("lag_3", T.DoubleType()),
    T.StructField("rolling_3week_avg", T.DoubleType()),
    T.StructField("rolling_6week_avg", T.DoubleType()),
    T.StructField("is_synthetic", T.IntegerType()),
])
