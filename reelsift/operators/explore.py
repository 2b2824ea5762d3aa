"""Exploratory aggregates (distributions, concentration, genres, time, tags, genome, top-k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reelsift.functions.dates import epoch_to_ts, in_range, month_start
from reelsift.functions.labels import pct
from reelsift.functions.text import GENRE_SENTINEL, contains_literal, normalize_tag, tag_clean
from reelsift.operators.quantiles import exact_quantile

# Fixed values of the reference analysis.
LONG_TAIL = 10
BLOCKBUSTER = 10000
QUALITY_MIN_RATINGS = 1000
TOP_K = 20
PERIOD_BOUNDS = ("2018-01-01", "2020-03-01", "2022-01-01")
HIST_BINS = 50


def explode_genres(movies: DataFrame, sentinel: str = GENRE_SENTINEL) -> DataFrame:
    """FN-4: (movieId, genre) per listed genre; the sentinel and null genres give no rows."""
    return (movies.where(~F.col("genres").eqNullSafe(F.lit(sentinel)))
            .select("movieId", F.explode(F.split(F.col("genres"), r"\|")).alias("genre")))


def distinct_ids(df: DataFrame, key: str):
    """Scalar subquery: how many distinct non-null values ``key`` has (combined before the shuffle)."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()


def _days_between(lo, hi):
    return F.floor((hi - lo) / F.lit(86400))


def dataset_overview(ratings: DataFrame, movies: DataFrame, tags: DataFrame,
                     genome_scores: DataFrame, genome_tags: DataFrame) -> DataFrame:
    """AG-7: one typed row of corpus metrics. Totals and distinct ids of each table are aggregates of
    their own (two distinct counts in one would expand every row); the one-row results are combined
    as scalar subqueries (no cross join)."""
    one = ratings.sparkSession.range(1)

    def totals(df):
        a = df.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
        return {**{c: a.select(c).scalar() for c in ("n", "lo", "hi")}, "u": distinct_ids(df, "userId"), "m": distinct_ids(df, "movieId")}

    rs, ts = totals(ratings), totals(tags)
    return one.select(
        rs["n"].alias("total_ratings"),
        F.to_date(epoch_to_ts(rs["lo"])).alias("ratings_first_date"),
        F.to_date(epoch_to_ts(rs["hi"])).alias("ratings_last_date"),
        F.round(_days_between(rs["lo"], rs["hi"]) / 365.25, 6).alias("span_years"),
        rs["u"].alias("unique_users"),
        movies.agg(F.count(F.lit(1))).scalar().alias("movies_in_catalog"),
        rs["m"].alias("movies_rated"),
        ts["n"].alias("tag_applications"),
        F.to_date(epoch_to_ts(ts["lo"])).alias("tags_first_date"),
        F.to_date(epoch_to_ts(ts["hi"])).alias("tags_last_date"),
        ts["u"].alias("tag_users"),
        ts["m"].alias("tagged_movies"),
        genome_scores.agg(F.count_distinct("movieId")).scalar().alias("genome_movies"),
        genome_tags.agg(F.count(F.lit(1))).scalar().alias("genome_tag_vocabulary"),
        F.round(rs["n"] / rs["u"], 6).alias("avg_ratings_per_user"),
        F.round(rs["n"] / rs["m"], 6).alias("avg_ratings_per_movie"),
    ).drop("id")


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """AG-8: count per rating value."""
    return (ratings.groupBy(F.col("rating").cast("double").alias("rating"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("rating"))


def rating_summary(ratings: DataFrame, above: float = 3.0) -> DataFrame:
    """AG-9: mean, interpolated median, mode (smallest on ties), % above ``above``."""
    r = F.col("rating").cast("double")
    return ratings.agg(
        F.round(F.avg(r), 6).alias("mean_rating"),
        F.median(r).alias("median_rating"),
        F.mode(r, True).alias("mode_rating"),
        F.round(F.avg((r > above).cast("double")) * 100, 6).alias("pct_above"))


def _per_key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def per_user_activity(ratings: DataFrame) -> DataFrame:
    """AG-10: users, median and max ratings per user."""
    return _per_key_counts(ratings, "userId").agg(
        F.count(F.lit(1)).alias("users"),
        F.median(F.col("n").cast("double")).alias("median_per_user"),
        F.max("n").alias("max_per_user"))


def per_movie_popularity(ratings: DataFrame, long_tail: int = LONG_TAIL,
                         blockbuster: int = BLOCKBUSTER) -> DataFrame:
    """AG-11: rated movies, median, max, long-tail count and share, blockbuster count."""
    c = _per_key_counts(ratings, "movieId")
    return c.agg(
        F.count(F.lit(1)).alias("movies"),
        F.median(F.col("n").cast("double")).alias("median_per_movie"),
        F.max("n").alias("max_per_movie"),
        F.count_if(F.col("n") < long_tail).alias("n_long_tail"),
        F.round(pct(F.count_if(F.col("n") < long_tail), F.count(F.lit(1))), 6).alias("pct_long_tail"),
        F.count_if(F.col("n") >= blockbuster).alias("n_blockbuster"))


def genre_movie_counts(movies: DataFrame) -> DataFrame:
    """AG-12: distinct movies per genre."""
    return (explode_genres(movies).groupBy("genre")
            .agg(F.count_distinct("movieId").alias("num_movies")))


def movie_totals(ratings: DataFrame) -> DataFrame:
    """Per-movie count and rating sum: the pre-aggregate for every genre fan-out."""
    return ratings.groupBy("movieId").agg(F.count(F.lit(1)).alias("num_ratings"),
                                          F.sum(F.col("rating").cast("double")).alias("rating_sum"))


def genre_rating_stats(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """AG-13: per genre total ratings, rating sum, rated movies, volume-weighted mean.
    Ratings are aggregated per movie before the genre fan-out."""
    pairs = explode_genres(movies)
    return (movie_totals(ratings).join(pairs, "movieId")
            .groupBy("genre")
            .agg(F.sum("num_ratings").alias("total_ratings"),
                 F.round(F.sum("rating_sum"), 6).alias("rating_sum"),
                 F.count_distinct("movieId").alias("num_movies"),
                 F.round(F.sum("rating_sum") / F.sum("num_ratings"), 6).alias("avg_rating")))


def monthly_volume(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """AG-14 / AG-22: rows per calendar month (gaps not filled)."""
    return df.groupBy(month_start(ts).alias("month")).agg(F.count(F.lit(1)).alias("count"))


def yearly_avg_rating(ratings: DataFrame) -> DataFrame:
    """AG-15: mean rating per year."""
    return (ratings.groupBy(F.year(epoch_to_ts("timestamp")).alias("year"))
            .agg(F.round(F.avg(F.col("rating").cast("double")), 6).alias("avg_rating")))


def peak_month(ratings: DataFrame) -> DataFrame:
    """AG-16: busiest month (earliest on ties) and its count."""
    return monthly_volume(ratings).agg(
        F.min_by("month", F.struct((-F.col("count")).alias("k"), F.col("month").alias("m"))).alias("month"),
        F.max("count").alias("count"))


def period_comparison(ratings: DataFrame, bounds=PERIOD_BOUNDS) -> DataFrame:
    """AG-17: mean monthly volume in [b0,b1), [b1,b2), [b2,inf) and % change vs the first."""
    b0, b1, b2 = bounds
    mv = monthly_volume(ratings)
    out = mv.agg(
        F.avg(F.when(in_range("month", b0, b1), F.col("count"))).alias("first_period"),
        F.avg(F.when(in_range("month", b1, b2), F.col("count"))).alias("second_period"),
        F.avg(F.when(F.col("month") >= F.lit(b2).cast("date"), F.col("count"))).alias("third_period"))
    return out.select(
        *[F.round(c, 6).alias(c) for c in ("first_period", "second_period", "third_period")],
        F.round(F.try_divide(F.col("second_period"), F.col("first_period")) * 100 - 100, 6).alias("second_vs_first_pct"),
        F.round(F.try_divide(F.col("third_period"), F.col("first_period")) * 100 - 100, 6).alias("third_vs_first_pct"))


def genre_year_counts(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """AG-18: counts per (movie, year) first, then the genre fan-out, then per (year, genre)."""
    my = ratings.groupBy("movieId", F.year(epoch_to_ts("timestamp")).alias("year")) \
                .agg(F.count(F.lit(1)).alias("n"))
    return (my.join(explode_genres(movies), "movieId")
            .groupBy("year", "genre").agg(F.sum("n").alias("count")))


def genre_year_pivot(ratings: DataFrame, movies: DataFrame, k: int = 8) -> DataFrame:
    """AG-19: years x the k genres with the most ratings (ties by name), missing -> 0. The columns
    are ``year`` and, by rank, ``genre_1``, ``count_1``, ..., so they do not depend on the data; a
    rank without a genre is null with count 0."""
    top = (genre_rating_stats(ratings, movies).orderBy(F.col("total_ratings").desc(), "genre").limit(k)
           .select("genre", F.row_number().over(Window.orderBy(F.col("total_ratings").desc(), "genre")).alias("_rank")))
    names = top.agg(*[F.max(F.when(F.col("_rank") == i, F.col("genre"))).alias(f"genre_{i}") for i in range(1, k + 1)])
    wide = (genre_year_counts(ratings, movies).join(F.broadcast(top), "genre")  # k rows
            .groupBy("year").agg(*[F.coalesce(F.sum(F.when(F.col("_rank") == i, F.col("count"))), F.lit(0)).alias(f"count_{i}")
                                   for i in range(1, k + 1)]))
    return wide.select("year", *[c for i in range(1, k + 1) for c in (names.select(f"genre_{i}").scalar().alias(f"genre_{i}"), F.col(f"count_{i}"))])


def genre_year_top_long(ratings: DataFrame, movies: DataFrame, k: int = 8) -> DataFrame:
    """AG-19 in long form: (year, genre, count) over the pivot's full grid."""
    pairs = F.array(*[F.struct(F.col(f"genre_{i}").alias("genre"), F.col(f"count_{i}").alias("count")) for i in range(1, k + 1)])
    return (genre_year_pivot(ratings, movies, k).select("year", F.explode(pairs).alias("p"))
            .select("year", "p.genre", "p.count").where(F.col("genre").isNotNull()))


def genre_trend_change(ratings: DataFrame, movies: DataFrame, n_years: int = 3) -> DataFrame:
    """AG-20: mean yearly share of each genre in the first vs last ``n_years`` years (mean
    over the years where the genre appears), change in percentage points, genres present
    in both windows only."""
    from reelsift.operators.windows import share_of_total
    gy = share_of_total(genre_year_counts(ratings, movies), "year", "count")
    years = gy.select("year").distinct()
    yr = years.select("year",
                      F.row_number().over(Window.orderBy("year")).alias("asc_r"),
                      F.row_number().over(Window.orderBy(F.col("year").desc())).alias("desc_r"))
    j = gy.join(F.broadcast(yr), "year")
    agg = j.groupBy("genre").agg(
        F.avg(F.when(F.col("asc_r") <= n_years, F.col("share"))).alias("early_share"),
        F.avg(F.when(F.col("desc_r") <= n_years, F.col("share"))).alias("recent_share"))
    agg = agg.where(F.col("early_share").isNotNull() & F.col("recent_share").isNotNull())
    return agg.select("genre", F.round("early_share", 6).alias("early_share"),
                      F.round("recent_share", 6).alias("recent_share"),
                      F.round((F.col("recent_share") - F.col("early_share")) * 100, 6).alias("change_pp"))


def top_tags(tags: DataFrame, k: int = TOP_K) -> DataFrame:
    """AG-21: most frequent stripped, lower-cased tags (ties by tag)."""
    t = tags.where(F.col("tag").isNotNull()).select(tag_clean("tag").alias("tag"))
    return (t.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "tag").limit(k))


def monthly_tag_volume(tags: DataFrame) -> DataFrame:
    """AG-22."""
    return monthly_volume(tags.where(F.col("tag").isNotNull()))


def movie_tag_counts(tags: DataFrame, movies: DataFrame, k: int = TOP_K) -> DataFrame:
    """AG-23: most tagged movies with titles (ties by movieId)."""
    top = (tags.where(F.col("tag").isNotNull()).groupBy("movieId")
           .agg(F.count(F.lit(1)).alias("num_tags"))
           .orderBy(F.col("num_tags").desc(), "movieId").limit(k))
    return top.join(movies.select("movieId", "title"), "movieId", "left")


def tag_relevance_mean(genome_scores: DataFrame, genome_tags: DataFrame, k: int = TOP_K) -> DataFrame:
    """AG-24: mean relevance per genome tag with its name, top k (ties by tagId)."""
    top = (genome_scores.groupBy("tagId")
           .agg(F.round(F.avg(F.col("relevance").cast("double")), 6).alias("relevance"))
           .orderBy(F.col("relevance").desc(), "tagId").limit(k))
    return top.join(genome_tags, "tagId", "left")


def relevance_summary(genome_scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AG-25: mean, median, % of pairs with relevance >= threshold. Relevance takes about as many values
    as there are pairs, so the median is selected by ``exact_quantile`` while the query is built."""
    r = F.col("relevance").cast("double")
    median = exact_quantile(genome_scores, r)
    return genome_scores.agg(F.round(F.avg(r), 6).alias("mean_relevance"),
                             F.round(F.lit(median).cast("double"), 6).alias("median_relevance"),
                             F.round(F.avg((r >= threshold).cast("double")) * 100, 6).alias("pct_relevant"))


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS, log: bool = False) -> DataFrame:
    """AG-26: equal-width bins between min and max (last bin closed, so the max lands in
    bin ``bins - 1``); ``log=True`` bins log10 of positive values."""
    x = F.log10(F.col(col).cast("double")) if log else F.col(col).cast("double")
    v = df.select(x.alias("x")).where(F.col("x").isNotNull())
    lo = v.agg(F.min("x")).scalar()
    hi = v.agg(F.max("x")).scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))).cast("int")
    return (v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", F.round(lo + F.col("bin") * width, 6).alias("bin_lo"),
                    F.round(lo + (F.col("bin") + 1) * width, 6).alias("bin_hi"), "count"))


def matrix_sparsity(ratings: DataFrame) -> DataFrame:
    """AG-27: users x movies, observed entries, sparsity and density (%)."""
    a = ratings.agg(F.count(F.lit(1)).alias("observed")).select(
        distinct_ids(ratings, "userId").alias("users"), distinct_ids(ratings, "movieId").alias("movies"), "observed")
    possible = F.col("users").cast("long") * F.col("movies").cast("long")
    return a.select("users", "movies", possible.alias("possible"), "observed",
                    F.round((1 - F.col("observed") / possible) * 100, 6).alias("sparsity_pct"),
                    F.round(F.col("observed") / possible * 100, 6).alias("density_pct"))


def movie_quality(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    t = movie_totals(ratings).withColumn("avg_rating", F.col("rating_sum") / F.col("num_ratings"))
    return t.join(movies.select("movieId", "title"), "movieId", "left")


def popularity_quality_corr(ratings: DataFrame, min_n: int = QUALITY_MIN_RATINGS) -> DataFrame:
    """AG-28: Pearson corr(num_ratings, avg_rating) among movies with >= min_n ratings."""
    t = movie_totals(ratings).where(F.col("num_ratings") >= min_n)
    return t.agg(F.count(F.lit(1)).alias("qualified"),
                 F.round(F.corr(F.col("num_ratings").cast("double"),
                                F.col("rating_sum") / F.col("num_ratings")), 6).alias("corr"))


def top_k(df: DataFrame, by, k: int, tie=None) -> DataFrame:
    """TK-1: sort + limit (planned as TakeOrderedAndProject, no full sort)."""
    order = list(by) + (list(tie) if tie else [])
    return df.orderBy(*order).limit(k)


def preview(df: DataFrame, order, n: int = 5) -> DataFrame:
    """TK-5: the first n rows in a stated order (a deterministic ``head``)."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*order).limit(n)


def most_rated(ratings: DataFrame, movies: DataFrame, k: int = TOP_K) -> DataFrame:
    """TK-2: k most-rated movies (ties by movieId) with titles and mean rating."""
    t = movie_totals(ratings)
    top = top_k(t, [F.col("num_ratings").desc()], k, ["movieId"])
    return top.join(movies.select("movieId", "title"), "movieId", "left").select(
        "movieId", "title", "num_ratings", F.round(F.col("rating_sum") / F.col("num_ratings"), 6).alias("avg_rating"))


def best_rated(ratings: DataFrame, movies: DataFrame, k: int = TOP_K,
               min_n: int = QUALITY_MIN_RATINGS) -> DataFrame:
    """TK-3: k best mean ratings among movies with >= min_n ratings (ties by movieId)."""
    t = movie_totals(ratings).where(F.col("num_ratings") >= min_n) \
        .withColumn("avg_rating", F.col("rating_sum") / F.col("num_ratings"))
    top = top_k(t, [F.col("avg_rating").desc()], k, ["movieId"])
    return top.join(movies.select("movieId", "title"), "movieId", "left").select(
        "movieId", "title", "num_ratings", F.round("avg_rating", 6).alias("avg_rating"))


def tag_query_top(genome_scores: DataFrame, genome_tags: DataFrame, movies: DataFrame,
                  query: str, k: int = 10) -> DataFrame:
    """TK-4: first genome tag (by tagId) whose normalised name contains ``query`` -> its k
    most relevant movies with titles; no match -> empty."""
    match = (genome_tags.where(contains_literal(normalize_tag("tag"), query))
             .agg(F.min("tagId").alias("tagId")).where(F.col("tagId").isNotNull()))
    scores = genome_scores.join(F.broadcast(match), "tagId")
    top = top_k(scores, [F.col("relevance").desc()], k, ["movieId"])
    return (top.join(genome_tags.select("tagId", "tag"), "tagId", "left")
            .join(movies.select("movieId", "title"), "movieId", "left")
            .select("tag", "movieId", "title", F.round(F.col("relevance").cast("double"), 6).alias("relevance")))


def topk_overlap(a: DataFrame, b: DataFrame, key: str = "movieId") -> DataFrame:
    """ST-2: size of the intersection of two id sets."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("overlap"))


def seeded_order(keys, seed: int):
    """Deterministic pseudo-random order key of a row: md5 of the key columns and the seed
    (JVM built-in; the same value in SQL engines that have md5, so samples and splits can be
    checked against SQL)."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_n(df: DataFrame, key, n: int, seed: int = 42) -> DataFrame:
    """SP-1: fixed-size pseudo-random sample, stable under repartitioning: the n rows with
    the smallest seeded hash of the key; ordered top-n, so no full sort."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("_h", seeded_order(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST-1: concatenate two sources with the same columns (by name)."""
    return a.unionByName(b)


def date_range(df: DataFrame, ts: str = "timestamp", epoch: bool = True) -> DataFrame:
    """AG-30: first and last date of a time column."""
    c = F.to_date(epoch_to_ts(ts)) if epoch else F.to_date(F.col(ts))
    return df.agg(F.min(c).alias("first_date"), F.max(c).alias("last_date"))
