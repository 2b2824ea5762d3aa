"""Reconcile a second catalogue with the first: id remap, duplicate flags, merge,
standardisation onto canonical ids, and the duplicate audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelsift.functions.labels import RATING_MAX, RATING_MIN, clip, pct
from reelsift.functions.text import (GENRE_SENTINEL, norm_strict, normalize_spaces, release_year, strip_punct,
                                     strip_year_suffix, swap_leading_article, title_append_year,
                                     title_norm_basic, title_norm_plain, title_norm_strict, title_year,
                                     title_year_strict, ustrip)
from reelsift.operators.joins import drop_known, remap_ids
from reelsift.operators.ranking import dense_id_map
from reelsift.operators.explore import sample_n
from reelsift.session import cut_lineage

FIRST, SECOND = "movielens", "tmdb"  # fixed source labels of the reference


def max_ids(movies1: DataFrame, ratings1: DataFrame):
    """AG-34: scalar subqueries for the largest first-source movie and user ids."""
    max_movie = F.greatest(movies1.agg(F.max("movieId")).scalar(), ratings1.agg(F.max("movieId")).scalar())
    max_user = ratings1.agg(F.max("userId")).scalar()
    return max_movie, max_user


def second_source_movie_map(movies2: DataFrame, movies1: DataFrame, ratings1: DataFrame) -> DataFrame:
    """JN-12: second-source movie ids -> after the first source's largest movie id."""
    return dense_id_map(movies2, "movieId", max_ids(movies1, ratings1)[0] + 1)


def second_source_user_map(ratings2: DataFrame, ratings1: DataFrame) -> DataFrame:
    """JN-12: second-source user ids -> after the first source's largest user id."""
    return dense_id_map(ratings2, "userId", ratings1.agg(F.max("userId")).scalar() + 1)


def flag_cross_source_duplicates(movies1: DataFrame, movies2_std: DataFrame):
    """JN-9: movies sharing (normalised title, year) across sources are flagged on both
    sides (nothing removed). Returns (movies1_flagged, movies2_flagged, dup_keys)."""
    m1 = movies1.withColumn("year", title_year("title")).withColumn("title_norm", title_norm_basic("title"))
    m2 = movies2_std.withColumn("year", release_year("release_date")).withColumn("title_norm", title_norm_plain("title"))
    k1 = m1.where(F.col("year").isNotNull()).select("title_norm", "year").distinct()
    k2 = m2.where(F.col("year").isNotNull()).select("title_norm", "year").distinct()
    dup = cut_lineage(k1.join(k2, ["title_norm", "year"]).withColumn("is_duplicate_title_year", F.lit(True)))

    def flag(m):
        return (m.join(dup, ["title_norm", "year"], "left")
                .withColumn("is_duplicate_title_year", F.coalesce("is_duplicate_title_year", F.lit(False))))
    return flag(m1), flag(m2), dup.drop("is_duplicate_title_year")


def merge_sources(movies1: DataFrame, ratings1: DataFrame, movies2: DataFrame, ratings2: DataFrame,
                  with_ratings: bool = True):
    """PL-1: remap -> clip -> flag duplicates -> source labels -> union.
    Returns (combined_movies, combined_ratings, dup_keys, movie_map, user_map); with
    ``with_ratings=False`` only the catalogue side is built (ratings and user map are None)."""
    max_movie, max_user = max_ids(movies1, ratings1)
    movie_map = dense_id_map(movies2, "movieId", max_movie + 1)
    m2 = remap_ids(movies2.select("movieId", "title", "genres", "release_date"), movie_map, "movieId")
    f1, f2, dup = flag_cross_source_duplicates(movies1, m2)
    cols = ["movieId", "title", "genres", "is_duplicate_title_year"]
    movies = (f1.select(*cols, F.lit(FIRST).alias("source"))
              .unionByName(f2.select(*cols, F.lit(SECOND).alias("source"))))
    if not with_ratings:
        return movies, None, dup, movie_map, None
    user_map = dense_id_map(ratings2, "userId", max_user + 1)
    r2 = remap_ids(remap_ids(ratings2.select("userId", "movieId", "rating", "timestamp"), user_map, "userId"),
                   movie_map, "movieId")
    r2 = r2.withColumn("rating", clip("rating", RATING_MIN, RATING_MAX).cast("float"))
    rcols = ["userId", "movieId", "rating", "timestamp"]
    ratings = (ratings1.select(*rcols, F.lit(FIRST).alias("source"))
               .unionByName(r2.select(*rcols, F.lit(SECOND).alias("source"))))
    return movies, ratings, dup, movie_map, user_map


def source_breakdown(combined_movies: DataFrame, combined_ratings: DataFrame) -> DataFrame:
    """AG-29: rows per source for both combined tables."""
    return (combined_ratings.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit("ratings").alias("table_name"), "source", "rows")
            .unionByName(combined_movies.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
                         .select(F.lit("movies").alias("table_name"), "source", "rows")))


def source_date_ranges(combined_ratings: DataFrame) -> DataFrame:
    """AG-31: first and last rating date of each source."""
    from reelsift.functions.dates import epoch_to_ts
    return (combined_ratings.groupBy("source").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
            .select("source", F.to_date(epoch_to_ts("lo")).alias("first_date"), F.to_date(epoch_to_ts("hi")).alias("last_date")))


def invert_id_map(combined_movies: DataFrame, movie_map: DataFrame, attrs: DataFrame,
                  max_first_movie) -> DataFrame:
    """JN-13: second-source rows of the combined table get their source id back (the
    persisted map, joined on the new id) and that id's attributes (e.g. release_date)."""
    rows = combined_movies.where(F.col("movieId") > max_first_movie)
    back = movie_map.select(F.col("new_id").cast("int").alias("movieId"), F.col("old_id").alias("_old"))
    a = attrs.withColumnRenamed("movieId", "_old")
    return rows.join(back, "movieId", "left").join(a, "_old", "left").drop("_old")


def standardize_sources(combined_movies: DataFrame, combined_ratings: DataFrame, movie_map: DataFrame,
                        release_dates: DataFrame, min_norm_len: int = 0):
    """PL-2: second-source titles get `` (YYYY)`` from their release date, then both sources
    are keyed by the strict normalised title + year; second-source movies whose key has a
    first-source movie are mapped onto the smallest such id (JN-10), their ratings remapped
    (JN-11) and the duplicate movie rows dropped (JN-3). ``combined_ratings`` may be None when
    only the catalogue side is wanted. Returns (movies, ratings, dup_map)."""
    max_first = combined_movies.where(F.col("source") == FIRST).agg(F.max("movieId")).scalar()
    first = combined_movies.where(F.col("source") == FIRST).select("movieId", "title", "genres")
    second = invert_id_map(combined_movies, movie_map, release_dates, max_first)
    yr = release_year("release_date")
    second = second.select("movieId", title_append_year(F.col("title"), yr).alias("title"), "genres")
    unified = first.unionByName(second)
    # the map is catalogue-sized; checkpointing it keeps the plans of every consumer short
    dup_map = cut_lineage(canonical_map(unified, max_first, min_norm_len))
    ratings = None if combined_ratings is None else remap_ids(
        combined_ratings.select("userId", "movieId", "rating", "timestamp"), dup_map, "movieId")
    movies = drop_known(unified, dup_map.select(F.col("old_id").alias("movieId")), "movieId")
    return movies, ratings, dup_map


def canonical_map(unified: DataFrame, max_first, min_norm_len: int = 0) -> DataFrame:
    """JN-10: smallest first-source id per (strict title, year); second-source ids with the
    same key -> that id. Columns: old_id, new_id, title_norm, year."""
    k = unified.select("movieId", title_norm_strict("title").alias("title_norm"),
                       title_year_strict("title").alias("year"))
    k = k.where(F.col("title_norm").isNotNull() & F.col("year").isNotNull())
    if min_norm_len:
        k = k.where(F.length("title_norm") >= min_norm_len)
    canon = (k.where(F.col("movieId") <= max_first).groupBy("title_norm", "year")
             .agg(F.min("movieId").alias("new_id")))
    return (k.where(F.col("movieId") > max_first).join(canon, ["title_norm", "year"])
            .select(F.col("movieId").alias("old_id"), "new_id", "title_norm", "year"))


def classify_title_pair(first_title, second_title) -> Column:
    """PL-3: exact / case_only / punctuation_or_special_chars / article_position /
    other_fuzzy; the first rule that holds wins."""
    a = strip_year_suffix(first_title)
    b = ustrip(second_title)
    article = ((normalize_spaces(swap_leading_article(a)) == normalize_spaces(b))
               | (normalize_spaces(a) == normalize_spaces(swap_leading_article(b))))
    return (F.when(a == b, "exact")
            .when(F.lower(a) == F.lower(b), "case_only")
            .when(strip_punct(a) == strip_punct(b), "punctuation_or_special_chars")
            .when(article, "article_position")
            .otherwise("other_fuzzy"))


def audit_duplicates(combined_movies: DataFrame, movies2: DataFrame, strict: bool = False) -> DataFrame:
    """PL-4: flagged rows of both sources are paired again on (title key, year), one pair
    per key (smallest ids), and classified. ``strict=True`` pairs all rows of both sources
    on the strict normalisation instead (the looser classes can then occur)."""
    src = movies2.select("movieId", "title", "release_date")
    src = (src.groupBy("title").agg(F.min_by("release_date", "movieId").alias("release_date")))  # DQ-2
    flagged = combined_movies if strict else combined_movies.where(F.col("is_duplicate_title_year"))
    ml = flagged.where(F.col("source") == FIRST).select(
        F.col("movieId").alias("movieId_ml"), F.col("title").alias("title_ml"),
        title_year("title").alias("year"),
        (title_norm_strict("title") if strict else F.lower(strip_year_suffix("title"))).alias("title_norm"))
    tm = flagged.where(F.col("source") == SECOND).join(src, "title", "left").select(
        F.col("movieId").alias("movieId_tmdb"), F.col("title").alias("title_tmdb"),
        release_year("release_date").alias("year"),
        (norm_strict("title") if strict else title_norm_plain("title")).alias("title_norm"))
    # the first pair of a key in (first id, second id) order is the smallest id of each side:
    # reduce each side to one row per key before joining, so no key emits all its pairs
    k = ["title_norm", "year"]
    ml1 = ml.groupBy(*k).agg(F.min_by(F.struct("movieId_ml", "title_ml"), "movieId_ml").alias("a"))
    tm1 = tm.groupBy(*k).agg(F.min_by(F.struct("movieId_tmdb", "title_tmdb"), "movieId_tmdb").alias("b"))
    keys = ml1.join(tm1, k).select(*k, "a.movieId_ml", "b.movieId_tmdb", "a.title_ml", "b.title_tmdb")
    return keys.withColumn("match_type", classify_title_pair(F.col("title_ml"), F.col("title_tmdb")))


def match_type_breakdown(keys: DataFrame) -> DataFrame:
    """AG-32: keys per match type and their share; exact vs fuzzy shares follow from it."""
    from pyspark.sql import Window
    c = keys.groupBy("match_type").agg(F.count(F.lit(1)).alias("keys"))
    return c.withColumn("pct", F.round(pct(F.col("keys"), F.sum("keys").over(Window.partitionBy())), 6))


def match_type_examples(keys: DataFrame, n: int = 5) -> DataFrame:
    """AG-32: the first ``n`` pairs of each match type, by title key and year."""
    from pyspark.sql import Window
    w = Window.partitionBy("match_type").orderBy("title_norm", "year")
    return (keys.select("match_type", "title_norm", "year", "title_ml", "title_tmdb")
            .withColumn("example", F.row_number().over(w)).where(F.col("example") <= n))


def audit_sample(keys: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """Seeded sample of audited pairs (md5 of key and seed order)."""
    return sample_n(keys, ["title_norm", "year"], n, seed)


def _metrics(df: DataFrame, exprs: dict, dtype: str = "long") -> DataFrame:
    """One aggregation pass computing several named metrics, unpivoted to (metric, value)."""
    names = list(exprs)
    wide = df.agg(*[e.cast(dtype).alias(n) for n, e in exprs.items()])
    return wide.unpivot([], names, "metric", "value")


def merge_report(movies1: DataFrame, ratings1: DataFrame, movies2: DataFrame, ratings2: DataFrame) -> DataFrame:
    """AG-31: before/after rows, flagged rows per source, duplicate keys, new id ranges."""
    movies, ratings, dup, movie_map, user_map = merge_sources(movies1, ratings1, movies2, ratings2)

    n = F.count(F.lit(1))
    first = F.col("source") == FIRST
    parts = [_metrics(ratings1, {"first_ratings_rows": n}), _metrics(movies1, {"first_movies_rows": n}),
             _metrics(ratings2, {"second_ratings_rows": n}), _metrics(movies2, {"second_movies_rows": n}),
             _metrics(ratings, {"combined_ratings_rows": n}),
             _metrics(movies, {"combined_movies_rows": n,
                               "first_flagged": F.count_if(first & F.col("is_duplicate_title_year")),
                               "second_flagged": F.count_if(~first & F.col("is_duplicate_title_year"))}),
             _metrics(dup, {"duplicate_keys": n}),
             _metrics(movie_map, {"second_movie_id_min": F.min("new_id"), "second_movie_id_max": F.max("new_id")}),
             _metrics(user_map, {"second_user_id_min": F.min("new_id"), "second_user_id_max": F.max("new_id")})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def standardize_report(combined_movies: DataFrame, combined_ratings: DataFrame, std_movies: DataFrame,
                       std_ratings: DataFrame, dup_map: DataFrame, lo: float = RATING_MIN,
                       hi: float = RATING_MAX) -> DataFrame:
    """AG-31 (standardise side): movie rows before/after, duplicate keys and dropped rows,
    rating rows (unchanged) and how many were remapped, rating range and out-of-range rows."""
    n = F.count(F.lit(1))
    remapped = combined_ratings.join(dup_map.select(F.col("old_id").alias("movieId")), "movieId", "left_semi")
    r = F.col("rating")
    parts = [_metrics(combined_movies, {"movies_before": n}, "double"),
             _metrics(std_movies, {"movies_after": n}, "double"),
             _metrics(dup_map, {"duplicate_keys": F.count_distinct("title_norm", "year"), "second_rows_dropped": n},
                      "double"),
             _metrics(combined_ratings, {"ratings_before": n}, "double"),
             _metrics(std_ratings, {"ratings_after": n, "rating_min": F.min(r), "rating_max": F.max(r),
                                    "ratings_out_of_range": F.count_if((r < lo) | (r > hi))}, "double"),
             _metrics(remapped, {"ratings_remapped": n}, "double")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def genre_ids_to_names(df: DataFrame, genres: DataFrame, key: str = "movieId", ids: str = "genre_ids") -> DataFrame:
    """FN-23: per key, its genre ids -> names joined by ``|`` in list order; an unknown id ->
    ``Unknown``; an empty or null list -> null (the caller applies the sentinel). The lookup
    is a join on exploded ids (the genre list is broadcast: one row per genre)."""
    e = df.select(key, F.posexplode_outer(ids).alias("gpos", "gid"))
    named = (e.join(F.broadcast(genres.select(F.col("id").alias("gid"), "name")), "gid", "left")
             .withColumn("name", F.when(F.col("gid").isNotNull(), F.coalesce("name", F.lit("Unknown")))))
    return named.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("gid").isNotNull(), F.struct("gpos", "name")))),
                                 lambda s: s["name"]), "|").alias("g"))


def catalog_from_json(pages: DataFrame, genres: DataFrame, sentinel: str = GENRE_SENTINEL) -> DataFrame:
    """PL-5 (SRC-11, DQ-2, FN-23, FN-24): catalogue API pages -> one row per id (first
    occurrence by page then position), genre ids -> ``A|B`` names (unknown id -> Unknown,
    none -> sentinel), missing fields defaulted.

    ``pages``: (page, results array<struct>) as read by ``read_catalog_json``;
    ``genres``: (id, name). The genre lookup is a join on exploded ids, never a driver map."""
    res = pages.select("page", F.posexplode("results").alias("pos", "r"))
    first = (res.where(F.col("r.id").isNotNull()).groupBy(F.col("r.id").alias("movieId"))
             .agg(F.min_by("r", F.struct("page", "pos")).alias("r")))
    gnames = genre_ids_to_names(first.select("movieId", F.col("r.genre_ids").alias("genre_ids")), genres)
    return first.join(gnames, "movieId", "left").select(
        F.col("movieId").cast("int"),
        F.coalesce("r.title", F.lit("")).alias("title"),
        F.when(F.coalesce(F.col("g"), F.lit("")) == "", F.lit(sentinel)).otherwise(F.col("g")).alias("genres"),
        F.coalesce("r.release_date", F.lit("")).alias("release_date"),
        F.coalesce("r.popularity", F.lit(0.0)).alias("popularity"),
        F.coalesce("r.vote_average", F.lit(0.0)).alias("vote_average"),
        F.coalesce("r.vote_count", F.lit(0)).cast("int").alias("vote_count"))
