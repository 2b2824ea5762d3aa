"""Filters, de-duplication, data-quality profiles and the cleaning steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reelsift.functions.dates import epoch_month, epoch_year
from reelsift.functions.labels import RATING_MAX, RATING_MIN
from reelsift.functions.text import needs_article_fix, split_genres, title_article_fix
from reelsift.operators.joins import filter_min_count
from reelsift.session import cut_lineage

# Fixed cleaning thresholds of the reference.
MIN_RATINGS_PER_USER = 5
MIN_RATINGS_PER_MOVIE = 5


def filter_valid_range(df: DataFrame, col: str = "rating", lo: float = RATING_MIN,
                       hi: float = RATING_MAX) -> DataFrame:
    """FLT-1: keep lo <= col <= hi (nulls fall out)."""
    return df.where(F.col(col).between(lo, hi))


def flag_null(df: DataFrame, col: str, out: str) -> DataFrame:
    """FLT-2: boolean column flagging nulls."""
    return df.withColumn(out, F.col(col).isNull())


def drop_sentinel(df: DataFrame, col: str, value) -> DataFrame:
    """FLT-3: drop rows equal to a sentinel (null rows pass)."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def dedup_rows(df: DataFrame) -> DataFrame:
    """DQ-1: full-row distinct (nulls compare equal)."""
    return df.dropDuplicates()


def dedup_keep_first(df: DataFrame, keys, order: str) -> DataFrame:
    """DQ-2: one row per key, the one with the smallest ``order`` (ties: whole row)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(F.col(order), *[F.col(c) for c in others]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def distinct_keys(df: DataFrame, keys) -> DataFrame:
    """DQ-3."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.select(*keys).distinct()


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group (nulls equal)."""
    return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("value")))


def _missing(df: DataFrame) -> dict:
    """Per column, whether its value is missing: null, and NaN in float columns (as pandas counts it)."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    return {c: (F.col(c).isNull() | F.isnan(c)) if c in floats else F.col(c).isNull() for c in df.columns}


def quality_profile(df: DataFrame, name: str, extra: dict | None = None) -> DataFrame:
    """DQ-4: long (table, metric, value): rows, missing values per column (null, and NaN in
    float columns), duplicate rows (nulls compare equal), plus ``extra`` named count
    expressions computed in the same aggregation pass."""
    exprs = {"rows": F.count(F.lit(1))}
    exprs.update({f"null_{c}": F.count_if(m) for c, m in _missing(df).items()})
    exprs.update(extra or {})
    long = df.agg(*[e.cast("long").alias(k) for k, e in exprs.items()]).unpivot([], list(exprs), "metric", "value")
    dups = duplicate_count(df).select(F.lit("duplicate_rows").alias("metric"), "value")
    return long.unionByName(dups).select(F.lit(name).alias("table_name"), "metric", "value")


def counted_rows(df: DataFrame) -> DataFrame:
    """Every different row of ``df`` once, with ``_n``, how often it is there (nulls equal), as a
    written table. Report, cleaning and step counts all follow from it, so the raw table is read once;
    being counts of a finished table, they are right after lost tasks too, which figures gathered on
    the side of a running job (``observe``) are not when a shuffle stage runs again."""
    return cut_lineage(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")), "counted")


def unique_rows(counted: DataFrame) -> DataFrame:
    """DQ-1 from :func:`counted_rows`: no shuffle."""
    return counted.drop("_n")


def counted_profile(counted: DataFrame, name: str, extra: dict | None = None) -> DataFrame:
    """:func:`quality_profile` from :func:`counted_rows`, in one aggregate without a shuffle of rows.
    ``extra`` names conditions here."""
    def rows_where(m):
        return F.sum(F.when(m, F.col("_n")).otherwise(0))
    exprs = {"rows": F.sum("_n"), **{f"null_{c}": rows_where(m) for c, m in _missing(counted.drop("_n")).items()},
             **{k: rows_where(m) for k, m in (extra or {}).items()}, "duplicate_rows": F.sum(F.col("_n") - 1)}
    return (counted.agg(*[F.coalesce(e, F.lit(0)).cast("long").alias(k) for k, e in exprs.items()])
            .unpivot([], list(exprs), "metric", "value").select(F.lit(name).alias("table_name"), "metric", "value"))


def entities_below_min(df: DataFrame, key: str, k: int) -> DataFrame:
    """DQ-6: entities with < k rows, of how many (rows of :func:`counted_rows` count ``_n`` times)."""
    return (df.groupBy(key).agg((F.sum("_n") if "_n" in df.columns else F.count(F.lit(1))).alias("n"))
            .agg(F.count_if(F.col("n") < k).alias("below"), F.count(F.lit(1)).alias("total")))


def quality_report(ratings: DataFrame, movies: DataFrame, tags: DataFrame, links: DataFrame,
                   genome_scores: DataFrame, genome_tags: DataFrame,
                   lo: float = RATING_MIN, hi: float = RATING_MAX,
                   min_user: int = MIN_RATINGS_PER_USER, min_movie: int = MIN_RATINGS_PER_MOVIE) -> DataFrame:
    """DQ-5: profiles of the six tables plus invalid ratings, users/movies below the minimum,
    titles needing the article fix and missing second-catalogue ids, in one long table.
    Table-level extras ride on that table's profile pass; ratings are read four times
    (profile, duplicates, per-user and per-movie counts)."""
    r = F.col("rating")
    parts = [quality_profile(ratings, "ratings", {"invalid_ratings": F.count_if((r < lo) | (r > hi))}),
             quality_profile(movies, "movies", {"titles_to_fix": F.count_if(needs_article_fix("title"))}),
             quality_profile(tags, "tags"),
             quality_profile(links, "links", {"tmdb_missing": F.count_if(F.col("tmdbId").isNull())}),
             quality_profile(genome_scores, "genome_scores"), quality_profile(genome_tags, "genome_tags")]
    return reduce(DataFrame.unionByName, parts + _below_min(ratings, min_user, min_movie))


def counted_report(counted: dict[str, DataFrame], lo: float = RATING_MIN, hi: float = RATING_MAX,
                   min_user: int = MIN_RATINGS_PER_USER, min_movie: int = MIN_RATINGS_PER_MOVIE) -> DataFrame:
    """:func:`quality_report` of six tables that :func:`counted_rows` has written."""
    r = F.col("rating")
    extra = {"ratings": {"invalid_ratings": (r < lo) | (r > hi)}, "movies": {"titles_to_fix": needs_article_fix("title")},
             "links": {"tmdb_missing": F.col("tmdbId").isNull()}}
    parts = [counted_profile(counted[t], t, extra.get(t)) for t in ("ratings", "movies", "tags", "links", "genome_scores", "genome_tags")]
    return reduce(DataFrame.unionByName, parts + _below_min(counted["ratings"], min_user, min_movie))


def _below_min(ratings: DataFrame, min_user: int, min_movie: int) -> list[DataFrame]:
    parts = []
    for tag, key, k in (("users", "userId", min_user), ("movies", "movieId", min_movie)):
        d = entities_below_min(ratings, key, k)
        parts.append(d.select(F.col("below").cast("long").alias(f"{tag}_below_min"),
                              F.col("total").cast("long").alias(f"{tag}_total"))
                     .unpivot([], [f"{tag}_below_min", f"{tag}_total"], "metric", "value")
                     .select(F.lit("ratings").alias("table_name"), "metric", "value"))
    return parts


def clean_ratings(df: DataFrame, lo: float = RATING_MIN, hi: float = RATING_MAX,
                  min_user: int = MIN_RATINGS_PER_USER, min_movie: int = MIN_RATINGS_PER_MOVIE) -> DataFrame:
    """DQ-7: distinct -> valid range -> users with >= min_user -> movies with >= min_movie
    (one pass each, in this order; not a k-core) -> year, month."""
    return clean_unique_ratings(dedup_rows(df), lo, hi, min_user, min_movie)


def clean_unique_ratings(df: DataFrame, lo: float = RATING_MIN, hi: float = RATING_MAX,
                         min_user: int = MIN_RATINGS_PER_USER, min_movie: int = MIN_RATINGS_PER_MOVIE) -> DataFrame:
    """DQ-7 from rows that are different already."""
    d = filter_valid_range(df, "rating", lo, hi)
    d = filter_min_count(d, "userId", min_user)
    d = filter_min_count(d, "movieId", min_movie)
    return d.withColumn("year", epoch_year("timestamp")).withColumn("month", epoch_month("timestamp"))


def clean_ratings_steps(df: DataFrame, lo: float = RATING_MIN, hi: float = RATING_MAX,
                        min_user: int = MIN_RATINGS_PER_USER, min_movie: int = MIN_RATINGS_PER_MOVIE) -> DataFrame:
    """(step_no, step, rows) of DQ-7's steps. The rows without duplicates are written once; what the
    user and movie filters keep is the sum of the counts they go by, so no step runs another again."""
    unique = cut_lineage(dedup_rows(df).select("userId", "movieId", "rating"), "unique")
    return _rating_steps(df.agg(F.count(F.lit(1)).alias("rows")), unique, lo, hi, min_user, min_movie)


def counted_ratings_steps(counted: DataFrame, lo: float = RATING_MIN, hi: float = RATING_MAX,
                          min_user: int = MIN_RATINGS_PER_USER, min_movie: int = MIN_RATINGS_PER_MOVIE) -> DataFrame:
    """:func:`clean_ratings_steps` from :func:`counted_rows`."""
    return _rating_steps(_total(counted), unique_rows(counted), lo, hi, min_user, min_movie)


def counted_steps(counted: DataFrame) -> DataFrame:
    """(step_no, step, rows) of a table that is only made distinct."""
    after = counted.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(1).alias("step_no"), F.lit("after_dedup").alias("step"), "rows")
    return _total(counted).select(F.lit(0).alias("step_no"), F.lit("start").alias("step"), "rows").unionByName(after)


def _total(counted: DataFrame) -> DataFrame:
    return counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"))


def _rating_steps(start: DataFrame, unique: DataFrame, lo: float, hi: float, min_user: int, min_movie: int) -> DataFrame:
    rows = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    valid = filter_valid_range(unique, "rating", lo, hi)
    users = valid.groupBy("userId").agg(F.count(F.lit(1)).alias("n")).where(F.col("userId").isNotNull() & (F.col("n") >= min_user))
    movies = (valid.join(users.select("userId"), "userId", "left_semi").groupBy("movieId").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("movieId").isNotNull() & (F.col("n") >= min_movie)))
    counts = unique.agg(F.count(F.lit(1)).alias("a"), F.count_if((F.col("rating") >= lo) & (F.col("rating") <= hi)).alias("b"))
    steps = [("start", start), ("after_dedup", counts.select(F.col("a").alias("rows"))),
             ("after_invalid_removed", counts.select(F.col("b").alias("rows"))), ("after_user_filter", users.agg(rows.alias("rows"))),
             ("after_movie_filter", movies.agg(rows.alias("rows")))]
    return reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("step_no"), F.lit(s).alias("step"), "rows") for i, (s, d) in enumerate(steps)])


def clean_movies(df: DataFrame, distinct: bool = True) -> DataFrame:
    """DQ-8: distinct -> article fix -> genres list."""
    d = dedup_rows(df) if distinct else df
    return d.withColumn("title", title_article_fix("title")).withColumn("genres_list", split_genres("genres"))


def clean_tags(df: DataFrame, distinct: bool = True) -> DataFrame:
    """DQ-9: distinct -> year, month."""
    return (dedup_rows(df) if distinct else df).withColumn("year", epoch_year("timestamp")).withColumn("month", epoch_month("timestamp"))


def clean_links(df: DataFrame, distinct: bool = True) -> DataFrame:
    """DQ-10: distinct -> typed ids -> missing-id flag (nothing dropped)."""
    d = dedup_rows(df) if distinct else df
    return d.select(F.col("movieId").cast("int"), F.col("imdbId").cast("int"),
                    F.col("tmdbId").cast("long"), F.col("tmdbId").isNull().alias("tmdb_id_missing"))


def clean_genome(df: DataFrame, distinct: bool = True) -> DataFrame:
    """DQ-11."""
    return dedup_rows(df) if distinct else df


def before_after_report(steps: dict[str, DataFrame | list[tuple[str, DataFrame]]]) -> DataFrame:
    """DQ-12: rows per cleaning step, rows dropped by the step, % kept of the start. ``steps`` maps a
    table to its counted (step_no, step, rows), or to [(step, DataFrame), ...] in order."""
    parts = []
    for table, seq in steps.items():
        if not isinstance(seq, DataFrame):
            seq = reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step_no"), F.lit(s).alias("step"), "rows")
                                                 for i, (s, d) in enumerate(seq)])
        parts.append(seq.select(F.lit(table).alias("table_name"), "step_no", "step", "rows"))
    out = reduce(DataFrame.unionByName, parts)
    from pyspark.sql import Window
    w = Window.partitionBy("table_name").orderBy("step_no")
    first = F.first("rows").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.select("table_name", "step_no", "step", "rows",
                      F.coalesce(F.lag("rows").over(w) - F.col("rows"), F.lit(0)).alias("dropped"),
                      F.round(F.try_divide(F.col("rows") * 100.0, first), 6).alias("pct_of_start"))
