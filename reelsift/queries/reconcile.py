"""Second-catalogue reconciliation queries (merge, standardise, audit, catalogue JSON)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from reelsift import adapt, schemas
from reelsift.plans import reconcile as rc
from reelsift.queries import register
from reelsift.queries.sql import with_tables


def _sources(spark, sf):
    return adapt.movies(spark, sf), adapt.ratings(spark, sf), adapt.second_movies(spark, sf), \
        adapt.second_ratings(spark, sf)


_YEAR_RE = r"\((\d{4})\)\s*$"
_STRIP_YEAR_RE = r"\s*\(\d{4}\)\s*$"
_STRICT_RE = r"^(.*?)\s*\((\d{4})\)\s*$"

# Merge (PL-1) in SQL: id maps, remapped second source, flags, union.
_MERGE = f"""mx AS (SELECT greatest((SELECT max(movieId) FROM movies), (SELECT max(movieId) FROM ratings)) AS mm,
                (SELECT max(userId) FROM ratings) AS mu),
mmap AS (SELECT movieId AS old_id, CAST(row_number() OVER (ORDER BY movieId) + (SELECT mm FROM mx) AS BIGINT) AS new_id
         FROM (SELECT DISTINCT movieId FROM movies2)),
umap AS (SELECT userId AS old_id, CAST(row_number() OVER (ORDER BY userId) + (SELECT mu FROM mx) AS BIGINT) AS new_id
         FROM (SELECT DISTINCT userId FROM ratings2)),
m2s AS (SELECT CAST(mmap.new_id AS INTEGER) AS movieId, title, genres, release_date
        FROM movies2 JOIN mmap ON movies2.movieId = mmap.old_id),
r2s AS (SELECT CAST(umap.new_id AS INTEGER) AS userId, CAST(mmap.new_id AS INTEGER) AS movieId,
               CAST(least(greatest(rating, 0.5), 5.0) AS FLOAT) AS rating, r."timestamp"
        FROM ratings2 r JOIN umap ON r.userId = umap.old_id JOIN mmap ON r.movieId = mmap.old_id),
m1k AS (SELECT movieId, title, genres, TRY_CAST(nullif(regexp_extract(title, '{_YEAR_RE}', 1), '') AS INTEGER) AS year,
               lower(trim(regexp_replace(title, '{_STRIP_YEAR_RE}', ''))) AS title_norm FROM movies),
m2k AS (SELECT movieId, title, genres, CAST(year(try_strptime(release_date, '%Y-%m-%d')) AS INTEGER) AS year,
               lower(trim(title)) AS title_norm FROM m2s),
dup AS (SELECT DISTINCT title_norm, year FROM m1k WHERE year IS NOT NULL
        INTERSECT SELECT DISTINCT title_norm, year FROM m2k WHERE year IS NOT NULL),
cm AS (SELECT movieId, title, genres,
              EXISTS (SELECT 1 FROM dup d WHERE d.title_norm = m1k.title_norm AND d.year = m1k.year) AS is_duplicate_title_year,
              'movielens' AS source FROM m1k
       UNION ALL
       SELECT movieId, title, genres,
              EXISTS (SELECT 1 FROM dup d WHERE d.title_norm = m2k.title_norm AND d.year = m2k.year),
              'tmdb' FROM m2k),
cr AS (SELECT userId, movieId, rating, "timestamp", 'movielens' AS source FROM ratings
       UNION ALL SELECT userId, movieId, rating, "timestamp", 'tmdb' FROM r2s)"""

_MERGE_SQL = with_tables("ratings", "movies", "ratings2", extra=_MERGE)


@register("second_source_ratings", with_tables("ratings2") + "SELECT * FROM ratings2")
def q_second_source_ratings(spark, sf):
    """PL-6 (FN-22, FN-8): one synthetic rating per vote of the second catalogue."""
    return adapt.second_ratings(spark, sf)


@register("second_source_movie_map", _MERGE_SQL + "SELECT old_id, new_id FROM mmap")
def q_second_source_movie_map(spark, sf):
    """JN-12 / AG-34: dense second-source movie ids after the first source's largest id."""
    m1, r1, m2, r2 = _sources(spark, sf)
    return rc.second_source_movie_map(m2, m1, r1)


@register("second_source_user_map", _MERGE_SQL + "SELECT old_id, new_id FROM umap")
def q_second_source_user_map(spark, sf):
    """JN-12: dense second-source user ids after the first source's largest user id."""
    m1, r1, m2, r2 = _sources(spark, sf)
    return rc.second_source_user_map(r2, r1)


@register("merged_movies", _MERGE_SQL + "SELECT * FROM cm")
def q_merged_movies(spark, sf):
    """PL-1 movies (JN-9, JN-11, PRJ-4, ST-1)."""
    return rc.merge_sources(*_sources(spark, sf), with_ratings=False)[0]


@register("merged_ratings", _MERGE_SQL + "SELECT * FROM cr")
def q_merged_ratings(spark, sf):
    """PL-1 ratings (JN-11 remap, FN-8 clip, ST-1)."""
    return rc.merge_sources(*_sources(spark, sf))[1]


@register("duplicate_keys", _MERGE_SQL + "SELECT * FROM dup")
def q_duplicate_keys(spark, sf):
    """JN-9: (normalised title, year) keys present in both catalogues."""
    return rc.merge_sources(*_sources(spark, sf), with_ratings=False)[2]


@register("source_breakdown", _MERGE_SQL + """
SELECT 'ratings' AS table_name, source, count(*) AS rows FROM cr GROUP BY source
UNION ALL SELECT 'movies', source, count(*) FROM cm GROUP BY source""")
def q_source_breakdown(spark, sf):
    """AG-29."""
    movies, ratings = rc.merge_sources(*_sources(spark, sf))[:2]
    return rc.source_breakdown(movies, ratings)


@register("source_date_ranges", _MERGE_SQL + """
SELECT source, CAST(make_timestamp(min("timestamp") * 1000000) AS DATE) AS first_date,
       CAST(make_timestamp(max("timestamp") * 1000000) AS DATE) AS last_date FROM cr GROUP BY source""")
def q_source_date_ranges(spark, sf):
    """AG-31: date range of each source's ratings."""
    return rc.source_date_ranges(rc.merge_sources(*_sources(spark, sf))[1])


@register("merge_report", _MERGE_SQL + """
SELECT 'first_ratings_rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM ratings
UNION ALL SELECT 'first_movies_rows', count(*) FROM movies
UNION ALL SELECT 'second_ratings_rows', count(*) FROM ratings2
UNION ALL SELECT 'second_movies_rows', count(*) FROM movies2
UNION ALL SELECT 'combined_ratings_rows', count(*) FROM cr
UNION ALL SELECT 'combined_movies_rows', count(*) FROM cm
UNION ALL SELECT 'duplicate_keys', count(*) FROM dup
UNION ALL SELECT 'first_flagged', count(*) FILTER (WHERE is_duplicate_title_year) FROM cm WHERE source = 'movielens'
UNION ALL SELECT 'second_flagged', count(*) FILTER (WHERE is_duplicate_title_year) FROM cm WHERE source = 'tmdb'
UNION ALL SELECT 'second_movie_id_min', min(new_id) FROM mmap
UNION ALL SELECT 'second_movie_id_max', max(new_id) FROM mmap
UNION ALL SELECT 'second_user_id_min', min(new_id) FROM umap
UNION ALL SELECT 'second_user_id_max', max(new_id) FROM umap""")
def q_merge_report(spark, sf):
    """AG-31 (AG-30 row side)."""
    return rc.merge_report(*_sources(spark, sf))


_STD = _MERGE + f""",
mxf AS (SELECT max(movieId) AS m FROM cm WHERE source = 'movielens'),
sec AS (SELECT cm.movieId, cm.title, cm.genres, m2.release_date
        FROM cm LEFT JOIN mmap ON cm.movieId = mmap.new_id LEFT JOIN movies2 m2 ON m2.movieId = mmap.old_id
        WHERE cm.movieId > (SELECT m FROM mxf)),
sec2 AS (SELECT movieId, CASE WHEN y IS NOT NULL THEN trim(title) || ' (' || CAST(y AS VARCHAR) || ')' ELSE title END AS title,
                genres FROM (SELECT *, year(try_strptime(release_date, '%Y-%m-%d')) AS y FROM sec)),
uni AS (SELECT movieId, title, genres FROM cm WHERE source = 'movielens' UNION ALL SELECT * FROM sec2),
k AS (SELECT movieId,
             CASE WHEN regexp_matches(title, '{_STRICT_RE}') THEN
               trim(regexp_replace(regexp_replace(lower(regexp_extract(title, '{_STRICT_RE}', 1)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))
             END AS title_norm,
             CASE WHEN regexp_matches(title, '{_STRICT_RE}') THEN TRY_CAST(regexp_extract(title, '{_STRICT_RE}', 2) AS INTEGER) END AS year
      FROM uni),
canon AS (SELECT title_norm, year, min(movieId) AS new_id FROM k
          WHERE title_norm IS NOT NULL AND year IS NOT NULL AND movieId <= (SELECT m FROM mxf) GROUP BY ALL),
dmap AS (SELECT k.movieId AS old_id, canon.new_id, title_norm, year FROM k JOIN canon USING (title_norm, year)
         WHERE k.movieId > (SELECT m FROM mxf))"""

_STD_SQL = with_tables("ratings", "movies", "ratings2", extra=_STD)


def _standardized(spark, sf, with_ratings: bool = True):
    m1, r1, m2, r2 = _sources(spark, sf)
    movies, ratings, _, movie_map, _ = rc.merge_sources(m1, r1, m2, r2, with_ratings=with_ratings)
    return rc.standardize_sources(movies, ratings, movie_map, m2.select("movieId", "release_date"))


@register("standardized_movies", _STD_SQL + "SELECT * FROM uni WHERE movieId NOT IN (SELECT old_id FROM dmap)")
def q_standardized_movies(spark, sf):
    """PL-2 movies (JN-13, FN-15, FN-11, JN-10, JN-3)."""
    return _standardized(spark, sf, with_ratings=False)[0]


@register("standardized_ratings", _STD_SQL + """
SELECT userId, coalesce(dmap.new_id, cr.movieId) AS movieId, rating, "timestamp"
FROM cr LEFT JOIN dmap ON cr.movieId = dmap.old_id""")
def q_standardized_ratings(spark, sf):
    """PL-2 ratings (JN-11 remap onto canonical ids)."""
    return _standardized(spark, sf)[1]


@register("canonical_map", _STD_SQL + "SELECT * FROM dmap")
def q_canonical_map(spark, sf):
    """JN-10: second-source id -> smallest first-source id with the same strict key."""
    return _standardized(spark, sf, with_ratings=False)[2]


@register("standardize_report", _STD_SQL + """,
sm AS (SELECT * FROM uni WHERE movieId NOT IN (SELECT old_id FROM dmap)),
sr AS (SELECT userId, coalesce(dmap.new_id, cr.movieId) AS movieId, rating FROM cr LEFT JOIN dmap ON cr.movieId = dmap.old_id)
SELECT 'movies_before' AS metric, CAST(count(*) AS DOUBLE) AS value FROM cm
UNION ALL SELECT 'movies_after', count(*) FROM sm
UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT DISTINCT title_norm, year FROM dmap)
UNION ALL SELECT 'second_rows_dropped', count(*) FROM dmap
UNION ALL SELECT 'ratings_before', count(*) FROM cr
UNION ALL SELECT 'ratings_after', count(*) FROM sr
UNION ALL SELECT 'ratings_remapped', count(*) FROM cr WHERE movieId IN (SELECT old_id FROM dmap)
UNION ALL SELECT 'rating_min', min(rating) FROM sr
UNION ALL SELECT 'rating_max', max(rating) FROM sr
UNION ALL SELECT 'ratings_out_of_range', count(*) FILTER (WHERE rating < 0.5 OR rating > 5.0) FROM sr""")
def q_standardize_report(spark, sf):
    """AG-31 (standardise): before/after rows, duplicates, remapped ratings, rating range."""
    m1, r1, m2, r2 = _sources(spark, sf)
    movies, ratings, _, movie_map, _ = rc.merge_sources(m1, r1, m2, r2)
    sm, sr, dmap = rc.standardize_sources(movies, ratings, movie_map, m2.select("movieId", "release_date"))
    return rc.standardize_report(movies, ratings, sm, sr, dmap)


@register("merged_movies_preview", _MERGE_SQL + "SELECT * FROM cm ORDER BY movieId, source LIMIT 5")
def q_merged_movies_preview(spark, sf):
    """TK-5: head(5) of the merged catalogue in a stated order."""
    from reelsift.operators.explore import preview
    return preview(rc.merge_sources(*_sources(spark, sf), with_ratings=False)[0], ["movieId", "source"], 5)


def _classify_sql(a: str, b: str) -> str:
    aa = f"trim(regexp_replace({a}, '{_STRIP_YEAR_RE}', ''))"
    bb = f"trim({b})"

    def ns(x):
        return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"

    def sw(x):
        return f"regexp_replace({x}, '(?i)^(The|A|An)\\s+(.+)$', '\\2, \\1')"

    def sp(x):
        return f"regexp_replace(lower({x}), '[^a-z0-9\\s]', '', 'g')"
    return (f"CASE WHEN {aa} = {bb} THEN 'exact' WHEN lower({aa}) = lower({bb}) THEN 'case_only' "
            f"WHEN {sp(aa)} = {sp(bb)} THEN 'punctuation_or_special_chars' "
            f"WHEN {ns(sw(aa))} = {ns(bb)} OR {ns(aa)} = {ns(sw(bb))} THEN 'article_position' "
            f"ELSE 'other_fuzzy' END")


_AUDIT = _MERGE + f""",
src AS (SELECT title, first(release_date ORDER BY movieId) AS release_date FROM movies2 GROUP BY title),
ml AS (SELECT movieId AS movieId_ml, title AS title_ml,
              TRY_CAST(nullif(regexp_extract(title, '{_YEAR_RE}', 1), '') AS INTEGER) AS year,
              lower(trim(regexp_replace(title, '{_STRIP_YEAR_RE}', ''))) AS title_norm
       FROM cm WHERE is_duplicate_title_year AND source = 'movielens'),
tm AS (SELECT cm.movieId AS movieId_tmdb, cm.title AS title_tmdb,
              CAST(year(try_strptime(src.release_date, '%Y-%m-%d')) AS INTEGER) AS year, lower(trim(cm.title)) AS title_norm
       FROM cm LEFT JOIN src USING (title) WHERE is_duplicate_title_year AND source = 'tmdb'),
pairs AS (SELECT * FROM ml JOIN tm USING (title_norm, year)),
akeys AS (SELECT title_norm, year,
                 first(movieId_ml ORDER BY movieId_ml, movieId_tmdb) AS movieId_ml,
                 first(movieId_tmdb ORDER BY movieId_ml, movieId_tmdb) AS movieId_tmdb,
                 first(title_ml ORDER BY movieId_ml, movieId_tmdb) AS title_ml,
                 first(title_tmdb ORDER BY movieId_ml, movieId_tmdb) AS title_tmdb
          FROM pairs GROUP BY title_norm, year),
audited AS (SELECT *, {_classify_sql('title_ml', 'title_tmdb')} AS match_type FROM akeys)"""

_AUDIT_SQL = with_tables("ratings", "movies", "ratings2", extra=_AUDIT)


def _audit(spark, sf):
    m1, r1, m2, r2 = _sources(spark, sf)
    movies = rc.merge_sources(m1, r1, m2, r2, with_ratings=False)[0]
    return rc.audit_duplicates(movies, m2)


@register("audit_pairs", _AUDIT_SQL + "SELECT * FROM audited")
def q_audit_pairs(spark, sf):
    """PL-4 + PL-3: one flagged pair per duplicate key, classified."""
    return _audit(spark, sf)


@register("match_type_breakdown", _AUDIT_SQL + """
SELECT match_type, count(*) AS keys, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM audited GROUP BY match_type""")
def q_match_type_breakdown(spark, sf):
    """AG-32."""
    return rc.match_type_breakdown(_audit(spark, sf))


@register("match_type_examples", _AUDIT_SQL + """
SELECT match_type, title_norm, year, title_ml, title_tmdb, CAST(r AS INTEGER) AS example
FROM (SELECT *, row_number() OVER (PARTITION BY match_type ORDER BY title_norm, year) AS r FROM audited) WHERE r <= 5""")
def q_match_type_examples(spark, sf):
    """AG-32: five pairs of each match type."""
    return rc.match_type_examples(_audit(spark, sf))


@register("audit_sample", _AUDIT_SQL + """
SELECT * FROM audited ORDER BY md5(concat_ws(':', title_norm, CAST(year AS VARCHAR), '42')), title_norm, year LIMIT 20""")
def q_audit_sample(spark, sf):
    """PL-4 sample: 20 audited pairs in seeded (md5) order."""
    return rc.audit_sample(_audit(spark, sf))


_STRICT_KEY = (f"trim(regexp_replace(regexp_replace(lower(regexp_extract(title, '{_STRICT_RE}', 1)), '[^a-z0-9\\s]', '', 'g'), "
               f"'\\s+', ' ', 'g'))")


@register("strict_title_pairs", _MERGE_SQL.replace("WITH ", "WITH ", 1) + f""",
src AS (SELECT title, first(release_date ORDER BY movieId) AS release_date FROM movies2 GROUP BY title),
ml AS (SELECT movieId AS movieId_ml, title AS title_ml,
              TRY_CAST(nullif(regexp_extract(title, '{_YEAR_RE}', 1), '') AS INTEGER) AS year,
              CASE WHEN regexp_matches(title, '{_STRICT_RE}') THEN {_STRICT_KEY} END AS title_norm
       FROM cm WHERE source = 'movielens'),
tm AS (SELECT cm.movieId AS movieId_tmdb, cm.title AS title_tmdb,
              CAST(year(try_strptime(src.release_date, '%Y-%m-%d')) AS INTEGER) AS year,
              trim(regexp_replace(regexp_replace(lower(cm.title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title_norm
       FROM cm LEFT JOIN src USING (title) WHERE source = 'tmdb'),
pairs AS (SELECT * FROM ml JOIN tm USING (title_norm, year)),
akeys AS (SELECT title_norm, year,
                 first(title_ml ORDER BY movieId_ml, movieId_tmdb) AS title_ml,
                 first(title_tmdb ORDER BY movieId_ml, movieId_tmdb) AS title_tmdb
          FROM pairs GROUP BY title_norm, year)
SELECT {_classify_sql('title_ml', 'title_tmdb')} AS match_type, count(*) AS keys FROM akeys GROUP BY 1""")
def q_strict_title_pairs(spark, sf):
    """PL-3 on the strict-normalisation pairing of all rows (the looser classes occur)."""
    m1, r1, m2, r2 = _sources(spark, sf)
    std_movies = rc.merge_sources(m1, r1, m2, r2, with_ratings=False)[0]
    return rc.audit_duplicates(std_movies, m2, strict=True).groupBy("match_type").agg(F.count(F.lit(1)).alias("keys"))


def catalog_pages(spark, sf, page_size: int = 20):
    """Catalogue API pages as JSON text built from ``part``: one result per part (genre ids
    from its name's words, an unknown id 999 for size 2), pages of ``page_size`` results,
    and the size-1 parts repeated on extra pages (duplicate hits); every page holds at most
    ``page_size`` results."""
    p = adapt.table(spark, sf, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    genre_list = words.select((F.row_number().over(Window.orderBy("name")) + 10).cast("int").alias("id"), "name")
    w = p.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("wpos", "name"))
    ids = (w.join(F.broadcast(genre_list), "name").groupBy("p_partkey")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("wpos", "id"))), lambda s: s["id"]).alias("gids")))
    res = p.join(ids, "p_partkey").select(
        (F.col("p_partkey") / page_size).cast("long").alias("page"),
        F.struct(F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("title"),
                 F.when(F.col("p_size") == 2, F.concat("gids", F.array(F.lit(999)))).otherwise(F.col("gids")).alias("genre_ids"),
                 F.concat((F.lit(1950) + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("release_date"),
                 (F.col("p_retailprice") / 100.0).alias("popularity"),
                 (F.pmod(F.col("p_size"), F.lit(21)) / 2.0).alias("vote_average"),
                 F.pmod(F.col("p_size"), F.lit(7)).cast("int").alias("vote_count")).alias("r"),
        F.col("p_size"), F.col("p_partkey"))
    res = res.unionByName(res.where(F.col("p_size") == 1).withColumn("page", -F.col("page") - 1))
    pages = res.groupBy("page").agg(F.to_json(F.struct(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "r"))), lambda s: s["r"]).alias("results")))
        .alias("value"))
    genres_doc = genre_list.agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name")).alias("genres"))).alias("value"))
    return pages, genres_doc


@register("catalog_from_json", """
SELECT CAST(p_partkey AS INTEGER) AS movieId, p_name AS title,
       replace(p_name, ' ', '|') || CASE WHEN p_size = 2 THEN '|Unknown' ELSE '' END AS genres,
       CAST(1950 + p_size AS VARCHAR) || '-01-01' AS release_date,
       CAST(p_retailprice AS DOUBLE) / 100.0 AS popularity, CAST(p_size % 21 AS DOUBLE) / 2.0 AS vote_average,
       CAST(p_size % 7 AS INTEGER) AS vote_count
FROM part""")
def q_catalog_from_json(spark, sf):
    """PL-5 (SRC-11, DQ-2, FN-23, FN-24): catalogue JSON pages -> one movie row per id."""
    pages_json, genres_json = catalog_pages(spark, sf)
    pages = pages_json.select(F.col("page"), F.from_json("value", schemas.CATALOG_PAGE).alias("d")) \
                      .select("page", "d.results")
    genres = genres_json.select(F.explode(F.from_json("value", schemas.GENRE_LIST)["genres"]).alias("g")) \
                        .select("g.id", "g.name")
    return rc.catalog_from_json(pages, genres)
