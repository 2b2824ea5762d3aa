"""Typed readers (schemas always given; no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelsift import schemas

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "FAILFAST", "nullValue": ""}


def read_csv(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    """SRC-1..9: header CSV with an explicit schema. Only empty fields are null (literal
    "NA"/"None" strings stay strings). Input splits follow the session's
    ``spark.sql.files.maxPartitionBytes`` (SRC-13: a large file becomes many partitions; no
    chunk loop). ``multi_line``: text columns may hold line breaks; such a file is one split, so the
    large tables (ratings, scores) are read without."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=str(multi_line).lower()).csv(path)


def read_ratings(spark, path, **kw):
    """SRC-1."""
    return read_csv(spark, path, schemas.RATINGS, **kw)


def read_movies(spark, path, **kw):
    """SRC-2 (quoted titles with commas, quotes and line breaks)."""
    return read_csv(spark, path, schemas.MOVIES, **{"multi_line": True, **kw})


def read_tags(spark, path, **kw):
    """SRC-3."""
    return read_csv(spark, path, schemas.TAGS, **kw)


def read_links(spark, path, **kw):
    """SRC-4."""
    return read_csv(spark, path, schemas.LINKS, **kw)


def read_genome_scores(spark, path, **kw):
    """SRC-5."""
    return read_csv(spark, path, schemas.GENOME_SCORES, **kw)


def read_genome_tags(spark, path, **kw):
    """SRC-6."""
    return read_csv(spark, path, schemas.GENOME_TAGS, **kw)


def read_second_catalog(spark, movies_path, ratings_path, columns=None):
    """SRC-7: second-source movies (optionally pruned to ``columns``) and ratings."""
    m = read_csv(spark, movies_path, schemas.SECOND_MOVIES, multi_line=True)
    if columns:
        m = m.select(*columns)
    return m, read_csv(spark, ratings_path, schemas.RATINGS)


def read_combined(spark, movies_path, ratings_path):
    """SRC-8."""
    return (read_csv(spark, movies_path, schemas.COMBINED_MOVIES, multi_line=True),
            read_csv(spark, ratings_path, schemas.COMBINED_RATINGS))


def read_forecasting(spark, path):
    """SRC-9: forecasting features with a parsed date column."""
    return read_csv(spark, path, schemas.FORECASTING)


def read_features(spark, path, columns=None) -> DataFrame:
    """SRC-10: parquet, whole or projected (the projection reaches the scan's ReadSchema)."""
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d


def read_catalog_json(spark, path) -> DataFrame:
    """SRC-11: landed catalogue pages (one JSON document per line) -> (page, results).
    ``page`` orders hits for first-occurrence de-duplication (file, then line)."""
    d = spark.read.schema(schemas.CATALOG_PAGE).json(path)
    return d.select(F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("page"),
                    "results")


def read_genre_list(spark, path) -> DataFrame:
    d = spark.read.schema(schemas.GENRE_LIST).json(path)
    return d.select(F.explode("genres").alias("g")).select("g.id", "g.name")


def read_raw(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """All six raw tables of a ratings corpus folder."""
    return {"ratings": read_ratings(spark, f"{raw_dir}/ratings.csv"),
            "movies": read_movies(spark, f"{raw_dir}/movies.csv"),
            "tags": read_tags(spark, f"{raw_dir}/tags.csv"),
            "links": read_links(spark, f"{raw_dir}/links.csv"),
            "genome_scores": read_genome_scores(spark, f"{raw_dir}/genome-scores.csv"),
            "genome_tags": read_genome_tags(spark, f"{raw_dir}/genome-tags.csv")}


def parquet_row_count(spark: SparkSession, path: str) -> int:
    """SRC-12: exact row count before any filter (reads no data columns)."""
    return spark.read.parquet(path).count()


def read_source(spark: SparkSession, src_dir: str) -> tuple[DataFrame, DataFrame]:
    """SRC-1/2/7: (movies, ratings) of one source folder."""
    return read_movies(spark, f"{src_dir}/movies.csv"), read_ratings(spark, f"{src_dir}/ratings.csv")


def read_partitioned_ratings(spark: SparkSession, path: str, split_bytes: int = 128 << 20) -> DataFrame:
    """SRC-13: a large ratings file read as input splits of ``split_bytes`` (no chunk loop). File
    scans take the split size from their session whenever a plan is made, so this read has a session
    of its own (same application, same settings but for this one): whatever is derived from the frame
    keeps its splits, and ``spark`` keeps its own. A join with frames of ``spark`` is planned by the
    session of its left side; temporary views are not shared."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    return read_ratings(own, path)
