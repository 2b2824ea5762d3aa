"""Writers, all-or-nothing build, summaries and output reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelsift.functions.dates import epoch_to_ts

# the writer's side of readers.CSV_OPTIONS
CSV_OUT = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "",
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """SNK-1: overwrite, header, no index; helper columns dropped; arrays as JSON text. Quotes are
    doubled and white space is kept, as ``readers`` expects; empty text reads back as null."""
    d = df.drop(*drop)
    for f in d.schema.fields:
        if f.dataType.typeName() in ("array", "struct", "map"):
            d = d.withColumn(f.name, F.to_json(f.name))
    d.write.mode("overwrite").options(**CSV_OUT).csv(path)


def write_parquet(df: DataFrame, path: str, max_records_per_file: int | None = None,
                  partition_by: list[str] | None = None) -> None:
    """SNK-2 / SNK-3: overwrite parquet; ``max_records_per_file`` bounds file size for the
    large interaction log (the reference's 500,000-row increments)."""
    w = df.write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_interaction_log(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """SNK-3: the interaction log in files of at most ``rows_per_file`` rows, one schema."""
    write_parquet(df, path, max_records_per_file=rows_per_file)


def _complete(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a finished write (its ``_SUCCESS`` marker exists). Creating the
    reader lists the path, so a missing marker raises without running a job."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.text(path.rstrip("/") + "/_SUCCESS")
        return True
    except AnalysisException:
        return False


def build_if_missing(spark: SparkSession, outputs: dict[str, Callable[[], DataFrame]],
                     writer: Callable[[DataFrame, str], None] = write_parquet) -> bool:
    """SNK-4: all-or-nothing. If every output folder has ``_SUCCESS`` nothing is rebuilt;
    otherwise all are (re)written. Returns True when a build happened."""
    if all(_complete(spark, p) for p in outputs):
        return False
    for path, make in outputs.items():
        writer(make(), path)
    return True


def summary(ratings: DataFrame, movies: DataFrame, tags: DataFrame) -> DataFrame:
    """SNK-5: (metric, value) summary: rows, columns, date range, distinct users/movies."""
    spark = ratings.sparkSession
    from reelsift.operators.explore import distinct_ids
    r = ratings.agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    t = tags.agg(F.count(F.lit(1)).alias("rows"))
    m = movies.agg(F.count(F.lit(1)).alias("rows"))
    one = spark.range(1)

    def row(name, col):
        return one.select(F.lit(name).alias("metric"), col.cast("string").alias("value"))
    parts = [row("ratings_rows", r.select("rows").scalar()),
             row("ratings_columns", F.lit(len(ratings.columns))),
             row("movies_rows", m.select("rows").scalar()),
             row("movies_columns", F.lit(len(movies.columns))),
             row("tags_rows", t.select("rows").scalar()),
             row("tags_columns", F.lit(len(tags.columns))),
             row("first_rating_date", F.to_date(epoch_to_ts(r.select("lo").scalar()))),
             row("last_rating_date", F.to_date(epoch_to_ts(r.select("hi").scalar()))),
             row("unique_users", distinct_ids(ratings, "userId")),
             row("unique_movies", distinct_ids(ratings, "movieId"))]
    return reduce(DataFrame.unionByName, parts)


def write_summary(df: DataFrame, path: str) -> None:
    """SNK-5 sink: ``metric,value`` text lines in one small file (the frame has ten rows)."""
    df.select(F.concat_ws(",", "metric", "value").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def output_samples(spark: SparkSession, paths: dict[str, str], n: int = 5) -> DataFrame:
    """SNK-6: (output, row) with ``n`` rows of each written output as JSON text, the smallest in the
    order of all columns."""
    parts = [d.orderBy(*d.columns).limit(n).select(F.lit(name).alias("output"), F.to_json(F.struct(*d.columns)).alias("row"))
             for name, d in ((name, spark.read.parquet(p)) for name, p in paths.items())]
    return reduce(DataFrame.unionByName, parts)


def output_report(spark: SparkSession, paths: dict[str, str], date_cols: dict[str, str] | None = None,
                  epoch_cols: dict[str, str] | None = None) -> DataFrame:
    """SNK-6: per written parquet output: rows, columns, bytes on disk (from file metadata),
    min/max date."""
    date_cols, epoch_cols = date_cols or {}, epoch_cols or {}
    parts = []
    for name, path in paths.items():
        d = spark.read.parquet(path)
        files = d.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
        if name in date_cols:
            c = F.to_date(F.col(date_cols[name]))
        elif name in epoch_cols:
            c = F.to_date(epoch_to_ts(epoch_cols[name]))
        else:
            c = F.lit(None).cast("date")
        a = d.agg(F.count(F.lit(1)).alias("rows"), F.min(c).alias("min_date"), F.max(c).alias("max_date"))
        parts.append(a.select(F.lit(name).alias("output"), "rows", F.lit(len(d.columns)).alias("columns"),
                              files.agg(F.sum("s")).scalar().alias("bytes"), "min_date", "max_date"))
    return reduce(DataFrame.unionByName, parts)
