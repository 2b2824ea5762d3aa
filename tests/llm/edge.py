"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = "word " * 30_000
DOCS = [(1, "the quick brown fox jumps over the lazy dog", "en", "a"), (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, None, None, None), (3, "", "en", "b"), (4, " \t\n", None, "b"), (None, "the quick brown fox jumps over the lazy dog", "de", None),
        (5, LONG, "en", "a"), (6, "x", "fr", "c"), (7, "123 456 !!", "en", "c"), (None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=DOCS, extra=()):
    """The rows; ``extra``: names of clashing columns, filled with text."""
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df


def none(spark):
    return spark.createDataFrame([], SCHEMA)
