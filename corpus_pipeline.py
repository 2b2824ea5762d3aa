"""The corpus pipeline: five stages over ``documents``, each a Parquet table that the next one reads.

    language ID -> exact dedup -> n-gram Jaccard join -> mixing to target weights -> packing

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the
last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.llm import langid, mixing, ngram_join, packing
from reelsift.llm.common import cut_lineage
from reelsift.llm.exact_dedup import exact_dedup
from reelsift.llm.queries import tokenizer_path


def _small_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches of 2 MB in place of 64, on both sides of the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: no letters, or far from every learned language."""
    _small_batches(spark)
    model = langid.fit(docs, "doc_id", "text", "lang", F.lit(True))
    return langid.identify(docs, model).filter("not rejected").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 of the five-word shingles one row stays: that of the
    smallest id, null ids last, of rows of one id that of the smallest hash. Rows count by all their
    columns, so rows that share an id, and rows without one, take part each for itself; of rows equal in
    every column one stays. Rows without words link with nothing and all stay."""
    _small_batches(spark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    keyed = docs.withColumn("_row", row)
    classes = cut_lineage(ngram_join.jaccard_classes(keyed.select("_row", "text"), id_col="_row", n=5, num=4, den=5).filter("class_id IS NOT NULL")
                          .select(F.col("doc_id").alias("_row"), "component_id"), "near-classes")
    gone = cut_lineage(classes.filter("component_id <> _row").select("_row").distinct(), "gone")
    left = keyed.join(gone, "_row", "left_anti")
    equal = cut_lineage(classes.filter("component_id = _row").groupBy("_row").count().filter("count > 1").select("_row"), "equal-rows")
    if equal.limit(1).count():
        once = left.join(equal, "_row", "left_semi").dropDuplicates(["_row"])
        left = left.join(equal, "_row", "left_anti").unionByName(once)
    return left.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target: documents come as often as the mix takes them, or not at all."""
    _small_batches(spark)
    return mixing.mix_documents(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 tokens."""
    _small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language ID", language_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
          ("mixing to target weights", mixing_stage), ("packing", packing_stage)]

#: Not expressible in SQL: the stages learn models; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
