"""Helpers shared by the operators: column clashes, written tables, word splitting, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.session import cut_lineage, ensure_checkpoint_dir, free

__all__ = ["cut_lineage", "ensure_checkpoint_dir", "read_table", "without", "words", "crc_mod",
           "checked_broadcast", "free", "give_back", "trimmed", "small_batches", "connected_components"]

#: Words of the contracts: runs of anything but space and the controls 9 to 13.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the columns an operator is about to add: its own columns win a clash of names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def words(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: ``bytes`` methods touch ASCII only, and
    ``split`` cuts at exactly space and 9 to 13."""
    return raw.lower().split() if raw else []


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` must be a written table (its count comes from the footers): hint a broadcast up
    to ``max_rows`` rows, and leave the join to Spark's shuffle beyond."""
    return F.broadcast(df) if df.count() <= max_rows else df


def give_back() -> None:
    """Freed memory goes back to the system: workers are kept for later tasks, and two of them stand
    beside each executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def trimmed(go: Callable) -> Callable:
    """``go`` for mapInArrow, after which a task gives its memory back."""
    def run(batches):
        yield from go(batches)
        gc.collect()
        give_back()
    return run


@contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20) -> Iterator[None]:
    """Texts are long: tables written inside go to the Python workers in Arrow batches of ``size`` bytes
    (Spark's own limit is 64 MB, which stands in the executor and in the worker several times)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(v, c): for every vertex of ``edges`` the smallest vertex it reaches.

    Each round points every vertex to its smallest neighbour (or itself), follows the pointers to
    their ends, and goes on with the edges between different ends: a star is gone after one round, a
    chain after a logarithm of its length in jumps. All steps are written tables, and minima are
    taken before the shuffle, so a hub costs no task more than others."""
    left = cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b").distinct(), "edges")
    found = None
    while True:
        both = left.union(left.select("b", "a"))
        to = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")), "pointers")
        while True:
            over = to.select(F.col("v").alias("c"), F.col("c").alias("c2"))
            new = cut_lineage(to.join(over, "c").select("v", F.col("c2").alias("c"), (F.col("c") != F.col("c2")).alias("moved")), "pointers")
            free(to)
            to = new
            moved = to.filter("moved").limit(1).count()
            to = to.select("v", "c")
            if not moved:
                break
        if found is None:
            found = to
        else:
            then = to.select(F.col("v").alias("c"), F.col("c").alias("c2"))
            new = cut_lineage(found.join(then, "c", "left").select("v", F.coalesce("c2", "c").alias("c")), "components")
            free(found)
            found = new
        ends = left.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").filter("x <> y")
        new = cut_lineage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        free(left, *([to] if found is not to else []))
        left = new
        if not left.limit(1).count():
            return found
