"""Exact dedup by two passes over a Bloom filter, in DataFrame functions only.

Pass 1 sets ``k = 2`` positions per row in a filter and keeps the positions that two or more rows
hit. Pass 2 tests each row: a row whose positions are not all hit twice has no equal text and
passes straight through without a shuffle; the possibly repeated rest is grouped by SHA-256.

The filter has ``bits_per_row`` bits a row up to ``max_bits`` (32 MB, the bound of the broadcast).
Beyond that bound it fills up and lets more rows through to the exact grouping: slower, never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import WORD_GAP, cut_lineage, without

BLOCK = 1 << 15  # bits of one bitmap_construct_agg bitmap
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WORD_GAP, " ")


def _positions(norm: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(norm), F.lit(bits)), F.pmod(F.xxhash64(norm, F.lit(7)), F.lit(bits))]


def repeated_filter(norms: DataFrame, bits: int) -> DataFrame:
    """(block, bitmap) of the positions that at least two rows of ``_norm`` hit; at most
    ``bits`` / 8 bytes. Counts are combined before the shuffle, so a hot text costs one row a task."""
    hits = norms.select(F.explode(F.array_distinct(F.array(*_positions(F.col("_norm"), bits)))).alias("p"))
    twice = hits.groupBy("p").count().filter("count >= 2")
    return (twice.groupBy(F.shiftright("p", 15).alias("block"))
            .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(BLOCK - 1))).alias("bitmap")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = 32, max_bits: int = 1 << 28) -> DataFrame:
    """All rows and columns of ``docs`` plus ``keep_id``, ``group_size``, ``kept``, ``text_sha256``
    (which replace columns of those names).

    Equal: identical after white space is normalised. The smallest id of a group stays; null ids
    come last; among repeated rows with that id exactly one stays. Null and empty texts are one
    group. An empty table gives an empty result.
    """
    docs = without(docs, [*ADDED, "_norm", "_uid", "_p0", "_p1", "_rep"])
    n = docs.count()
    bits = min(max_bits, max(BLOCK, -(-n * bits_per_row // BLOCK) * BLOCK))
    normed = docs.withColumn("_norm", normalised(F.col(f"`{text_col}`")))
    held = cut_lineage(repeated_filter(normed, bits), "bloom")

    p0, p1 = _positions(F.col("_norm"), bits)
    tested = normed.withColumns({"text_sha256": F.sha2("_norm", 256), "_p0": p0, "_p1": p1}).drop("_norm")
    for p in ("_p0", "_p1"):  # two lookups in the filter, a broadcast of at most max_bits / 8 bytes
        bitmap = F.broadcast(held.select(F.col("block").alias(f"{p}_k"), F.col("bitmap").alias(f"{p}_m")))
        bit = F.col(p).bitwiseAND(F.lit(BLOCK - 1))
        byte = F.conv(F.hex(F.substring(f"{p}_m", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10)
        tested = (tested.join(bitmap, F.shiftright(p, 15) == F.col(f"{p}_k"), "left")
                  .withColumn(p, F.coalesce(F.getbit(byte.cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")), F.lit(0)))
                  .drop(f"{p}_k", f"{p}_m"))
    tested = tested.withColumn("_rep", (F.col("_p0") + F.col("_p1")) == 2).drop("_p0", "_p1")

    alone = tested.filter("not _rep").drop("_rep").withColumns({
        "keep_id": F.col(f"`{id_col}`"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})

    maybe = cut_lineage(tested.filter("_rep").drop("_rep").withColumn("_uid", F.monotonically_increasing_id()), "repeated")
    first = F.min(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col("_uid").alias("uid")))
    groups = cut_lineage(maybe.groupBy("text_sha256").agg(first.alias("_f"), F.count("*").alias("group_size"))
                         .select("text_sha256", F.col("_f.id").alias("keep_id"), F.col("_f.uid").alias("_keep"), "group_size"), "groups")
    grouped = (maybe.join(groups, "text_sha256").withColumn("kept", F.col("_uid") == F.col("_keep"))
               .drop("_uid", "_keep"))
    return alone.unionByName(grouped.select(*alone.columns))
