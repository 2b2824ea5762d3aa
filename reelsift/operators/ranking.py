"""Distributed global ranking (no single-partition window over data rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reelsift.session import cut_lineage


def global_rank(df: DataFrame, order_cols, out: str = "_rank", total: str | None = None) -> DataFrame:
    """0-based rank of every row in the total order ``order_cols`` (must be unique).

    Range-partition + sort within partitions; in the same job each row records its partition
    id and its position inside the partition (``monotonically_increasing_id`` is partition
    index << 33 + position) and the result is written to the shared checkpoint folder, so
    the numbering is fixed once even if a later stage is recomputed. Per-partition sizes
    (one row per partition) are prefix-summed into offsets and broadcast; ``total`` names an
    optional column with the number of rows (the sum of those sizes, no extra pass)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    tagged = (ranged.withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))
    stored = cut_lineage(tagged, "rank")
    sizes = stored.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"),
                           F.sum("_n").over(Window.partitionBy()).alias("_tot"))
    out_df = (stored.join(F.broadcast(offsets), "_pid")
              .withColumn(out, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off"))
    return out_df.withColumnRenamed("_tot", total) if total else out_df.drop("_tot")


def dense_id_map(df: DataFrame, id_col: str, start=0, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """JN-12: sorted distinct ids -> start, start + 1, ... ``start`` is a literal or a scalar
    Column (for example ``other.agg(F.max(...)).scalar() + 1``). The ids are ranked by
    ``global_rank``, which writes them once, at every size."""
    ids = df.select(F.col(id_col).alias(old)).where(F.col(old).isNotNull()).distinct()
    start_col = F.lit(start) if isinstance(start, (int, float)) else start
    return global_rank(ids, [old]).select(old, (start_col + F.col("_rank")).cast("long").alias(new))


def first_at_rank(df: DataFrame, key, levels, rank: int, order: str = "_key"):
    """The ``key`` (a struct Column) of the row with 0-based ``rank`` in the order of ``key``, as a
    Row, or None beyond the last row. ``levels`` are ever finer monotonic functions of the key: each
    one's counts (a small table) find the part that holds the rank, and only the rows of the last
    part are ranked. No sort and no copy of ``df``; a few column-pruned scans."""
    inside, before = df, 0
    for level in levels:
        parts = inside.groupBy(level.alias("part")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) + before
        hit = parts.withColumn("upto", upto).where(F.col("upto") > rank).orderBy("part").limit(1).collect()
        if not hit:
            return None
        before = hit[0].upto - hit[0].n
        inside = inside.where(level.eqNullSafe(F.lit(hit[0].part)))
    last = inside.select(key.alias(order)).withColumn("_r", F.row_number().over(Window.orderBy(order)))
    found = last.where(F.col("_r") == rank - before + 1).select(order).collect()
    return found[0][0] if found else None
