"""Window operators: lags, rolling means, last-n items, Pareto curve, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def lag_features(df: DataFrame, part: str, order: str, col: str, lags=(1, 2, 3),
                 prefix: str = "lag_") -> DataFrame:
    """WN-1: ``lag(col, k)`` per partition ordered by ``order`` (double)."""
    w = Window.partitionBy(part).orderBy(order)
    for k in lags:
        df = df.withColumn(f"{prefix}{k}", F.lag(F.col(col), k).over(w).cast("double"))
    return df


def rolling_features(df: DataFrame, part: str, order: str, col: str, sizes=(3, 6),
                     include_current: bool = True, name: str = "rolling_{n}week_avg") -> DataFrame:
    """WN-2: trailing mean of the last n rows (min_periods 1). ``include_current=True``
    matches the reference (the window includes the target row)."""
    w = Window.partitionBy(part).orderBy(order)
    for n in sizes:
        frame = w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)
        df = df.withColumn(name.format(n=n), F.avg(F.col(col).cast("double")).over(frame))
    return df


def recent_items(ratings: DataFrame, n: int = 5, user: str = "userId", item: str = "movieId",
                 ts: str = "timestamp", prefix: str = "recent_movie_") -> DataFrame:
    """WN-3: the n newest items per user as columns (newest first, ties by item desc),
    null-padded. ``row_number <= n`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so at most n rows per user and map task are exchanged."""
    w = Window.partitionBy(user).orderBy(F.col(ts).desc(), F.col(item).desc())
    top = ratings.select(user, item, ts).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy(user).agg(*[
        F.max(F.when(F.col("_r") == i, F.col(item))).alias(f"{prefix}{i}") for i in range(1, n + 1)])


def share_of_total(df: DataFrame, part: str, col: str, out: str = "share") -> DataFrame:
    """WN-7: col / sum(col) within the partition."""
    return df.withColumn(out, F.col(col) / F.sum(col).over(Window.partitionBy(part)))


def pareto_curve(ratings: DataFrame, key: str = "userId") -> DataFrame:
    """WN-5: cumulative share of ratings vs share of entities, entities sorted by activity
    descending. Computed on the distinct activity values (a small table), one row per value:
    ``pct_entities`` / ``pct_ratings`` at the end of that tied group."""
    per = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    by_n = per.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot_e = F.sum("m").over(Window.partitionBy())
    tot_r = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy())
    return by_n.select(
        F.col("n").alias("activity"), F.col("m").alias("entities"),
        F.round(F.sum("m").over(w) * 100.0 / tot_e, 6).alias("pct_entities"),
        F.round(F.sum(F.col("n") * F.col("m")).over(w) * 100.0 / tot_r, 6).alias("pct_ratings"))


def users_for_share(ratings: DataFrame, key: str = "userId", share: float = 0.8) -> DataFrame:
    """WN-6: how many top entities (by activity, descending) have a cumulative share of
    ratings <= ``share``. Closed form per tied activity group on the distinct-value table."""
    per = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    by_n = per.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    w_prev = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy())
    prev = F.coalesce(F.sum(F.col("n") * F.col("m")).over(w_prev), F.lit(0))
    # k rows of this group fit when prev + k*n <= share*total  (k in 0..m)
    k = F.greatest(F.lit(0), F.least(F.col("m"), F.floor((F.lit(share) * total - prev) / F.col("n"))))
    return by_n.select(k.alias("k")).agg(F.sum("k").cast("long").alias("users_for_share"))
