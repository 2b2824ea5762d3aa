"""Exact splits: random (hash) split, temporal splits, leave-last-n-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reelsift.operators.ranking import first_at_rank
from reelsift.session import cut_lineage

SEED = 42
LEAVE_OUT_TEST = 5
LEAVE_OUT_VAL = 5


def _round_half_even(x: float) -> int:
    return int(round(x))


def split_sizes_random(n: int, train: float = 0.8, val: float = 0.1) -> tuple[int, int, int]:
    """SP-2 sizes: n_train = round(train*n); n_val = round(rest * val/(1-train))."""
    n_train = _round_half_even(n * train)
    rest = n - n_train
    n_val = _round_half_even(rest * (val / (1 - train)))
    return n_train, n_val, rest - n_val


def _from_rank(df: DataFrame, key, levels, rank: int):
    """Condition: the row's 0-based rank in the order of ``key`` is at least ``rank``."""
    found = first_at_rank(df, key, levels, rank)
    if found is None:
        return F.lit(False)
    fields = df.select(key.alias("k")).schema["k"].dataType.fields
    return key >= F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(found, fields)])


def random_split(df: DataFrame, key, train: float = 0.8, val: float = 0.1, seed: int = SEED):
    """SP-2: exact-size 80/10/10 split ordered by a seeded hash of the (unique) key: the first
    n_train rows of that order are train, the next n_val val, the rest test, with n_train =
    round(train * n), n_val = round(rest * val / (1 - train)) (half-even). Counts by the hash's first
    digits find the two cuts, so the table is neither sorted nor copied. Returns one DataFrame with a
    ``split`` column."""
    from reelsift.operators.explore import seeded_order
    keys = [key] if isinstance(key, str) else list(key)
    h = seeded_order(keys, seed)
    order = F.struct(h.alias("_h"), *keys)
    ids = df.select(*keys)
    n_train, n_val, _ = split_sizes_random(ids.count(), train, val)
    levels = [F.substring(h, 1, 3), F.substring(h, 1, 6)]
    split = (F.when(_from_rank(ids, order, levels, n_train + n_val), "test")
             .when(_from_rank(ids, order, levels, n_train), "val").otherwise("train"))
    return df.withColumn("split", split)


def temporal_split_rows(df: DataFrame, order_cols, val: float = 0.1, test: float = 0.1):
    """SP-4: time order (epoch seconds first, then the other ``order_cols``, unique together); last
    round(test*n) rows test, previous round(val*n) val (half-even). Counts by day, then by second
    within one day, find the two cuts, so the table is neither sorted nor copied."""
    cols = list(order_cols)
    rows, key = df.select(*cols), F.struct(*cols)
    n = rows.count()
    n_test, n_val = _round_half_even(n * test), _round_half_even(n * val)
    levels = [F.floor(F.col(cols[0]) / 86400), F.col(cols[0])]
    split = (F.when(_from_rank(rows, key, levels, n - n_test), "test")
             .when(_from_rank(rows, key, levels, n - n_test - n_val), "val").otherwise("train"))
    return df.withColumn("split", split)


def temporal_split_periods(df: DataFrame, col: str = "week_start", val: float = 0.1, test: float = 0.1):
    """SP-3: last max(1, round(test*P)) distinct periods test, the previous max(1, round(val*P))
    val, the rest train. The distinct periods form a small table (ranked with a window)."""
    periods = df.select(col).distinct()
    p = periods.select(col, F.row_number().over(Window.orderBy(F.col(col).desc())).alias("_r"),
                       F.count(F.lit(1)).over(Window.partitionBy()).alias("_P"))
    n_test = F.greatest(F.lit(1), F.bround(F.col("_P") * test, 0))
    n_val = F.greatest(F.lit(1), F.bround(F.col("_P") * val, 0))
    lab = p.select(col, F.when(F.col("_r") <= n_test, "test")
                   .when(F.col("_r") <= n_test + n_val, "val").otherwise("train").alias("split"))
    return df.join(F.broadcast(lab), col)


def leave_last_n_out(df: DataFrame, n_test: int = LEAVE_OUT_TEST, n_val: int = LEAVE_OUT_VAL,
                     user: str = "userId", ts: str = "timestamp", tie=("movieId", "rating")):
    """WN-4: users with >= n_test + n_val + 1 rows; per user newest n_test -> test, next
    n_val -> val, rest train (ties on ts broken by ``tie`` ascending, nulls first; rows that are
    equal in all of these share the places they hold in any order). Every row of an eligible user
    comes out once; rows without a user belong to none.

    Only the newest n_test + n_val rows of each user are ranked (``row_number <= n`` is planned with
    a partial WindowGroupLimit, so at most n rows per user and map task are shuffled). They give one
    row per user: the order keys at both cuts, and how many of the rows equal to each lie inside.
    Rows are labelled by comparing their key with the cuts; only rows equal to a cut are numbered."""
    n = n_test + n_val
    key = F.struct(F.col(ts).isNull().alias("_none"), (-F.col(ts)).alias("_ts"), *tie)
    w = Window.partitionBy(user).orderBy("_k")
    newest = (df.select(user, key.alias("_k")).where(F.col(user).isNotNull())
              .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
              .withColumn("_cut1", F.max(F.when(F.col("_r") <= n_test, F.col("_k"))).over(Window.partitionBy(user))))
    last = F.max("_k").over(Window.partitionBy(user))
    cuts = newest.withColumn("_cut2", last).groupBy(user).agg(
        F.max("_cut1").alias("_cut1"), F.max("_cut2").alias("_cut2"),
        F.count_if((F.col("_k") == F.col("_cut1")) & (F.col("_r") <= n_test)).alias("_in1"),
        F.count_if(F.col("_k") == F.col("_cut2")).alias("_in2"))
    sizes = df.groupBy(user).count().where(F.col("count") > n).drop("count")
    # written: one row per user, so that the join can split a user with many rows
    known = df.join(cut_lineage(cuts.join(sizes, user), "cuts"), user).withColumn("_k", key)
    at_cut = (F.col("_k") == F.col("_cut1")) | (F.col("_k") == F.col("_cut2"))
    plain = known.where(~at_cut).withColumn("_o", F.lit(0))
    equal = known.where(at_cut).withColumn("_o", F.row_number().over(Window.partitionBy(user, "_k").orderBy(F.lit(0))))
    k, cut1, cut2, o = F.col("_k"), F.col("_cut1"), F.col("_cut2"), F.col("_o")
    split = (F.when((k < cut1) | ((k == cut1) & (o <= F.col("_in1"))), "test")
             .when((k < cut2) | ((k == cut2) & (o <= F.col("_in2"))), "val").otherwise("train"))
    return plain.unionByName(equal).select(*df.columns, split.alias("split"))


def leave_out_counts(df: DataFrame, n_test: int = LEAVE_OUT_TEST, n_val: int = LEAVE_OUT_VAL,
                     user: str = "userId") -> DataFrame:
    """Eligible / total / excluded users of WN-4."""
    c = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count_if(F.col("n") >= n_test + n_val + 1).alias("eligible_users"),
                 F.count(F.lit(1)).alias("total_users"),
                 F.count_if(F.col("n") < n_test + n_val + 1).alias("excluded_users"))
