from datetime import date

from pyspark.sql import functions as F

from reelsift.operators import explore as ex
from reelsift.operators import quality as dq
from reelsift.operators import splits as sp
from reelsift.operators.aggregates import favorite_genre, user_stats
from reelsift.operators.ranking import dense_id_map, global_rank
from reelsift.operators.windows import recent_items, users_for_share
from reelsift.plans.features import forecast_grid

R = "userId int, movieId int, rating float, timestamp long"


def test_duplicates_and_range(spark):
    df = spark.createDataFrame([(1, 1, 4.0, 10), (1, 1, 4.0, 10), (1, 2, 0.0, 11), (1, 3, 0.5, 12),
                                (1, 4, 5.0, 13), (1, 5, 5.5, 14), (1, 6, None, 15)], R)
    prof = {r.metric: r.value for r in dq.quality_profile(df, "ratings").collect()}
    assert prof["duplicate_rows"] == 1 and prof["null_rating"] == 1 and prof["rows"] == 7
    kept = sorted(r.rating for r in dq.filter_valid_range(dq.dedup_rows(df)).collect())
    assert kept == [0.5, 4.0, 5.0]


def test_clean_order_not_kcore(spark):
    # user 1: 5 ratings, one on movie 9 which has only 4 ratings -> user keeps 4 rows
    rows = [(1, m, 4.0, m) for m in (1, 2, 3, 4, 9)]
    rows += [(u, 9, 3.0, 100 + u) for u in (2, 3, 4)]
    rows += [(u, m, 3.0, 200 + u * 10 + m) for u in (2, 3, 4, 5, 6) for m in (1, 2, 3, 4)]
    rows += [(u, 5, 3.0, 900 + u) for u in (2, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, R)
    out = dq.clean_ratings(df, min_user=5, min_movie=5)
    u1 = out.where("userId = 1").count()
    assert u1 == 4 and out.where("movieId = 9").count() == 0


def test_week_gap(spark):
    counts = spark.createDataFrame([("g", date(2024, 1, 1), 4, 14.0), ("g", date(2024, 1, 22), 2, 6.0),
                                    ("h", date(2024, 1, 8), 1, 3.0)],
                                   "genre string, week_start date, rating_count long, rating_sum double")
    g = {(r.genre, r.week_start): r for r in forecast_grid(counts).collect()}
    assert len(g) == 8  # 2 genres x 4 weeks
    w2, w4 = g[("g", date(2024, 1, 8))], g[("g", date(2024, 1, 22))]
    assert w2.rating_count == 0 and w2.avg_rating is None and w2.lag_1 == 4.0
    assert w4.lag_1 == 0.0 and w4.lag_2 == 0.0 and w4.lag_3 == 4.0
    assert w4.rolling_3week_avg == 2 / 3 and w4.rolling_6week_avg == 1.5
    assert g[("h", date(2024, 1, 1))].rating_count == 0


def test_single_rating_std_zero(spark):
    df = spark.createDataFrame([(1, 1, 3.0, 1)], R)
    assert user_stats(df).first().rating_std == 0.0


def test_favorite_genre_tie(spark):
    c = spark.createDataFrame([(1, "Drama", 2), (1, "Comedy", 2), (1, "Action", 1)], "userId int, genre string, count long")
    assert favorite_genre(c).first().favorite_genre == "Comedy"


def test_recent_items(spark):
    rows = [(1, m, 3.0, 10 * m) for m in (1, 2, 3)] + [(2, m, 3.0, 5) for m in range(10, 17)]
    out = {r.userId: r for r in recent_items(spark.createDataFrame(rows, R)).collect()}
    assert [out[1][f"recent_movie_{i}"] for i in range(1, 6)] == [3, 2, 1, None, None]
    assert [out[2][f"recent_movie_{i}"] for i in range(1, 6)] == [16, 15, 14, 13, 12]


def test_leave_last_n_out(spark):
    rows = [(1, m, 3.0, m) for m in range(10)] + [(2, m, 3.0, m) for m in range(11)]
    out = sp.leave_last_n_out(spark.createDataFrame(rows, R))
    assert out.where("userId = 1").count() == 0
    c = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"train": 1, "val": 5, "test": 5}
    assert out.where("split = 'train'").first().movieId == 0


def test_random_split_sizes(spark):
    df = spark.range(105).withColumnRenamed("id", "k")
    out = sp.random_split(df, "k")
    c = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"train": 84, "val": 11, "test": 10}
    assert out.select("k").distinct().count() == 105
    again = sp.random_split(df.repartition(7), "k")
    assert sorted(rows_of(out)) == sorted(rows_of(again))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_temporal_split_periods(spark):
    for n_periods, expect_test in ((4, 1), (25, 2)):
        df = spark.range(n_periods).select(F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") * 7).cast("int")).alias("w"))
        c = {r.split: r["count"] for r in sp.temporal_split_periods(df, "w").groupBy("split").count().collect()}
        assert c["test"] == expect_test and c["val"] == expect_test


def test_temporal_split_rows(spark):
    df = spark.createDataFrame([(i % 3, i, 3.0, 100 - i) for i in range(25)], R)
    out = sp.temporal_split_rows(df, ["timestamp", "userId", "movieId", "rating"])
    c = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"train": 21, "val": 2, "test": 2}
    assert out.where("split='train'").agg(F.max("timestamp")).first()[0] <= out.where("split='val'").agg(F.min("timestamp")).first()[0]
    assert out.where("split='val'").agg(F.max("timestamp")).first()[0] <= out.where("split='test'").agg(F.min("timestamp")).first()[0]


def test_global_rank_dense_and_unique(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    r = global_rank(df, ["v"])
    got = sorted((x.v, x._rank) for x in r.collect())
    assert got == [(i, i) for i in range(1000)]


def test_dense_id_map(spark):
    df = spark.createDataFrame([(5,), (3,), (9,), (3,)], "id int")
    m = sorted(tuple(r) for r in dense_id_map(df, "id", 100).collect())
    assert m == [(3, 100), (5, 101), (9, 102)]


def test_users_for_share_matches_rowwise(spark):
    import numpy as np
    counts = [50, 30, 30, 10, 10, 10, 5, 5, 1]
    rows = [(u, m, 3.0, m) for u, n in enumerate(counts) for m in range(n)]
    got = users_for_share(spark.createDataFrame(rows, R)).first()[0]
    s = np.sort(np.array(counts))[::-1]
    assert got == int((np.cumsum(s) / s.sum() <= 0.8).sum())


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "x double")
    h = {r.bin: r["count"] for r in ex.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 1, 4: 1}


def test_dedup_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "k string, o int, v string")
    got = {r.k: r.v for r in dq.dedup_keep_first(df, "k", "o").collect()}
    assert got == {"a": "early", "b": "only"}


def test_profile_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1, 1, float("nan"), 1), (1, 2, None, 2), (1, 3, 3.0, 3)], R)
    prof = {r.metric: r.value for r in dq.quality_profile(df, "ratings").collect()}
    assert prof["null_rating"] == 2 and prof["null_userId"] == 0


def test_dense_id_map_over_several_partitions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 1000).alias("id")).repartition(4)
    got = sorted(tuple(r) for r in dense_id_map(df, "id", 10).collect())
    assert [r[1] for r in got] == list(range(10, 510)) and [r[0] for r in got] == sorted({i * 37 % 1000 for i in range(500)})


def leave_out_by_hand(rows, n_test=5, n_val=5):
    """Per user: the rows newest first, nulls of a tie first, cut after 5 and 10."""
    out = []
    for u in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (r[3] is None, -(r[3] or 0), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0))
        if len(mine) > n_test + n_val:
            out += [(*r, "test" if i < n_test else "val" if i < n_test + n_val else "train") for i, r in enumerate(mine)]
    return out


def test_leave_last_n_out_with_equal_rows_nulls_and_ties(spark):
    import random
    rng = random.Random(4)
    rows = [(u, rng.choice([1, 2, 3]), rng.choice([None, 1.0, 2.0]), rng.choice([10, 11, 12, 13, None])) for u in range(1, 25) for _ in range(rng.choice([9, 11, 14, 40]))]
    rows += [(50, 1, 3.0, 7)] * 13 + [(None, 1, 3.0, i) for i in range(15)]
    got = [tuple(r) for r in sp.leave_last_n_out(spark.createDataFrame(rows, R)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, leave_out_by_hand(rows)))


def test_cuts_need_no_sort_or_copy_of_the_rows(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("int").alias("userId"), F.col("id").cast("int").alias("movieId"),
                                  F.lit(1.0).cast("float").alias("rating"), (F.col("id") * 7919 % 400_000).alias("timestamp"))
    out = sp.temporal_split_rows(df, ["timestamp", "userId", "movieId", "rating"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.timestamp, r.userId, r.movieId, r.split) for r in out.collect())
    assert [r[3] for r in rows] == ["train"] * 2400 + ["val"] * 300 + ["test"] * 300


def test_plans_of_joins_run_no_job_while_they_are_built(spark):
    from reelsift.operators.aggregates import genre_week_counts, user_genre_counts
    ratings = spark.createDataFrame([(1, 1, 3.0, 0)], R)
    movies = spark.createDataFrame([(1, "a (1999)", "x|y")], "movieId int, title string, genres string")
    spark.sparkContext.setJobGroup("plans", "built only")
    pairs = ex.explode_genres(movies)
    for df in (user_genre_counts(ratings, pairs), genre_week_counts(ratings, pairs), ex.genre_rating_stats(ratings, movies), ex.genre_year_counts(ratings, movies)):
        assert df.columns
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plans")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_split_size_formula():
    assert sp.split_sizes_random(105) == (84, 11, 10)
    assert sp.split_sizes_random(1500) == (1200, 150, 150)
