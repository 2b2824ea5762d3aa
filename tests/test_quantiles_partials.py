import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.operators import aggregates as ag
from reelsift.operators import partials
from reelsift.operators.quantiles import exact_quantile

SF = "/root/testdata/sf0.001"


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(5)


@pytest.mark.parametrize("kind", ["distinct", "one value has half", "two values", "few values", "skewed"])
def test_exact_quantile_matches_numpy(spark, kind):
    rng = np.random.default_rng(3)
    x = {"distinct": rng.standard_normal(20_001), "one value has half": np.r_[np.full(10_000, 0.25), rng.standard_normal(10_000)],
         "two values": np.r_[np.full(10_000, 1.0), np.full(10_000, 2.0)], "few values": rng.integers(0, 7, 20_000).astype(float),
         "skewed": np.exp(5 * rng.standard_normal(20_000))}[kind]
    df = frame(spark, x.tolist())
    for p in (0.5, 0.013):
        assert exact_quantile(df, "v", p, select_rows=50) == pytest.approx(np.quantile(x, p), rel=1e-12)


def test_exact_quantile_ends_and_edges(spark):
    x = [5.0, 1.0, None, 3.0, math.inf, -math.inf]
    assert exact_quantile(frame(spark, x), "v") == 3.0
    for p in (0.0, 1.0):
        y = list(range(3000))
        assert exact_quantile(frame(spark, [float(v) for v in y]), "v", p, select_rows=20) == p * 2999
    assert exact_quantile(frame(spark, []), "v") is None and exact_quantile(frame(spark, [None]), "v") is None
    odd = frame(spark, [1.0, 2.0, math.nan, math.nan])
    assert exact_quantile(odd, "v", 0.2) == pytest.approx(1.6) and math.isnan(exact_quantile(odd, "v", 0.5))


def test_partials_of_two_steps_equal_a_full_run_and_replays_count_once(spark, tmp_path):
    ratings = adapt.ratings(spark, SF)
    cut = ratings.agg(F.avg("timestamp")).first()[0]
    old, new = ratings.where(F.col("timestamp") < cut), ratings.where(F.col("timestamp") >= cut)
    store = str(tmp_path / "store")
    for df, run in ((old, "a"), (new, "b"), (new, "b")):
        partials.add_days(df, store, "movieId", "userId", run)
    partials.compact(spark, store, str(tmp_path / "one"), "movieId")
    want = {r.movieId: r for r in ag.movie_stats(ratings).collect()}
    users = dict(ratings.groupBy("movieId").agg(F.count_distinct("userId")).collect())
    for path in (store, str(tmp_path / "one")):
        got = partials.merged(spark, path, "movieId").collect()
        assert len(got) == len(want)
        for r in got:
            w = want[r.movieId]
            assert r.total_ratings == w.total_ratings
            assert (r.avg_rating, r.rating_std) == pytest.approx((w.avg_rating, w.rating_std), abs=1e-9)
            assert abs(r.others_about - users[r.movieId]) <= 1 + 0.1 * users[r.movieId]
            assert r.min_rating <= r.median_about <= r.max_rating


def test_partials_of_a_span_of_days(spark, tmp_path):
    rows = [(1, 7, 4.0, 0), (2, 7, 2.0, 86_400), (3, 7, None, 86_400), (4, 8, 3.0, 2 * 86_400)]
    df = spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp long")
    partials.add_days(df, str(tmp_path / "s"), "movieId", "userId", "a")
    day = datetime.date(1970, 1, 2)
    before = partials.merged(spark, str(tmp_path / "s"), "movieId", until=day).collect()
    assert [(r.movieId, r.total_ratings, r.avg_rating, r.rating_std) for r in before] == [(7, 1, 4.0, 0.0)]
    after = partials.merged(spark, str(tmp_path / "s"), "movieId", since=day).orderBy("movieId").collect()
    assert [(r.movieId, r.total_ratings, r.avg_rating) for r in after] == [(7, 1, 2.0), (8, 1, 3.0)]


def test_counted_rows_give_the_report_and_the_cleaning_of_the_raw_table(spark):
    from reelsift.operators import quality as dq

    rows = [(1, 5, 4.0, 10)] * 6 + [(1, None, 9.0, 3), (2, 5, None, 4), (2, 5, None, 4), (2, 6, math.nan, 5), (None, None, None, None)]
    schema = "userId int, movieId int, rating float, timestamp long"
    for data in (rows, []):
        df = spark.createDataFrame(data, schema)
        counted = dq.counted_rows(df)
        bad = (F.col("rating") < 0.5) | (F.col("rating") > 5)
        want = dq.quality_profile(df, "ratings", {"invalid_ratings": F.count_if(bad)})
        got = dq.counted_profile(counted, "ratings", {"invalid_ratings": bad})
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert [tuple(r) for r in dq.entities_below_min(counted, "userId", 3).collect()] == [tuple(r) for r in dq.entities_below_min(df, "userId", 3).collect()]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, dq.clean_unique_ratings(dq.unique_rows(counted), min_user=1, min_movie=1).collect()), key=key) == sorted(
            map(tuple, dq.clean_ratings(df, min_user=1, min_movie=1).collect()), key=key)
        assert sorted(map(tuple, dq.counted_ratings_steps(counted, min_user=1, min_movie=1).collect())) == sorted(
            map(tuple, dq.clean_ratings_steps(df, min_user=1, min_movie=1).collect()))
