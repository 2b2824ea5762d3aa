import math
import os
import tempfile
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from reelsift.plans.ml import embeddings as emb
from reelsift.plans.ml import forecast as fc
from reelsift.plans.ml import metrics as mt
from reelsift.sources import sinks as sk
from reelsift.streaming import jobs as ss


def test_ndcg_tie_averaged(spark):
    df = spark.createDataFrame([(1, 3.0, 0.9), (1, 2.0, 0.9), (1, 1.0, 0.1), (2, 5.0, 1.0)],
                               "u int, y double, p double")
    out = mt.ndcg_at_k(df, "u", "y", "p", 10).first()
    d = lambda i: 1 / math.log2(i + 2)
    dcg = 2.5 * (d(0) + d(1)) + 1.0 * d(2)
    idcg = 3 * d(0) + 2 * d(1) + 1 * d(2)
    assert out.users == 1  # the one-item user is skipped
    assert abs(out.ndcg - dcg / idcg) < 1e-12


def test_ndcg_cutoff(spark):
    rows = [(1, float(i), float(-i)) for i in range(12)]  # worst possible order
    out = mt.ndcg_at_k(spark.createDataFrame(rows, "u int, y double, p double"), "u", "y", "p", 10).first()
    d = lambda i: 1 / math.log2(i + 2)
    ys = list(range(12))
    dcg = sum(ys[i] * d(i) for i in range(10))
    idcg = sum(sorted(ys, reverse=True)[i] * d(i) for i in range(10))
    assert abs(out.ndcg - dcg / idcg) < 1e-12


def test_rmse_and_verdict(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "y double, p double")
    m = mt.rmse_mae(df, "y", "p", "m").first()
    assert abs(m.rmse - math.sqrt(2.5)) < 1e-12 and m.mae == 1.5
    val = spark.createDataFrame([(10.0, 5.0)], "rmse double, mae double")
    for test_rmse, verdict in ((9.0, "no_overfit"), (11.0, "within_tolerance"), (12.0, "possible_overfit")):
        t = spark.createDataFrame([(test_rmse, 5.0)], "rmse double, mae double")
        assert mt.overfit_verdict(val, t).first().verdict == verdict


def test_svd_gram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.random((12, 8))
    rows = [(i, j + 1, float(a[i, j])) for i in range(12) for j in range(8) if not (i == 3 and j == 2)]
    a[3, 2] = 0.0  # missing pair -> 0
    scores = spark.createDataFrame(rows, "movieId int, tagId short, relevance float")
    out, ratio = emb.genome_embeddings(scores, 3)
    e = np.array([[r[f"genome_emb_{k}"] for k in range(3)] for r in out.orderBy("movieId").collect()], dtype=float)
    af = a.astype(np.float32).astype(float)
    u, s, vt = np.linalg.svd(af, full_matrices=False)
    ref = (u[:, :3] * s[:3])
    assert np.allclose(e @ e.T, ref @ ref.T, atol=1e-4)
    # each right singular vector's largest-magnitude entry is positive: e = A v
    v = np.linalg.lstsq(af, e, rcond=None)[0]
    assert all(v[np.abs(v[:, k]).argmax(), k] > 0 for k in range(3))
    assert 0 < ratio <= 1.0 + 1e-9


def test_forecaster_beats_naive(spark):
    from reelsift import adapt
    from reelsift.operators import splits as sp
    from reelsift.plans import features as pf
    s = sp.temporal_split_periods(pf.forecasting_features(adapt.ratings(spark, "/root/testdata/sf0.001"),
                                                          adapt.movies(spark, "/root/testdata/sf0.001")), "week_start")
    train, val = s.where("split = 'train'"), s.where("split = 'val'")
    model = fc.train_forecaster(train, val, max_iter=60, patience=5)
    assert 1 <= len(model.trees) <= 60
    scored = fc.score_forecaster(model, val)
    assert scored.agg(F.min("prediction")).first()[0] >= 0
    m = mt.rmse_mae(scored, "rating_count", "prediction", "gbt").first()
    b = mt.rmse_mae(fc.naive_forecast(val), "rating_count", "prediction", "naive").first()
    assert m.rmse < b.rmse
    imp = fc.feature_importance(model).collect()
    assert len(imp) == 6 and abs(sum(r.importance for r in imp) - 1.0) < 1e-6
    path = tempfile.mkdtemp(prefix="reelsift-model-")
    fc.save_model(model, path)
    again = fc.score_forecaster(fc.load_model(path), val)
    assert again.select("prediction").collect() == scored.select("prediction").collect()


def test_stream_drops_late_rows(spark):
    d = tempfile.mkdtemp(prefix="reelsift-stream-")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    first = spark.createDataFrame([(1, datetime(2024, 1, 20, 12), 1, "view", 1.0),
                                   (2, datetime(2024, 1, 22, 12), 1, "view", 1.0)], schema)
    second = spark.createDataFrame([(4, datetime(2024, 1, 23, 12), 1, "view", 1.0)], schema)
    late = spark.createDataFrame([(3, datetime(2024, 1, 2, 12), 1, "view", 1.0)], schema)
    # late events are compared with the previous batch's watermark (Spark >= 3.4), so the
    # late row arrives in the third micro-batch
    first.coalesce(1).write.parquet(os.path.join(d, "in", "a"))
    second.coalesce(1).write.parquet(os.path.join(d, "in", "b"))
    late.coalesce(1).write.parquet(os.path.join(d, "in", "c"))
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .parquet(os.path.join(d, "in")))
    out = os.path.join(d, "out")
    ss.run_available(ss.stream_genre_week(src, "7 days"), out, keys=["genre", "week_start"])
    got = {(r.week_start.isoformat(), r.event_count) for r in ss.current(spark, out, ["genre", "week_start"]).collect()}
    assert got == {("2024-01-15", 1), ("2024-01-22", 2)}  # the 2024-01-02 row came after the watermark passed it


def test_build_if_missing_all_or_nothing(spark):
    base = tempfile.mkdtemp(prefix="reelsift-build-")
    calls = []

    def make(n):
        def f():
            calls.append(n)
            return spark.range(n)
        return f
    outs = {f"{base}/a": make(3), f"{base}/b": make(4)}
    assert sk.build_if_missing(spark, outs) is True and calls == [3, 4]
    assert sk.build_if_missing(spark, outs) is False and calls == [3, 4]
    outs2 = dict(outs)
    outs2[f"{base}/c"] = make(5)
    assert sk.build_if_missing(spark, outs2) is True and calls == [3, 4, 3, 4, 5]


def test_svd_over_many_partitions_and_last_duplicate_wins(spark, monkeypatch):
    monkeypatch.setattr(emb, "FAN_IN", 2)
    monkeypatch.setattr(emb, "BAND_ROWS", 3)
    rng = np.random.default_rng(1)
    a = rng.random((40, 7)).astype(np.float32).astype(float)
    rows = [(0, 1, 9.0)] + [(i, j + 1, float(a[i, j])) for i in range(40) for j in range(7)]
    scores = spark.createDataFrame(rows, "movieId int, tagId short, relevance float").coalesce(1)
    x, n = emb.relevance_rows(scores)
    g, sums, count = emb.gram(x.repartition(9), n)
    assert count == 40 and np.allclose(g, a.T @ a) and np.allclose(sums, a.sum(0))
    out, ratio = emb.genome_embeddings(scores, 7)
    got = {r.movieId: sum(v * v for v in list(r)[1:]) for r in out.collect()}
    assert all(abs(got[i] - (a[i] ** 2).sum()) < 1e-4 for i in range(40)) and abs(ratio - 1) < 1e-9


def test_forecast_queries_train_by_the_library_defaults(spark, monkeypatch):
    import inspect

    from reelsift.plans.ml.boosting import boost
    from reelsift.queries import ml
    defaults = {k: p.default for k, p in inspect.signature(boost).parameters.items()}
    assert (defaults["max_iter"], defaults["patience"], defaults["step"]) == (1000, 50, 0.05)
    calls = []
    monkeypatch.setattr(fc, "train_forecaster", lambda train, val, *a, **k: calls.append((a, k)))
    monkeypatch.setattr(ml, "_forecast_split", lambda spark, sf: spark.createDataFrame([("train",)], "split string"))
    monkeypatch.setattr(ml, "_MODELS", {})
    ml._forecaster(spark, "nowhere")
    assert calls == [((), {})]


def test_als_runs_pass_all_genome_components(spark, monkeypatch):
    import pytest

    from reelsift import adapt
    from reelsift.queries import ml
    seen = []

    def runs(tr, va, grid, movies, emb_cols):
        seen.append((emb_cols, movies))
        raise StopIteration

    monkeypatch.setattr(ml, "_rec_split", lambda spark, sf: spark.createDataFrame([("train",)], "split string"))
    monkeypatch.setattr(adapt, "genome_scores", lambda spark, sf: None)
    monkeypatch.setattr(emb, "genome_embeddings", lambda scores, k=emb.N_COMPONENTS: (k, None))
    monkeypatch.setattr(ml.rec, "select_best_run", runs)
    with pytest.raises(StopIteration):
        ml.q_rec_als_runs(spark, "nowhere")
    assert seen == [([f"genome_emb_{i}" for i in range(50)], 50)]
