"""Boosted trees against plain search, across tasks and jobs, and the stages that train and judge them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.plans import batch
from reelsift.plans.ml import boosting as bo
from reelsift.plans.ml import forecast as fc


def made(n=400, seed=1):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 3)), 1)
    y = np.where(x[:, 0] > 0.2, 3.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + draw.normal(size=n) * 0.1
    return x, y


def frame(spark, x, y, val=0.25):
    rows = [(int(i >= len(y) * (1 - val)), float(b), [float(v) for v in a], i * 7919) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "part int, y double, x array<double>, draw long")


def best_split(x, r, min_rows):
    """By trying every cut between two values of every feature."""
    found = (1e-12, -1, 0.0)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) < min_rows:
                continue
            score = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
            if score > found[0] + 1e-9:
                found = (score, f, c)
    return found[1:]


def plain_tree(x, r, depth, min_rows):
    f, c = best_split(x, r, min_rows) if depth else (-1, 0.0)
    if f < 0:
        return np.full(len(r), r.mean())
    left, out = x[:, f] <= c, np.empty(len(r))
    out[left], out[~left] = plain_tree(x[left], r[left], depth - 1, min_rows), plain_tree(x[~left], r[~left], depth - 1, min_rows)
    return out


def test_grow_finds_the_splits_of_plain_search():
    x, y = made()
    edges = [np.unique(x[:, i]) for i in range(3)]
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1)
    *_, value, gain, row = bo.grow(bins, y - y.mean(), np.ones(len(y), bool), np.arange(3), max(map(len, edges)) + 1, 4, 5, lambda a: a)
    assert np.allclose(value[row], plain_tree(x, y - y.mean(), 4, 5))


def test_rounds_follow_from_plain_trees(spark):
    x, y = made(200)
    df = frame(spark, x, y, val=0)
    trees, told = bo.boost(df, max_iter=4, rows=1.0, features=1.0, depth=3, min_rows=5, step=0.3, bins=255)
    pred = np.full(len(y), y.mean())
    for i in range(4):
        pred += 0.3 * plain_tree(x, y - pred, 3, 5)
        assert told[i][1] == pytest.approx(np.mean((y - pred) ** 2)) and told[i][2] is None
    assert len(trees) == 4 and np.allclose(trees.predict(x), pred)


def test_jobs_and_tasks_change_nothing(spark, monkeypatch):
    """One job of many rounds, many jobs, and several tasks that add up their sums."""
    x, y = made(500, 2)
    df = frame(spark, x, y)
    one = bo.boost(df, max_iter=11, depth=3)
    monkeypatch.setattr(bo, "ROUNDS", 3)
    many = bo.boost(df, max_iter=11, depth=3)
    monkeypatch.setattr(bo, "ROWS_PER_TASK", 150)
    tasks = bo.boost(df, max_iter=11, depth=3)
    for other in (many, tasks):
        assert np.allclose(one[1], other[1]) and np.allclose(one[0].predict(x), other[0].predict(x))


def test_patience_cuts_to_the_best_round(spark):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(300, 3)), draw.normal(size=300)  # nothing to learn
    trees, told = bo.boost(frame(spark, x, y), max_iter=200, patience=6, step=0.3)
    losses = [t[2] for t in told]
    assert len(trees) == int(np.argmin(losses)) + 1 == len(told) - 6
    assert bo.stop_round([5, 4, 3, 3.5, 3.2, 9], 3) == (3, True) and bo.stop_round([5, 4, 3, 3.5, 2.9, 9], 3) == (5, False)
    assert bo.stop_round([1, 1, 1], 2) == (1, True)


def test_importance_and_constant_rows(spark):
    x, y = np.ones((60, 3)), np.full(60, 2.0)
    trees, told = bo.boost(frame(spark, x, y), max_iter=5, patience=2)
    assert np.allclose(trees.predict(x), 2.0) and trees.importance(3) == [0.0, 0.0, 0.0]


def test_train_and_evaluate_stages(spark, tmp_path):
    """Trained from the written split, judged from what the training stage stored."""
    from reelsift import adapt
    from reelsift.operators import splits as sp
    from reelsift.plans import features as pf

    sf, d = "/root/testdata/sf0.001", str(tmp_path)
    ff = pf.forecasting_features(adapt.ratings(spark, sf), adapt.movies(spark, sf))
    sp.temporal_split_periods(ff, "week_start").write.partitionBy("split").parquet(f"{d}/forecasting_split")
    batch.train_forecast(spark, d, f"{d}/models", max_iter=40, patience=5)
    table, verdict = batch.evaluate_forecast(spark, d, f"{d}/models")
    got = {(r.split, r.model): r for r in table.collect()}
    assert set(got) == {(s, m) for s in ("val", "test") for m in ("baseline", "boosted")}
    test = spark.read.parquet(f"{d}/forecasting_split").where("split = 'test'")
    scored = fc.score_forecaster(fc.load_model(f"{d}/models/forecaster"), test)
    rmse = scored.select(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("rating_count"), 2)))).first()[0]
    assert got["test", "boosted"].rmse == pytest.approx(rmse) and got["test", "boosted"].rmse < got["test", "baseline"].rmse
    row = verdict.first()
    assert row.val_rmse == pytest.approx(got["val", "boosted"].rmse) and row.verdict in ("no_overfit", "within_tolerance", "possible_overfit")
    assert got["test", "boosted"].rmse_improvement_pct == pytest.approx((1 - rmse / got["test", "baseline"].rmse) * 100)
    assert spark.read.parquet(f"{d}/models/forecaster/history").count() >= 5
