"""Model queries: forecaster baseline/GBT, recommender baselines, ALS runs, genome SVD."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.operators import splits as sp
from reelsift.plans import features as pf
from reelsift.plans.ml import embeddings as emb
from reelsift.plans.ml import forecast as fc
from reelsift.plans.ml import metrics as mt
from reelsift.plans.ml import recommend as rec
from reelsift.queries import register
from reelsift.queries.features import FORECAST_SQL, SEG_CASUAL, SEG_REGULAR
from reelsift.queries.splits import _LOG_SQL
from reelsift.queries.sql import with_tables
from reelsift.session import cut_lineage


def _forecast_split(spark, sf):
    ff = pf.forecasting_features(adapt.ratings(spark, sf), adapt.movies(spark, sf))
    return sp.temporal_split_periods(ff, "week_start")


_FSPLIT = "WITH ff AS (" + FORECAST_SQL + """),
wk AS (SELECT week_start, row_number() OVER (ORDER BY week_start DESC) AS r, count(*) OVER () AS p
       FROM (SELECT DISTINCT week_start FROM ff)),
fs AS (SELECT ff.*, CASE WHEN r <= greatest(1, round_even(p * 0.1, 0)) THEN 'test'
                         WHEN r <= 2 * greatest(1, round_even(p * 0.1, 0)) THEN 'val' ELSE 'train' END AS split
       FROM ff JOIN wk USING (week_start))
"""


@register("forecast_label_encode", _FSPLIT + """
SELECT genre, CAST(dense_rank() OVER (ORDER BY genre) - 1 AS DOUBLE) AS genre_encoded
FROM (SELECT DISTINCT genre FROM fs WHERE split = 'train')""")
def q_forecast_label_encode(spark, sf):
    """ML-2: alphabetical genre codes fitted on the training weeks."""
    s = _forecast_split(spark, sf)
    model = fc.label_encoder().fit(s.where(F.col("split") == "train"))
    return model.transform(s.where(F.col("split") == "train").select("genre").distinct())


def _baseline_metrics(s, split):
    d = fc.naive_forecast(s.where(F.col("split") == split))
    return mt.rmse_mae(d, "rating_count", "prediction", split)


_FBASE = """
, bm AS (SELECT split AS model, sqrt(avg(power(coalesce(lag_1, 0) - rating_count, 2))) AS rmse,
                avg(abs(coalesce(lag_1, 0) - rating_count)) AS mae FROM fs WHERE split IN ('val', 'test') GROUP BY split)
"""


@register("forecast_baseline_metrics", _FSPLIT + _FBASE + "SELECT model, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM bm")
def q_forecast_baseline_metrics(spark, sf):
    """ML-3 + ML-6: naive lag-1 forecast RMSE/MAE on the validation and test weeks."""
    s = _forecast_split(spark, sf)
    out = _baseline_metrics(s, "val").unionByName(_baseline_metrics(s, "test"))
    return out.select("model", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


@register("forecast_overfit_verdict", _FSPLIT + _FBASE + """
SELECT round(v.rmse, 6) AS val_rmse, round(t.rmse, 6) AS test_rmse, round((t.rmse - v.rmse) / v.rmse * 100, 6) AS rmse_gap_pct,
       round(v.mae, 6) AS val_mae, round(t.mae, 6) AS test_mae, round((t.mae - v.mae) / v.mae * 100, 6) AS mae_gap_pct,
       CASE WHEN (t.rmse - v.rmse) / v.rmse * 100 <= 0 THEN 'no_overfit'
            WHEN (t.rmse - v.rmse) / v.rmse * 100 <= 15 THEN 'within_tolerance' ELSE 'possible_overfit' END AS verdict
FROM (SELECT * FROM bm WHERE model = 'val') v, (SELECT * FROM bm WHERE model = 'test') t""")
def q_forecast_overfit_verdict(spark, sf):
    """ML-8 on the naive forecaster: test vs validation gap and verdict."""
    s = _forecast_split(spark, sf)
    v = mt.overfit_verdict(_baseline_metrics(s, "val"), _baseline_metrics(s, "test"))
    return v.select(*[F.round(c, 6).alias(c) for c in ("val_rmse", "test_rmse", "rmse_gap_pct", "val_mae", "test_mae",
                                                       "mae_gap_pct")], "verdict")


@register("forecast_rolling_improvement", _FSPLIT + """
, e AS (SELECT split, rating_count AS y, coalesce(lag_1, 0) AS b, coalesce(rolling_6week_avg, 0) AS p FROM fs WHERE split IN ('val', 'test')),
m AS (SELECT split, sqrt(avg(power(b - y, 2))) AS b_rmse, sqrt(avg(power(p - y, 2))) AS m_rmse, avg(abs(b - y)) AS b_mae, avg(abs(p - y)) AS m_mae FROM e GROUP BY split)
SELECT 'rolling_' || split AS model, round(b_rmse, 6) AS b_rmse, round(m_rmse, 6) AS m_rmse, round((b_rmse - m_rmse) / b_rmse * 100, 6) AS rmse_improvement_pct,
       round(b_mae, 6) AS b_mae, round(m_mae, 6) AS m_mae, round((b_mae - m_mae) / b_mae * 100, 6) AS mae_improvement_pct FROM m""")
def q_forecast_rolling_improvement(spark, sf):
    """ML-7 on a forecast that SQL can make too: the six-week mean against last week's count."""
    s = cut_lineage(_forecast_split(spark, sf), "forecast-split")
    parts = []
    for name in ("val", "test"):
        d = s.where(F.col("split") == name)
        mean = d.withColumn("prediction", F.coalesce("rolling_6week_avg", F.lit(0.0)))
        parts.append(mt.improvement_table(mt.rmse_mae(fc.naive_forecast(d), "rating_count", "prediction", "baseline"),
                                          mt.rmse_mae(mean, "rating_count", "prediction", f"rolling_{name}")))
    return parts[0].unionByName(parts[1]).select("model", *[F.round(c, 6).alias(c) for c in (
        "b_rmse", "m_rmse", "rmse_improvement_pct", "b_mae", "m_mae", "mae_improvement_pct")])


_MODELS: dict = {}


def _forecaster(spark, sf):
    """(model, split): boosted on the training weeks by the library's own rounds, patience and step, once
    per session and input folder (the queries on it share the model and the written split)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        s = cut_lineage(_forecast_split(spark, sf), "forecast-split")
        _MODELS[key] = fc.train_forecaster(s.where(F.col("split") == "train"), s.where(F.col("split") == "val")), s
    return _MODELS[key]


@register("forecast_model_metrics")
def q_forecast_model_metrics(spark, sf):
    """ML-4, ML-5, ML-7: gradient-boosted trees vs the naive baseline on val and test."""
    model, s = _forecaster(spark, sf)
    parts = []
    for name in ("val", "test"):
        d = s.where(F.col("split") == name)
        scored = fc.score_forecaster(model, d)
        parts.append(mt.improvement_table(mt.rmse_mae(fc.naive_forecast(d), "rating_count", "prediction", "baseline"),
                                          mt.rmse_mae(scored, "rating_count", "prediction", f"gbt_{name}")))
    return parts[0].unionByName(parts[1])


@register("forecast_model_verdict")
def q_forecast_model_verdict(spark, sf):
    """ML-8 on the boosted trees: test vs validation gap and verdict."""
    model, s = _forecaster(spark, sf)
    v, t = (mt.rmse_mae(fc.score_forecaster(model, s.where(F.col("split") == n)), "rating_count", "prediction", n) for n in ("val", "test"))
    return mt.overfit_verdict(v, t)


@register("forecast_feature_importance")
def q_forecast_feature_importance(spark, sf):
    """ML-9 (and ML-10 bundle round trip in tests)."""
    return fc.feature_importance(_forecaster(spark, sf)[0])


@register("forecast_training_history")
def q_forecast_training_history(spark, sf):
    """ML-17: training and validation loss of every boosting round, and whether the model keeps it."""
    return _forecaster(spark, sf)[0].history


def _rec_split(spark, sf):
    log = pf.interaction_log_from_ratings(adapt.ratings(spark, sf), casual_max=SEG_CASUAL, regular_max=SEG_REGULAR)
    return sp.leave_last_n_out(log)


_RSPLIT = with_tables("ratings", extra=_LOG_SQL + """,
spl AS (SELECT * EXCLUDE (r, n), CASE WHEN r < 5 THEN 'test' WHEN r < 10 THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY "timestamp" DESC, movieId, rating) - 1 AS r,
                     count(*) OVER (PARTITION BY userId) AS n FROM log) WHERE n >= 11),
tr AS (SELECT * FROM spl WHERE split = 'train'),
te AS (SELECT * FROM spl WHERE split = 'test'),
mmean AS (SELECT movieId, avg(CAST(rating AS DOUBLE)) AS mm FROM tr GROUP BY movieId),
pred AS (SELECT te.userId, te.movieId, CAST(te.rating AS DOUBLE) AS rating,
                least(greatest(coalesce(mmean.mm, (SELECT avg(CAST(rating AS DOUBLE)) FROM tr)), 0.5), 5.0) AS prediction
         FROM te LEFT JOIN mmean USING (movieId))""")


def _baseline_pred(spark, sf):
    s = cut_lineage(_rec_split(spark, sf), "rec-split")
    tr, te = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    mm = tr.groupBy("movieId").agg(F.avg(F.col("rating").cast("double")).alias("mm"))
    g = tr.agg(F.avg(F.col("rating").cast("double"))).scalar()
    from reelsift.functions.labels import clip
    return (te.join(mm, "movieId", "left")
            .select("userId", "movieId", F.col("rating").cast("double").alias("rating"),
                    clip(F.coalesce(F.col("mm"), g), 0.5, 5.0).alias("prediction")))


@register("rec_baseline_rmse", _RSPLIT + """
SELECT 'movie_mean' AS model, round(sqrt(avg(power(prediction - rating, 2))), 6) AS rmse,
       round(avg(abs(prediction - rating)), 6) AS mae FROM pred""")
def q_rec_baseline_rmse(spark, sf):
    """ML-14 / ML-6: RMSE of the movie-mean predictor on the leave-last-5 test items."""
    m = mt.rmse_mae(_baseline_pred(spark, sf), "rating", "prediction", "movie_mean")
    return m.select("model", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


@register("rec_baseline_ndcg", _RSPLIT + """,
d AS (SELECT userId AS u, rating AS y, prediction AS p FROM pred
      WHERE userId IN (SELECT userId FROM pred GROUP BY userId HAVING count(*) >= 2)),
bp AS (SELECT u, y, p, row_number() OVER (PARTITION BY u ORDER BY p DESC, y) - 1 AS pos FROM d),
grp AS (SELECT u, p, avg(y) * sum(CASE WHEN pos < 10 THEN 1.0 / log2(pos + 2) ELSE 0 END) AS g FROM bp GROUP BY u, p),
dcg AS (SELECT u, sum(g) AS dcg FROM grp GROUP BY u),
idl AS (SELECT u, sum(y * CASE WHEN pos < 10 THEN 1.0 / log2(pos + 2) ELSE 0 END) AS idcg
        FROM (SELECT u, y, row_number() OVER (PARTITION BY u ORDER BY y DESC) - 1 AS pos FROM d) GROUP BY u)
SELECT round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg, count(*) AS users FROM dcg JOIN idl USING (u)""")
def q_rec_baseline_ndcg(spark, sf):
    """ML-15: tie-averaged NDCG@10 of the movie-mean predictor (ties share their gain)."""
    n = mt.ndcg_at_k(_baseline_pred(spark, sf), "userId", "rating", "prediction", 10)
    return n.select(F.round("ndcg", 6).alias("ndcg"), "users")


@register("rec_training_table", _RSPLIT + """
SELECT tr.userId, tr.movieId, tr.rating, tr."timestamp", tr.reward, tr.user_segment, tr.split,
       CAST(u.user_idx AS BIGINT) AS user_idx, CAST(m.movie_idx AS BIGINT) AS movie_idx
FROM tr JOIN (SELECT userId, row_number() OVER (ORDER BY userId) - 1 AS user_idx FROM (SELECT DISTINCT userId FROM ratings)) u USING (userId)
        JOIN (SELECT movieId, row_number() OVER (ORDER BY movieId) - 1 AS movie_idx FROM (SELECT DISTINCT movieId FROM ratings)) m USING (movieId)""")
def q_rec_training_table(spark, sf):
    """ML-11 (JN-2 semi joins, JN-12 dense indices) on the training interactions."""
    r = adapt.ratings(spark, sf)
    s = _rec_split(spark, sf)
    users = r.select("userId").distinct()
    movies = r.select("movieId").distinct()
    return rec.rec_training_table(s.where(F.col("split") == "train"), users, movies)


@register("rec_als_runs")
def q_rec_als_runs(spark, sf):
    """ML-12, ML-13, ML-16, ML-17: ALS + stack with genome columns over a small grid, best by
    validation RMSE; a history row per run and iteration, plus the chosen model's test RMSE / NDCG@10."""
    s = cut_lineage(_rec_split(spark, sf), "rec-split")
    tr, va, te = (s.where(F.col("split") == x) for x in ("train", "val", "test"))
    movies, _ = emb.genome_embeddings(adapt.genome_scores(spark, sf))
    grid = [{"rank": 8, "reg": 0.1}, {"rank": 16, "reg": 0.1}, {"rank": 32, "reg": 0.05}]
    best, hist = rec.select_best_run(tr, va, grid, movies=movies, emb_cols=[f"genome_emb_{i}" for i in range(emb.N_COMPONENTS)])
    scored = cut_lineage(best.transform(te), "rec-scored")
    m = mt.rmse_mae(scored, "rating", "prediction", "test").first()
    nd = mt.ndcg_at_k(scored, "userId", "rating", "prediction", checkpoint=False).first()["ndcg"]
    test_row = spark.createDataFrame([(-1, "best_on_test", None, None, float(m["rmse"]), float(nd))], hist.schema)
    return hist.unionByName(test_row)


@register("movie_features_genome")
def q_movie_features_genome(spark, sf):
    """ML-1 + PL-8 + FN-25: movie features with the 50 genome SVD columns (0.0 when absent)."""
    e, _ratio = emb.genome_embeddings(adapt.genome_scores(spark, sf), 50)
    return pf.movie_features(adapt.ratings(spark, sf), adapt.movies(spark, sf), embeddings=e)


@register("genome_embedding_norms", with_tables("genome_scores") + """
SELECT movieId, round(sum(power(CAST(relevance AS DOUBLE), 2)), 2) AS squares FROM genome_scores GROUP BY movieId""")
def q_genome_embedding_norms(spark, sf):
    """ML-1 with as many components as tags: a rotation, so each movie keeps its sum of squares."""
    e, _ratio = emb.genome_embeddings(adapt.genome_scores(spark, sf), 64)
    cols = [c for c in e.columns if c.startswith("genome_emb_")]
    return e.select("movieId", F.round(sum(F.pow(F.col(c).cast("double"), 2) for c in cols), 2).alias("squares"))
