"""End-to-end batch stages over a raw ratings corpus (CSV folder), in the reference's order:
preprocess -> feature tables -> splits. Each stage reads what the previous one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelsift.operators import quality as dq
from reelsift.operators import splits as sp
from reelsift.plans import features as pf
from reelsift.plans.ml import embeddings as emb
from reelsift.plans.ml import forecast as fc
from reelsift.plans.ml import metrics as mt
from reelsift.sources import readers as rd
from reelsift.sources import sinks as sk


def preprocess(spark: SparkSession, raw_dir: str, out_dir: str, **thresholds) -> tuple[DataFrame, DataFrame]:
    """Profile the six raw tables, clean them and write them as parquet under ``out_dir``. Each raw
    table is read once, into its different rows and their counts. Returns (quality report,
    before/after report); both are small."""
    counted = {name: dq.counted_rows(df) for name, df in rd.read_raw(spark, raw_dir).items()}
    clean = {"ratings": lambda d: dq.clean_unique_ratings(d, **thresholds), "movies": lambda d: dq.clean_movies(d, False),
             "tags": lambda d: dq.clean_tags(d, False), "links": lambda d: dq.clean_links(d, False)}
    for name, df in counted.items():
        unique = dq.unique_rows(df)
        sk.write_parquet(clean[name](unique) if name in clean else unique, f"{out_dir}/{name}")
    steps = {name: dq.counted_ratings_steps(df, **thresholds) if name == "ratings" else dq.counted_steps(df) for name, df in counted.items()}
    return dq.counted_report(counted, **thresholds), dq.before_after_report(steps)


def build_features(spark: SparkSession, processed_dir: str, out_dir: str, n_components: int = 50,
                   **segments) -> DataFrame:
    """Forecasting features (CSV) always; user features, movie features with genome
    embeddings and the interaction log (parquet) only when not all three exist. Returns
    the output report."""
    ratings = spark.read.parquet(f"{processed_dir}/ratings").select("userId", "movieId", "rating", "timestamp")
    movies = spark.read.parquet(f"{processed_dir}/movies").select("movieId", "title", "genres")
    sk.write_csv(pf.forecasting_features(ratings, movies), f"{out_dir}/forecasting_features")

    def users():
        return pf.user_features(ratings, movies, float32=True, **segments)

    def movie_feats():
        scores = spark.read.parquet(f"{processed_dir}/genome_scores")
        vecs, _ratio = emb.genome_embeddings(scores, n_components)
        return pf.movie_features(ratings, movies, embeddings=vecs, float32=True)

    def log():
        return pf.interaction_log(ratings, spark.read.parquet(f"{out_dir}/user_features"))
    # the log reads the written user features, so it is built after them
    sk.build_if_missing(spark, {f"{out_dir}/user_features": users, f"{out_dir}/movie_features": movie_feats,
                                f"{out_dir}/rl_features": log},
                        writer=lambda df, p: sk.write_interaction_log(df, p) if p.endswith("rl_features")
                        else sk.write_parquet(df, p))
    return sk.output_report(spark, {"user_features": f"{out_dir}/user_features",
                                    "movie_features": f"{out_dir}/movie_features",
                                    "rl_features": f"{out_dir}/rl_features"},
                            epoch_cols={"rl_features": "timestamp"})


def prepare_splits(spark: SparkSession, features_dir: str) -> None:
    """Temporal split of the forecasting weeks, row-level temporal split and leave-last-5-out
    of the interaction log, seeded 80/10/10 splits of the user and movie features. Each is
    written once, partitioned by ``split`` (train / val / test folders)."""
    ff = rd.read_forecasting(spark, f"{features_dir}/forecasting_features")
    log = spark.read.parquet(f"{features_dir}/rl_features")
    outputs = {
        "forecasting_split": sp.temporal_split_periods(ff, "week_start"),
        "rl_split": sp.temporal_split_rows(log, ["timestamp", "userId", "movieId", "rating"]),
        "rec_split": sp.leave_last_n_out(log),
        "user_split": sp.random_split(spark.read.parquet(f"{features_dir}/user_features"), "userId"),
        "movie_split": sp.random_split(spark.read.parquet(f"{features_dir}/movie_features"), "movieId"),
    }
    for name, df in outputs.items():
        sk.write_parquet(df, f"{features_dir}/{name}", partition_by=["split"])


def _errors(model: fc.Forecaster, df: DataFrame, split: str) -> DataFrame:
    """(split, model, rmse, mae) of the naive and the boosted forecast."""
    d = df.where(F.col("split") == split)
    both = mt.rmse_mae(fc.naive_forecast(d), fc.TARGET, "prediction", "baseline").unionByName(
        mt.rmse_mae(fc.score_forecaster(model, d), fc.TARGET, "prediction", "boosted"))
    return both.select(F.lit(split).alias("split"), "model", "rmse", "mae")


def train_forecast(spark: SparkSession, features_dir: str, models_dir: str, **settings) -> DataFrame:
    """Train the forecaster on the written split; store the model with its history and the validation
    errors of both forecasts below ``models_dir``. Returns the errors."""
    split = spark.read.parquet(f"{features_dir}/forecasting_split")
    model = fc.train_forecaster(split.where("split = 'train'"), split.where("split = 'val'"), **settings)
    fc.save_model(model, f"{models_dir}/forecaster")
    sk.write_parquet(_errors(model, split, "val"), f"{models_dir}/forecaster_metrics")
    return spark.read.parquet(f"{models_dir}/forecaster_metrics")


def evaluate_forecast(spark: SparkSession, features_dir: str, models_dir: str) -> tuple[DataFrame, DataFrame]:
    """Judge the stored model on the test weeks: errors of both splits with the improvement over the
    naive forecast, and the verdict against the stored validation errors."""
    test = _errors(fc.load_model(f"{models_dir}/forecaster"), spark.read.parquet(f"{features_dir}/forecasting_split"), "test")
    known = spark.read.parquet(f"{models_dir}/forecaster_metrics").unionByName(test)
    base = known.where("model = 'baseline'").select("split", F.col("rmse").alias("b_rmse"), F.col("mae").alias("b_mae"))
    table = known.join(base, "split").select("split", "model", "rmse", "mae", *[
        ((F.col(f"b_{e}") - F.col(e)) / F.col(f"b_{e}") * 100).alias(f"{e}_improvement_pct") for e in ("rmse", "mae")])
    boosted = known.where("model = 'boosted'")
    return table, mt.overfit_verdict(boosted.where("split = 'val'"), boosted.where("split = 'test'"))


__all__ = ["preprocess", "build_features", "prepare_splits", "train_forecast", "evaluate_forecast"]
