"""Demand forecaster: label encoding, naive baseline, gradient-boosted trees, scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from reelsift.plans.ml.boosting import Trees, boost

FEATURE_COLS = ["lag_1", "lag_2", "lag_3", "rolling_3week_avg", "rolling_6week_avg", "genre_encoded"]
TARGET = "rating_count"
SEED = 42
MISSING = -1.0  # null lags -> sentinel (trees split it off)


def label_encoder(col: str = "genre", out: str = "genre_encoded") -> StringIndexer:
    """ML-2: alphabetical 0..n-1 codes; unseen labels raise."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")


def label_encode(train: DataFrame, *others: DataFrame, col: str = "genre", out: str = "genre_encoded"):
    model = label_encoder(col, out).fit(train)
    return model, [model.transform(d) for d in (train, *others)]


def naive_forecast(df: DataFrame, out: str = "prediction") -> DataFrame:
    """ML-3: next week = last week's count (lag_1), null -> 0."""
    return df.withColumn(out, F.coalesce(F.col("lag_1"), F.lit(0.0)))


def _features(df: DataFrame, encoder: StringIndexerModel) -> DataFrame:
    coded = encoder.transform(df).withColumn("genre_encoded", F.col("genre_encoded").cast("double"))
    return coded.withColumn("x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in FEATURE_COLS]))


class Forecaster:
    """Encoder and boosted trees; ``history`` has a row per round (only after fitting)."""

    def __init__(self, encoder: StringIndexerModel, trees: Trees, history: DataFrame | None = None):
        self.encoder, self.trees, self.history = encoder, trees, history

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with genre_encoded and prediction."""
        trees = self.trees

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(trees.predict(np.array(x.tolist(), np.float64).reshape(len(x), len(FEATURE_COLS))))

        return _features(df, self.encoder).withColumn("prediction", predict("x")).drop("x")


def train_forecaster(train: DataFrame, val: DataFrame, **settings) -> Forecaster:
    """ML-4 and ML-17: encoder and boosted trees, with the settings of :func:`boosting.boost` (learning
    rate, leaves, row and feature subsampling, rounds and patience of the reference's booster by
    default). ``history``: round, train_loss, val_loss (mean squared errors; val_loss null without
    validation rows) and kept (whether the model keeps the round) of every round run."""
    encoder = label_encoder().fit(train.select("genre").unionByName(val.select("genre")))
    parts = [_features(d, encoder).select(F.lit(i).alias("part"), F.col(TARGET).alias("y"), F.xxhash64("genre", "week_start").alias("draw"), "x")
             for i, d in enumerate((train, val))]
    trees, rounds = boost(parts[0].unionByName(parts[1]), seed=SEED, **settings)
    told = [(*r, r[0] <= len(trees)) for r in rounds]
    return Forecaster(encoder, trees, train.sparkSession.createDataFrame(told, "round int, train_loss double, val_loss double, kept boolean"))


def score_forecaster(model: Forecaster, df: DataFrame) -> DataFrame:
    """ML-5: predict and clip at 0."""
    out = model.transform(df)
    return out.withColumn("prediction", F.greatest(F.col("prediction"), F.lit(0.0)))


def feature_importance(model: Forecaster) -> DataFrame:
    """ML-9: (feature, importance) sorted descending (one row per feature): shares of the gain."""
    rows = list(zip(FEATURE_COLS, model.trees.importance(len(FEATURE_COLS))))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc())


def save_model(model: Forecaster, path: str) -> None:
    """ML-10: encoder, trees and history below one folder."""
    spark = SparkSession.getActiveSession()
    model.encoder.write().overwrite().save(f"{path}/encoder")
    model.trees.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    if model.history is not None:
        model.history.coalesce(1).write.mode("overwrite").parquet(f"{path}/history")


def load_model(path: str) -> Forecaster:
    spark = SparkSession.getActiveSession()
    return Forecaster(StringIndexerModel.load(f"{path}/encoder"), Trees.of_table(spark.read.parquet(f"{path}/trees")))
