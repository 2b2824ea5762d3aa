"""The three batch stages end to end on a raw CSV corpus derived from the sf0.001 tables."""

import tempfile

from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.plans import batch
from reelsift.sources import sinks as sk

SF = "/root/testdata/sf0.001"


def test_stages_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="reelsift-e2e-")
    raw = f"{base}/raw"
    for name, df in (("ratings.csv", adapt.raw_ratings(spark, SF)), ("movies.csv", adapt.raw_movies(spark, SF)),
                     ("tags.csv", adapt.tags(spark, SF)), ("links.csv", adapt.links(spark, SF)),
                     ("genome-scores.csv", adapt.genome_scores(spark, SF)),
                     ("genome-tags.csv", adapt.genome_tags(spark, SF))):
        sk.write_csv(df, f"{raw}/{name}")
    report, steps = batch.preprocess(spark, raw, f"{base}/processed", min_movie=20)
    q = {(r.table_name, r.metric): r.value for r in report.collect()}
    assert q[("ratings", "duplicate_rows")] > 0 and q[("ratings", "invalid_ratings")] > 0
    s = {(r.table_name, r.step): r.rows for r in steps.collect()}
    assert s[("ratings", "after_movie_filter")] <= s[("ratings", "after_user_filter")] <= s[("ratings", "start")]

    out = batch.build_features(spark, f"{base}/processed", f"{base}/features", n_components=8)
    rows = {r.output: r for r in out.collect()}
    clean = spark.read.parquet(f"{base}/processed/ratings")
    assert rows["rl_features"].rows == clean.count()
    assert rows["user_features"].rows == clean.select("userId").distinct().count()
    mf = spark.read.parquet(f"{base}/features/movie_features")
    assert "genome_emb_7" in mf.columns and dict(mf.dtypes)["avg_rating"] == "float"
    # second run: all three outputs exist, nothing is rebuilt
    assert not sk.build_if_missing(spark, {f"{base}/features/{n}": None for n in ("user_features", "movie_features", "rl_features")})

    batch.prepare_splits(spark, f"{base}/features")
    rec = spark.read.parquet(f"{base}/features/rec_split")
    assert {r.split for r in rec.select("split").distinct().collect()} == {"train", "val", "test"}
    us = spark.read.parquet(f"{base}/features/user_split").groupBy("split").count()
    n = sum(r["count"] for r in us.collect())
    assert {r.split: r["count"] for r in us.collect()}["train"] == round(n * 0.8)
    rl = spark.read.parquet(f"{base}/features/rl_split")
    assert rl.where("split = 'test'").agg(F.min("timestamp")).first()[0] >= \
        rl.where("split = 'train'").agg(F.max("timestamp")).first()[0]
