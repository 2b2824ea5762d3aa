import tempfile
from datetime import date

from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.operators import splits as sp
from reelsift.operators.joins import full_grid
from reelsift.plans import features as pf
from reelsift.plans.ml import embeddings as emb
from reelsift.plans.ml import metrics as mt
from reelsift.plans.ml import recommend as rec
from reelsift.sources import readers as rd
from reelsift.sources import sinks as sk

SF = "/root/testdata/sf0.001"


def test_training_table_max_rows(spark):
    r = adapt.ratings(spark, SF)
    users, movies = r.select("userId").distinct(), r.select("movieId").distinct()
    t = rec.rec_training_table(r, users, movies, max_rows=100)
    got = sorted((x.userId, x.movieId, x.timestamp, x.rating) for x in t.collect())
    want = sorted((x.userId, x.movieId, x.timestamp, x.rating) for x in
                  r.orderBy("userId", "movieId", "timestamp", "rating").limit(100).collect())
    assert got == want
    assert t.agg(F.min("user_idx"), F.min("movie_idx")).first() == (0, 0)


def test_recommender_runs_and_clips(spark):
    log = pf.interaction_log_from_ratings(adapt.ratings(spark, SF))
    s = sp.leave_last_n_out(log)
    tr, va = s.where("split = 'train'"), s.where("split = 'val'")
    model = rec.train_recommender(tr, rank=4, max_iter=3)
    scored = rec.score_recommender(model, va)
    lo, hi = scored.agg(F.min("prediction"), F.max("prediction")).first()
    assert 0.5 <= lo <= hi <= 5.0
    assert scored.count() == va.count()
    assert rec.rec_rmse(scored).first().rmse > 0
    best, hist = rec.select_best_run(tr, va, [{"rank": 2, "max_iter": 2}, {"rank": 4, "max_iter": 2}], patience=1)
    assert hist.count() >= 1 and best is not None


def test_split_dims(spark):
    df = spark.createDataFrame([(1, [0.1234567, 2.0])], "movieId int, e array<double>")
    r = emb.split_dims(df, "e", 2).first()
    assert abs(r.genome_emb_0 - 0.123457) < 1e-6 and r.genome_emb_1 == 2.0


def test_full_grid(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", date(2024, 1, 15))], "g string, week_start date")
    assert full_grid(df, "g").count() == 6


def test_read_source_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="reelsift-src-")
    m = spark.createDataFrame([(1, 'Heat, The (1995)', "Action|Crime"), (2, "None", None)], "movieId int, title string, genres string")
    r = spark.createDataFrame([(1, 1, 4.5, 10)], "userId int, movieId int, rating float, timestamp long")
    sk.write_csv(m, f"{d}/movies.csv")
    sk.write_csv(r, f"{d}/ratings.csv")
    mm, rr = rd.read_source(spark, d)
    got = {x.movieId: x for x in mm.collect()}
    assert got[1].title == "Heat, The (1995)" and got[2].title == "None" and got[2].genres is None
    assert rr.first().rating == 4.5 and dict(rr.dtypes)["timestamp"] == "bigint"


def test_ndcg_perfect_and_reversed(spark):
    rows = [(1, 5.0, 0.9), (1, 3.0, 0.5), (1, 1.0, 0.1)]
    perfect = mt.ndcg_at_k(spark.createDataFrame(rows, "u int, y double, p double"), "u", "y", "p").first()
    assert abs(perfect.ndcg - 1.0) < 1e-12


def test_read_catalog_json_files(spark):
    import json
    import os
    from reelsift.plans.reconcile import catalog_from_json
    d = tempfile.mkdtemp(prefix="reelsift-json-")
    page1 = {"results": [{"id": 7, "title": "Heat", "genre_ids": [28, 80], "release_date": "1995-12-15",
                          "popularity": 9.5, "vote_average": 7.9, "vote_count": 12},
                         {"id": 8, "title": "Up", "genre_ids": [], "vote_count": 3}]}
    page2 = {"results": [{"id": 7, "title": "Heat (again)", "genre_ids": [80], "vote_count": 99}]}
    with open(os.path.join(d, "pages.json"), "w") as f:
        f.write(json.dumps(page1) + "\n" + json.dumps(page2) + "\n")
    with open(os.path.join(d, "genres.json"), "w") as f:
        f.write(json.dumps({"genres": [{"id": 28, "name": "Action"}, {"id": 80, "name": "Crime"}]}) + "\n")
    pages = rd.read_catalog_json(spark, os.path.join(d, "pages.json"))
    genres = rd.read_genre_list(spark, os.path.join(d, "genres.json"))
    got = {r.movieId: r for r in catalog_from_json(pages, genres).collect()}
    assert got[7].title == "Heat" and got[7].genres == "Action|Crime" and got[7].vote_count == 12
    assert got[8].genres == "(no genres listed)" and got[8].release_date == ""


def test_partitioned_read_splits_large_file(spark):
    d = tempfile.mkdtemp(prefix="reelsift-split-")
    sk.write_csv(adapt.ratings(spark, "/root/testdata/sf0.01").coalesce(1), f"{d}/r")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        df = rd.read_partitioned_ratings(spark, f"{d}/r", split_bytes=256 << 10)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 60000
        derived = df.where("rating > 1").select("userId")
        assert derived.rdd.getNumPartitions() == df.rdd.getNumPartitions() > 2 * spark.read.csv(f"{d}/r").where("_c0 > 1").rdd.getNumPartitions()
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
        assert derived.sparkSession.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_recommender_with_content_beats_the_mean_and_survives_a_round_trip(spark, tmp_path):
    import random

    rng = random.Random(5)
    taste, kind = {u: rng.choice([-1, 1]) for u in range(60)}, {m: rng.choice([-1, 1]) for m in range(80)}
    rows = [(u, m, float(min(5.0, max(0.5, 3 + taste[u] * kind[m] + rng.choice([-0.5, 0, 0.5])))), 100 * u + m)
            for u in range(60) for m in range(80) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp long")
    movies = spark.createDataFrame([(m, float(k), 0.0) for m, k in kind.items()], "movieId int, genome_emb_0 float, genome_emb_1 float")
    train, val = df.where("(userId + movieId) % 5 <> 0"), df.where("(userId + movieId) % 5 = 0")
    best, hist = rec.select_best_run(train, val, [{"rank": 2, "max_iter": 8}], movies=movies, emb_cols=["genome_emb_0", "genome_emb_1"])
    run = hist.first()
    mean = train.agg(F.avg("rating")).first()[0]
    flat = val.select(F.sqrt(F.avg(F.pow(F.col("rating") - F.lit(mean), 2)))).first()[0]
    assert run.val_rmse < flat
    best.save(str(tmp_path / "model"))
    again = rec.Recommender.load(spark, str(tmp_path / "model"))
    cold = spark.createDataFrame([(999, 1), (1, 999), (999, 999)], "userId int, movieId int")
    for rows_ in (val.select("userId", "movieId"), cold):
        a = {(r.userId, r.movieId): r.prediction for r in best.transform(rows_).collect()}
        assert a == {(r.userId, r.movieId): r.prediction for r in again.transform(rows_).collect()}
        assert all(0.5 <= p <= 5.0 for p in a.values())


def test_the_row_bound_comes_before_the_known_id_filter(spark):
    log = spark.createDataFrame([(1, 1, 3.0, 1), (1, 2, 3.0, 2), (2, 1, 3.0, 3)], "userId int, movieId int, rating float, timestamp long")
    users, movies = spark.createDataFrame([(1,), (2,)], "userId int"), spark.createDataFrame([(1,)], "movieId int")
    assert [(r.userId, r.movieId) for r in rec.rec_training_table(log, users, movies, max_rows=2).collect()] == [(1, 1)]
