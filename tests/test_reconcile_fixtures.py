"""Reconciliation edge rows (FIXTURES §3): canonical id, id remap ranges, duplicate flags."""

from reelsift.plans import reconcile as rc

M = "movieId int, title string, genres string"
R = "userId int, movieId int, rating float, timestamp long"
M2 = "movieId int, title string, genres string, release_date string"


def test_canonical_id_is_smallest(spark):
    unified = spark.createDataFrame([(5, "Heat (1995)", "A"), (3, "heat! (1995)", "A"), (9, "Other (2000)", "B"),
                                     (101, "HEAT (1995)", "A"), (102, "Nothing (1990)", "C")], M)
    m = {r.old_id: r.new_id for r in rc.canonical_map(unified, 100).collect()}
    assert m == {101: 3}


def test_remap_ranges_and_clip(spark):
    m1 = spark.createDataFrame([(1, "Heat (1995)", "A"), (7, "Up (2009)", "B")], M)
    r1 = spark.createDataFrame([(10, 1, 4.0, 1), (12, 9, 3.0, 2)], R)
    m2 = spark.createDataFrame([(500, "heat", "A", "1995-05-01"), (300, "Down", "B", "bad-date")], M2)
    r2 = spark.createDataFrame([(77, 500, 5.5, 3), (66, 300, 0.2, 4)], R)
    movies, ratings, dup, mmap, umap = rc.merge_sources(m1, r1, m2, r2)
    assert sorted((r.old_id, r.new_id) for r in mmap.collect()) == [(300, 10), (500, 11)]  # after max(7, 9)
    assert sorted((r.old_id, r.new_id) for r in umap.collect()) == [(66, 13), (77, 14)]    # after max user 12
    second = ratings.where("source = 'tmdb'")
    assert sorted((r.userId, r.movieId, r.rating) for r in second.collect()) == [(13, 10, 0.5), (14, 11, 5.0)]
    assert ratings.count() == 4 and movies.count() == 4
    assert [tuple(r) for r in dup.collect()] == [("heat", 1995)]
    assert {(r.source, r.movieId): r.is_duplicate_title_year for r in movies.collect()} == {
        ("movielens", 1): True, ("movielens", 7): False, ("tmdb", 11): True, ("tmdb", 10): False}


def test_output_samples(spark, tmp_path):
    import json

    from reelsift.sources.sinks import output_samples
    spark.range(20).selectExpr("id", "id * 2 as twice").repartition(3).write.parquet(str(tmp_path / "a"))
    got = output_samples(spark, {"a": str(tmp_path / "a")}, 5).collect()
    assert [(r.output, json.loads(r.row)) for r in got] == [("a", {"id": i, "twice": 2 * i}) for i in range(5)]


def test_missing_embedding_is_zero(spark):
    from reelsift.plans.features import movie_features
    ratings = spark.createDataFrame([(1, 1, 4.0, 1), (1, 2, 3.0, 2)], R)
    movies = spark.createDataFrame([(1, "A (2000)", "X"), (2, "B (2001)", "Y")], M)
    embs = spark.createDataFrame([(1, 0.5, -0.25)], "movieId int, genome_emb_0 float, genome_emb_1 float")
    got = {r.movieId: (r.genome_emb_0, r.genome_emb_1) for r in movie_features(ratings, movies, embs).collect()}
    assert got == {1: (0.5, -0.25), 2: (0.0, 0.0)}
