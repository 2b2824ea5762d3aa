"""Streaming twins over several micro-batches equal their batch operators."""

import os
import tempfile

from pyspark.sql import functions as F

from reelsift import adapt
from reelsift.operators.aggregates import user_stats
from reelsift.operators.windows import recent_items
from reelsift.streaming import jobs as ss

SF = "/root/testdata/sf0.001"
SCHEMA = "userId int, movieId int, rating float, timestamp long"


def _three_batches(spark):
    d = tempfile.mkdtemp(prefix="reelsift-sb-")
    r = adapt.ratings(spark, SF)
    # split by a hash of the whole row so each batch mixes users and times
    h = F.pmod(F.xxhash64("userId", "movieId", "rating", "timestamp"), F.lit(3))
    for i in range(3):
        r.where(h == i).coalesce(1).write.parquet(os.path.join(d, "in", f"p{i}"))
    src = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .parquet(os.path.join(d, "in")))
    return r, src, d


def _rows(df):
    return sorted(tuple(x) for x in df.collect())


def test_recent_items_state_across_batches(spark):
    r, src, d = _three_batches(spark)
    q = ss.run_recent_items(src, os.path.join(d, "out"))
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3
    got = ss.recent_items_now(spark, os.path.join(d, "out"))
    assert _rows(got) == _rows(recent_items(r))


def test_user_stats_across_batches(spark):
    r, src, d = _three_batches(spark)
    ss.run_available(ss.stream_user_stats(src), os.path.join(d, "out"), keys=["userId"])
    got = ss.current(spark, os.path.join(d, "out"), ["userId"])
    cols = ["userId", "total_ratings", "avg_rating", "rating_std", "min_rating", "max_rating", "avg_reward"]
    rnd = [F.round(c, 9).alias(c) if c not in ("userId", "total_ratings") else F.col(c) for c in cols]
    assert _rows(got.select(*rnd)) == _rows(user_stats(r).select(*rnd))


def test_dedup_across_batches(spark):
    r, src, d = _three_batches(spark)
    twice = src.unionByName(src.where(F.col("rating") == 5.0))  # in any order over all years
    ss.run_available(ss.stream_dedup(twice, "36500 days"), os.path.join(d, "out"), mode="append")
    assert _rows(spark.read.parquet(os.path.join(d, "out", "data"))) == _rows(r)


def test_dedup_with_its_own_delay_loses_late_rows_and_the_anti_join_finds_them(spark):
    d = tempfile.mkdtemp(prefix="reelsift-late-")
    day, schema = 86400, "userId long, movieId long, rating double, timestamp long"
    batches = [[(1, 1, 4.0, 1000 * day), (1, 1, 4.0, 1000 * day)], [(2, 1, 3.0, 1010 * day), (1, 1, 4.0, 1000 * day)],
               [(3, 1, 2.0, 900 * day), (4, 1, 2.0, 990 * day)]]  # 110 and 20 days behind the newest
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in"))
    ss.run_available(ss.stream_dedup(src), os.path.join(d, "out"), mode="append")
    kept = spark.read.parquet(os.path.join(d, "out", "data"))
    assert _rows(kept) == [(1, 1, 4.0, 1000 * day), (2, 1, 3.0, 1010 * day), (4, 1, 2.0, 990 * day)]
    whole = spark.read.parquet(os.path.join(d, "in"))
    assert _rows(ss.late_ratings(whole, kept)) == [(3, 1, 2.0, 900 * day)]


def test_late_dedup_batches_are_written_by_all_tasks(spark, monkeypatch):
    """No batch of stream_dedup_late passes through one task, and both sides are whole."""
    import os

    from reelsift import adapt
    from reelsift.queries import streams

    rows = [(u, m, 5.0 if u % 3 == 0 else 3.0, 86400 * (100 * (m % 3 == 0) + u)) for u in range(40) for m in range(12)]
    r = spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp long").repartition(4)
    made, scratch = [], streams.ss.scratch
    monkeypatch.setattr(adapt, "ratings", lambda spark, sf: r)
    monkeypatch.setattr(streams.ss, "scratch", lambda spark, name: made.append(scratch(spark, name)) or made[-1])
    got = sorted((x.userId, x.movieId, x.rating, x.timestamp, x.late) for x in streams.q_stream_dedup_late(spark, "nowhere").collect())
    newest, want = None, []
    for i in range(3):
        own = [x for x in rows if x[1] % 3 == i]
        want += [(*x, newest is not None and x[3] < newest - 30 * 86400) for x in own]
        newest = max([x[3] for x in own] + ([newest] if newest is not None else []))
    assert got == sorted(want) and any(x[-1] for x in want)
    for i in range(3):
        folder = f"{made[0]}/in/{i}".removeprefix("file:")
        assert sum(f.endswith(".parquet") for f in os.listdir(folder)) > 1
