"""The keyed sink over many batches and replays, and dedup with a late table."""

import os
import random

from pyspark.sql import functions as F

from reelsift.streaming import jobs as ss
from reelsift.streaming.keyed import FAN_OUT, KeyedTable

DAY = 86400


def _files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_fifty_batches_stay_few_files_and_equal_the_last_rows(spark, tmp_path):
    draw, want = random.Random(1), {}
    table = KeyedTable(spark, str(tmp_path), ["k"])
    assert table.now() is None
    for batch in range(50):
        rows = {draw.choice([None, *range(40)]): draw.random() for _ in range(6)}
        want.update(rows)
        df = spark.createDataFrame(list(rows.items()), "k int, v double").coalesce(1)
        assert table.upsert(df, batch)
        if batch in (7, 35):  # replayed, also with other rows: counts once
            assert not table.upsert(df.withColumn("v", F.lit(-1.0)), batch)
        assert len(table.manifest()["runs"]) <= 3 * FAN_OUT
    assert {r.k: r.v for r in table.now().collect()} == want
    assert len(os.listdir(tmp_path / "runs")) <= 6 * FAN_OUT and len([f for f in os.listdir(tmp_path / "manifests") if f.endswith(".json")]) <= 3


def test_a_batch_that_did_not_commit_does_not_count(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), ["k"])
    table.upsert(spark.createDataFrame([(1, 1.0)], "k int, v double"), 0)
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
    try:
        table.upsert(spark.createDataFrame([(1, 2.0)], "k int, v double"), 1)
    except OSError:
        pass
    monkeypatch.undo()
    assert table.now().collect()[0].v == 1.0
    assert table.upsert(spark.createDataFrame([(1, 3.0)], "k int, v double"), 1) and table.now().collect()[0].v == 3.0
    table.upsert(spark.createDataFrame([(2, 3.0)], "k int, v double"), 2)
    assert len(os.listdir(tmp_path / "runs")) <= 4  # the lost one is gone


def _stream(spark, tmp_path, batches, schema="userId int, movieId int, rating float, timestamp long"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_late_rows_come_out_once(spark, tmp_path):
    a, b, c = (1, 1, 4.0, 1000 * DAY), (2, 1, 3.0, 1010 * DAY), (3, 1, 2.0, 900 * DAY)
    src = _stream(spark, tmp_path, [[a, a], [b, a], [c, (4, 1, 2.0, 990 * DAY), c], [c, (5, 5, 1.0, 1100 * DAY), (None, None, None, None)],
                                    [a, (6, 6, 1.0, 1000 * DAY), c, (None, None, None, None)]])
    out = str(tmp_path / "out")
    ss.run_dedup(src, out)
    got = {(r.userId, r.timestamp): r.late for r in ss.dedup_rows_now(spark, out).collect()}
    assert ss.dedup_rows_now(spark, out).count() == len(got) == 7
    assert got == {(1, 1000 * DAY): False, (2, 1010 * DAY): False, (3, 900 * DAY): True, (4, 990 * DAY): False, (5, 1100 * DAY): False,
                   (None, None): False, (6, 1000 * DAY): True}


def test_state_is_bounded_by_the_delay(spark, tmp_path):
    """Forty days of new ratings with a delay of three: the state holds a few days of them."""
    batches = [[(u, d, 3.0, d * DAY + u) for u in range(20)] for d in range(40)]
    out = str(tmp_path / "out")
    ss.run_dedup(_stream(spark, tmp_path, batches), out, delay_days=3)
    table = KeyedTable(spark, out + "/seen", ss.RATING_KEY)
    assert ss.dedup_rows_now(spark, out).count() == 800
    assert table.now().count() <= 20 * (3 + 2 * FAN_OUT)
