import random

import pytest

from reelsift.llm.common import connected_components, cut_lineage, free, without


def brute(edges):
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


CASES = {
    "chain": [(i, i + 1) for i in range(200)],
    "shuffled chain": list(zip(random.Random(3).sample(range(200), 200), random.Random(3).sample(range(200), 200)[1:], strict=False)),
    "star": [(150, i) for i in range(100)],
    "random": [(random.Random(i).randrange(300), random.Random(-i).randrange(300)) for i in range(150)],
    "repeated": [(1, 2), (2, 1), (1, 2), (-5, 2), (8, 9)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = CASES[name]
    got = {r.v: r.c for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_without_ignores_case(spark):
    assert without(spark.createDataFrame([(1, 2)], "a int, B int"), ["b"]).columns == ["a"]


def test_free_deletes_written_tables_only(spark, tmp_path):
    import os

    kept = str(tmp_path / "kept")
    spark.range(5).write.parquet(kept)
    table, outside = cut_lineage(spark.range(5).toDF("a"), "gone"), spark.read.parquet(kept)
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.exists(folder.replace("//", "/"))
    free(table.select("a"), outside, shuffles=True)
    assert not os.path.exists(folder.replace("//", "/")) and outside.count() == 5
