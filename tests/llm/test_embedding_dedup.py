import numpy as np
from pyspark.sql import functions as F

from reelsift.llm import embedding_dedup as e


def families(n=700, dim=32, seed=1):
    """Loners, families around a centre at cosines on both sides of 0.9, and equal vectors."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = list(unit(rng.standard_normal((n, dim))))
    for _ in range(25):
        c = unit(rng.standard_normal(dim))
        near = rng.standard_normal((12, dim))
        near = unit(near - (near @ c)[:, None] * c)
        cos = rng.uniform(0.85, 0.999, 12)[:, None]
        rows += list(cos * c + np.sqrt(1 - cos**2) * near) + [c]
    rows += [rows[5]] * 30 + [rows[-40] * 3.0] * 2
    return np.array(rows)


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (u @ u.T >= threshold) & ~np.eye(len(x), dtype=bool)


def run(spark, x, **how):
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    return {r.vec_id: r for r in e.near_duplicates(df, **how).collect()}


def test_recall_against_brute_force(spark):
    x = families()
    link, got = brute(x), run(spark, x)
    n = link.sum(1)
    assert all(got[i].n_links <= n[i] for i in range(len(x)))  # no link below the threshold, none twice
    assert sum(got[i].n_links for i in got) >= 0.97 * n.sum()
    comp = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(1))
        if (low == comp).all():
            break
        comp = low
    assert np.mean([got[i].component_id == comp[i] for i in got]) >= 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_crowded_filters_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    x = centre + rng.standard_normal((120, 16)) * 0.05
    link = brute(x)
    monkeypatch.setattr(e, "BLOCK_ROWS", 20)
    got = run(spark, x)
    assert [got[i].n_links for i in range(120)] == link.sum(1).tolist()
    assert {r.component_id for r in got.values()} == {0}


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1e-3]), (10, [1e300, 0.0]), (11, [-1.0, 0.0]), (12, [1e-300, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"kept": F.lit("clash"), "n_links": F.lit("x"), "label": F.lit(1)})
    got = e.near_duplicates(df)
    assert got.columns == ["vec_id", "embedding", "label", "n_links", "component_id", "kept"]
    by = {}
    for r in got.collect():
        by.setdefault(r.vec_id, []).append(r)
    assert all(r.n_links == 0 and r.component_id == i and r.kept for i in (3, 4, 5, 6, 7, 8, 9, 11) for r in by[i])
    assert all(r.n_links == 5 and r.component_id == 1 for i in (1, 2, None, 10, 12) for r in by[i])
    assert e.near_duplicates(df.limit(0)).count() == 0
    assert e.near_duplicates(df.filter("vec_id = 3")).count() == 1


def test_list_decoding_finds_exactly_the_filters_passed():
    f = e.Filters(8, 2.0, 3, 5, 2, 4)
    x = np.random.default_rng(0).standard_normal((40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = f.books()
    got = set(zip(*(a.tolist() for a in f.decode(x, books)), strict=True))
    want = set()
    for which, (rotation, parts) in enumerate(books):
        y = x @ rotation
        for i in range(5):
            for j in range(5):
                for k in range(5):
                    direction = np.r_[parts[0][:, i], parts[1][:, j], parts[2][:, k]]
                    want |= {(r, ((which * 5 + i) * 5 + j) * 5 + k) for r in np.flatnonzero(y @ direction >= 2.0).tolist()}
    assert got == want
