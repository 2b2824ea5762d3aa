"""Substring dedup against counted windows, and the FM-index against plain search."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import edge
from reelsift.llm import substring_dedup as sd


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def check(spark, texts, window=35):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sd.remove_repeats(df, window=window).collect()}
    assert len(got) == len(texts)
    for i, (n, gone, kept) in enumerate(plain(texts, window)):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, gone, kept)
        assert sum(s.length for s in r.removed) == gone and all(s.start + s.length <= n for s in r.removed)
        words = (texts[i] or "").split()
        left = [w for k, w in enumerate(words) if not any(s.start <= k < s.start + s.length for s in r.removed)]
        assert " ".join(left) == kept


def made(seed, docs=40, vocabulary=400):
    """Texts that quote shared passages whole, cut, with a changed word, or twice in a row."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [draw.choices(words, k=n) for n in (34, 35, 36, 50, 70, 120, 300)]
    texts = []
    for _ in range(docs):
        out = []
        for _ in range(draw.randrange(4)):
            out += draw.choices(words, k=draw.randrange(60))
            p = list(draw.choice(passages))
            if draw.random() < 0.5:
                p = p[draw.randrange(len(p)):] + p[:draw.randrange(len(p))]
            if draw.random() < 0.3:
                p[draw.randrange(len(p))] = "Changed"
            out += p * draw.choice([1, 1, 1, 2])
        texts.append((" \t\n"[draw.randrange(3)]).join(out))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages(spark, seed):
    check(spark, made(seed))


def test_edges(spark):
    ring = " ".join(["a", "b", "c"] * 20)  # periodic: repeats inside itself
    varied = " ".join(f"v{i}" for i in range(30_000))
    check(spark, [None, "", " \t\n", edge.LONG, ring, "one " * 34, "two " * 35, "three " * 36, varied, varied[5000:90_000], "Case " * 36, "case " * 36])


def test_few_words(spark):
    """Two words only: nearly all minimizers are shared and runs overlap in every way."""
    draw = random.Random(5)
    check(spark, [" ".join(draw.choices("ab", k=draw.randrange(90))) for _ in range(25)], window=12)


def test_crowd(spark, monkeypatch):
    """A passage quoted by more texts than ``CROWD``, each with its own neighbours."""
    monkeypatch.setattr(sd, "CROWD", 8)
    draw = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    own = lambda: [f"x{draw.randrange(10**9)}" for _ in range(40)]
    check(spark, [" ".join(own() + passage[draw.randrange(4):] + own()) for _ in range(40)] + made(7, 10))


def test_names_and_empty(spark):
    got = sd.remove_repeats(edge.docs(spark, extra=["n_words", "marks", "KEPT_TEXT"]))
    assert got.columns == ["doc_id", "lang", "source", "n_words", "n_removed", "removed", "kept_text"]
    assert got.count() == len(edge.DOCS)
    assert sd.remove_repeats(edge.none(spark)).count() == 0


def test_window_bounds(spark):
    with pytest.raises(ValueError):
        sd.remove_repeats(edge.docs(spark), window=36)


def test_fm_index():
    draw = np.random.default_rng(3)
    ids = draw.integers(1, 5, 700)
    ids[[150, 400, 699]] = 0
    fm = sd.FMIndex(ids, depth=64)
    text = ids.tolist()

    def times(p, e):
        part = text[p:e + 1]
        return sum(text[i:i + len(part)] == part for i in range(len(text) - len(part) + 1))

    low, high = fm.step(np.array([2]), np.array([fm.before[3]]), np.array([fm.before[4]]))
    assert high[0] - low[0] == sum(text[i:i + 2] == [2, 3] for i in range(len(text) - 1))
    ends, stops = np.array([30, 149, 300, 650]), np.array([0, 110, 290, 600])
    for e, s, p in zip(ends, stops, fm.reach(ends, stops)):
        assert p == e + 1 and times(e, e) < 2 or times(p, e) >= 2 and (p == s or times(p - 1, e) < 2)


def test_registered_query_counts(spark):
    from reelsift.llm.queries import QUERIES

    got = QUERIES["op13_substring_dedup"](spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    import hashlib

    want = {(d.doc_id, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, (n, g, t) in zip(docs, plain([d.text for d in docs], 35))}
    assert {tuple(r) for r in got.collect()} == want
    assert got.agg(F.sum("n_removed")).first()[0] > 0
