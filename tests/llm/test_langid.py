from pyspark.sql import functions as F

from edge import docs, none

from reelsift.llm import langid
from reelsift.llm.common import crc_mod
from reelsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 250
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.01


def test_edges(spark):
    df = docs(spark, extra=("score", "rejected"))
    model = langid.fit(df, "doc_id", "text", "lang", F.lit(True))
    got = langid.identify(df, model).collect()
    assert len(got) == 10
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (r.rejected or letters)
        assert (r.n_predicted > 0) == letters and 0 <= r.score <= 1
    assert langid.identify(none(spark), model).count() == 0


def test_no_labels_means_no_model(spark):
    df = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(df, "doc_id", "text", "lang", F.lit(True))
    assert model is None
    assert {(r.lang_pred, r.rejected) for r in langid.identify(df, model).collect()} == {("und", False)}


def test_words_of_all_lengths_have_a_probability_of_one():
    from collections import Counter
    from itertools import product

    m = langid.CharModels(["x"], {"x": Counter({"aba": 3, "abb": 2, "ba": 4, "b": 1})}, 3)
    letters = "ab?"  # the last stands for the one symbol more that the model allows for
    open_, closed = 1.0, 0.0  # a share of the words is closed with each length, the rest goes on
    for n in range(7):
        runs = ["".join(x) for x in product(letters, repeat=n)]
        ends = (2.0 ** -m.bits(runs)[:, 0]).sum()
        closed += ends
        assert 0 <= ends <= open_ + 1e-6
        open_ = 1.0 - closed
    assert 0 < closed <= 1 + 1e-6 and open_ < 0.2


def test_scores_do_not_depend_on_the_batches():
    import numpy as np
    from collections import Counter

    m = langid.CharModels(["x", "y"], {"x": Counter({"hello": 5, "hell": 2, "low": 2}), "y": Counter({"bonjour": 4, "jour": 2, "bon": 1})}, 4)
    texts = ["hello low", None, "", "bonjour hello " * 50, "jour", "12 34"]
    whole = langid.score_texts(texts, langid._Words(m))
    one = np.concatenate([langid.score_texts([t], langid._Words(m)) for t in texts])
    assert np.allclose(whole, one)
    best, _, _, n, _ = langid.verdicts(whole, m)
    assert best[0] == 0 and best[4] == 1 and n[1] == n[2] == n[5] == 0


def test_crc_of_ids(spark):
    import zlib

    rows = spark.range(50).select("id", crc_mod(F.col("id"), 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


def test_noise_and_unlearned_languages_are_rejected_where_a_language_has_few_documents(spark):
    import random

    import numpy as np

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    rare = rows.filter("lang = 'es'").orderBy("doc_id").limit(25)
    learned = rows.filter("lang in ('en', 'de')").unionByName(rare)
    model = langid.fit(learned, "doc_id", "text", "lang", F.lit(True))
    assert model.langs == ["de", "en", "es"] and np.isfinite(model.limits).all()
    clean = langid.identify(learned, model).collect()
    assert sum(r.rejected for r in clean) / len(clean) < 0.01
    unlearned = langid.identify(rows.filter("lang = 'fr'"), model).collect()
    assert sum(r.rejected for r in unlearned) / len(unlearned) > 0.9
    rng = random.Random(1)
    noise = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60))) for i in range(50)]
    assert all(r.rejected for r in langid.identify(spark.createDataFrame(noise, "doc_id long, text string"), model).collect())


def test_learning_starts_no_python_workers_but_those_of_arrow(spark, monkeypatch):
    """Before, the drawing rates were a list, which Spark sends through workers of another kind: these stayed beside the others."""
    rows = spark.createDataFrame([(i, ("der hund bellt laut", "the dog barks aloud")[i % 2], ("de", "en")[i % 2]) for i in range(60)],
                                 "doc_id long, text string, lang string")

    def refuse(*a, **k):
        raise AssertionError("a list goes through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    model = langid.fit(rows, "doc_id", "text", "lang", F.lit(True))
    assert model.langs == ["de", "en"]
    assert {(r.lang, r.lang_pred) for r in langid.identify(rows, model).collect()} == {("de", "de"), ("en", "en")}
