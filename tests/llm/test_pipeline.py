"""Each stage is held against a plain version on the stage's own input."""

import re
from collections import Counter, defaultdict

import pytest
from edge import docs, none
from test_ngram_join import brute as jaccard
from test_packing import check as packed

import corpus_pipeline as cp
from reelsift.llm import mixing
from reelsift.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of each stage over the documents."""
    df, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = cp.cut_lineage(stage(spark, df, SF), "stage")
        out.append((name, df, after))
        df = after
    return out


def test_stages_and_columns(stages):
    assert [n for n, *_ in stages] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing to target weights", "packing"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    _, before, after = stages[0]
    assert after.count() >= 0.995 * before.count()
    assert set(after.collect()) <= set(before.collect())


def test_exact_stage(stages):
    _, before, after = stages[1]
    first = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(after.collect()) == sorted(first.values())


def test_near_stage(stages):
    _, before, after = stages[2]
    rows = before.collect()
    keep = {i for i, _, c in jaccard([(r.doc_id, r.text) for r in rows], 5, 4, 5) if i == c}
    assert sorted(after.collect()) == sorted(r for r in rows if r.doc_id in keep)


def test_near_stage_keeps_rows_that_share_an_id_or_have_none(spark):
    a = " ".join(f"a{i}" for i in range(60))
    near, other, more = a + " end", " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    rows = [(2, a, "en", "s"), (5, near, "en", "s"), (5, other, "en", "s"), (7, more, "en", "s"), (None, a + " tail", None, None),
            (None, other + " tail", "en", None), (9, "", "en", None), (10, None, None, None), (11, more, "en", "s"), (7, more, "en", "s"), (8, more + " x", "en", "s")]
    got = cp.near_stage(spark, docs(spark, rows), SF).collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], rows[2], rows[3], rows[6], rows[7]])
    alone = [(None, a, "en", "s"), (None, near, "en", "s"), (None, more, "en", "s")]
    got = cp.near_stage(spark, docs(spark, alone), SF).collect()
    assert len(got) == 2 and alone[2] in map(tuple, got)
    assert cp.near_stage(spark, none(spark), SF).count() == 0


def test_mixing_stage(stages):
    _, before, after = stages[3]
    size = lambda r: len((r.text or "").encode().split())
    whole, taken, copies = defaultdict(int), defaultdict(int), Counter(after.collect())
    for r in before.collect():
        whole[r.source] += size(r)
        assert copies[r] <= 2
    for r, n in copies.items():
        taken[r.source] += n * size(r)
    for s, due in mixing.targets(dict(whole)).items():
        assert abs(taken[s] - due) <= 0.005 * due + 10


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    _, before, after = stages[4]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows, copies = after.collect(), Counter(r.doc_id for r in before.collect())
    assert Counter(r.doc_id for r in rows if r.start == 0) == copies
    texts = {r.doc_id: r.text for r in before.collect()}
    once = {i: t for i, t in texts.items() if copies[i] == 1}
    assert packed(rows, once, tokenizer) < 0.02


def test_run_and_odd_tables(spark, tmp_path):
    base = str(tmp_path)
    docs(spark).write.parquet(f"{base}/documents.parquet")
    got = cp.run(spark, base).collect()
    assert {r.doc_id for r in got} <= {1, 5, 6, None} and got
    none(spark).write.parquet(f"{base}/none/documents.parquet")
    assert cp.run(spark, f"{base}/none").count() == 0
