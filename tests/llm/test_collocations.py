"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

import edge
from reelsift.llm import collocations as co
from reelsift.llm import filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, longest=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in some.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in some.items():
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not (inside[p] and 100 * inside[p] >= 100 * a):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def check(spark, rows, least, top=2000, longest=5):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(df, least=least, top=top, longest=longest).collect())
    assert got == plain(rows, least, top, longest)
    return got


def made(seed, docs=60, vocabulary=25):
    draw = random.Random(seed)
    words = [f"{'Aé'[i % 2]}w{i}" for i in range(vocabulary)] + ["New", "York", "new", "\x01", "É"]
    fixed = [draw.choices(words, k=draw.randrange(2, 9)) for _ in range(6)]
    rows = []
    for _ in range(docs):
        out = []
        for _ in range(draw.randrange(60)):
            out += draw.choice(fixed) if draw.random() < 0.5 else [draw.choice(words)]
            out += [draw.choice([".", ",", "\n", "?!", ""])] if draw.random() < 0.2 else []
        rows.append((draw.choice([" ", "\t", "  "]).join(out), draw.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed,least,longest", [(1, 3, 5), (2, 8, 5), (3, 1, 4), (4, 5, 2)])
def test_against_counting(spark, seed, least, longest):
    assert check(spark, made(seed), least, longest=longest)


def test_top_and_ties(spark):
    assert len(check(spark, made(9), 3, top=5)) <= 20


def test_copies_weigh(spark):
    text = " ".join(f"c{i % 41}" for i in range(300))
    check(spark, [(text, "en")] * 30 + [(text + " more words here", "en")] * 7, 7)


def test_edges(spark):
    varied = " ".join(f"v{i}" for i in range(30_000))
    check(spark, [(None, None), ("", "en"), (" \t\n", "en"), (edge.LONG, "en"), (varied, "en"), (varied, None), ("a,b;a b", None), ("...", "fr")], 2)
    assert co.collocations(edge.none(spark)).count() == 0
    assert co.collocations(edge.docs(spark, extra=["rank", "phrase", "n", "a"]), least=2).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError):
        co.collocations(edge.none(spark), longest=6)


def test_overfull_filter_only_costs_time(spark, monkeypatch):
    """With a filter of one block all bits are soon set; the counts stay right."""
    monkeypatch.setattr(filters, "MAX_BITS", 1 << 19)
    monkeypatch.setattr(filters, "BITS_EACH", 1 << 20)
    monkeypatch.setattr(filters, "HELD", 50)
    monkeypatch.setattr(filters, "BUCKET", 500)
    check(spark, made(11), 4)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r in decimals of 38 digits."""
    from pyspark.sql import functions as F

    big = 3_000_000_019
    cols = {c: F.lit(v).cast("decimal(18,0)") for c, v in dict(a=big, n=7 * big, l=big + 2, r=big + 5).items()}
    df = spark.range(1).withColumn("upper", (F.lit(1000).cast("decimal(4,0)") * cols["a"]).cast("decimal(25,0)") * cols["n"]).withColumn("lower", cols["l"] * cols["r"])
    assert df.select(F.expr("upper div lower")).first()[0] == 1000 * big * 7 * big // ((big + 2) * (big + 5))


def test_phrases_are_summed_in_streams(spark, monkeypatch):
    """Counts of many small shipments in several buckets; a row with a null phrase has sums of all counts."""
    import pyarrow as pa

    monkeypatch.setattr(filters, "HELD_PHRASES", 40)
    monkeypatch.setattr(filters, "BUCKET", 100)
    draw = random.Random(3)
    rows = [(draw.choice(["en", "de"]), f"{'é' * draw.randrange(1, 4)} {draw.randrange(90)}", draw.randrange(1, 4)) for _ in range(3000)]
    want, sums = Counter(), Counter()
    for lang, phrase, n in rows:
        want[lang, phrase] += n
        sums[lang] += n

    def of(batch):
        yield pa.Table.from_batches([batch])

    df = spark.createDataFrame(rows, "lang string, phrase string, n long").repartition(3)
    got = filters.frequent_phrases(df, of, 30, 300, "test").collect()
    assert {(r.lang, r.phrase): r.n for r in got if r.phrase} == {k: n for k, n in want.items() if n >= 30}
    found = Counter()
    for r in got:
        if r.phrase is None:
            assert r.n is None
            found[r.lang] += r.words
    assert found == sums
    assert filters.frequent_phrases(df.limit(0), of, 30, 0, "test").count() == 0


def test_text_keys():
    """A slice has the keys of the whole; different texts differ, empty ones do not fail."""
    import numpy as np
    import pyarrow as pa
    from reelsift.llm.tokens import text_keys

    words = pa.array(["", "a", "b", "ab", "ba", "aa", "é", "\x00", "\x00\x00", "x" * 50_000, ""])
    keys = text_keys(words)
    assert len(set(keys.tolist())) == len(words) - 1 and keys[0] == keys[-1]
    assert np.array_equal(text_keys(words.slice(3, 5)), keys[3:8]) and not len(text_keys(words.slice(0, 0)))
