import functools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from edge import DOCS, docs, none
from hypothesis import given, settings
from hypothesis import strategies as st

from reelsift.llm import packing
from reelsift.llm.queries import QUERIES, tokenizer_path

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@functools.cache
def known_ids():
    return packing._Ids(tokenizer_path())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, tokenizer):
    """An exact round trip: pieces cover each document, sequences have no gaps, digests agree."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array(whole(tokenizer, text), "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    used = pad = 0
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048 and all(r.padded_length == packing.padded(at) for r in members)
        used, pad = used + at, pad + packing.padded(at) - at
    return pad / (used + pad)


def test_round_trip_over_the_smoke_documents(spark, tokenizer):
    rows = QUERIES["op3_packing"](spark, SMOKE).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    assert check(rows, texts, tokenizer) < 0.02


def test_edges(spark, tokenizer):
    rows = [r for r in packing.pack_documents(docs(spark, extra=("start", "offset", "_group")), tokenizer_path()).collect()]
    assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(len(whole(tokenizer, t)) for _, t, _, _ in DOCS)
    for i in (2, 3, 4):
        assert [r.doc_tokens for r in rows if r.doc_id == i] == [1]
    assert sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert packing.pack_documents(none(spark), tokenizer_path()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sÉéß.,-!́ 　İ 12<|endoftext|>\t\n—가", max_size=40))
def test_words_give_the_ids_of_the_whole_text(text):
    known = known_ids()
    ids = np.frombuffer(packing.token_bytes(text.encode(), known), "<u4").tolist()
    assert ids == whole(known.tokenizer, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_first_fit_decreasing_matches_the_plain_rule(sizes):
    sizes = np.array(sizes)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if b is None:
            b = len(room)
            room.append(100)
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= sizes[i]


def test_null_ids_and_repeated_rows_do_not_fill_one_group(spark):
    from pyspark.sql import functions as F

    null = F.lit(None).cast("long")
    rows = spark.range(4000).select(null.alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 100 + 1).alias("length"),
                                    F.when(F.col("id") < 3000, F.col("id")).otherwise(-1).alias("ids_crc32"), (F.col("id") % 100 + 1).alias("doc_tokens"))
    rows = rows.unionByName(rows.limit(1).withColumn("start", F.explode(F.array_repeat(F.lit(0).cast("long"), 5000))))
    got = packing.pack(rows, group_pieces=300)
    sizes = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()]
    assert sum(sizes) == 9000 and len(sizes) == 30 and max(sizes) < 400
    assert got.select(rows.columns).exceptAll(rows).count() == 0 == rows.exceptAll(got.select(rows.columns)).count()


def test_texts_reach_the_workers_in_small_batches(spark, monkeypatch):
    """Before, batches of 64 MB stood in the executor and in its workers several times."""
    key, limits, cut = "spark.sql.execution.arrow.maxBytesPerBatch", [], packing.cut_lineage
    before = spark.conf.get(key)
    monkeypatch.setattr(packing, "cut_lineage", lambda df, name: limits.append(spark.conf.get(key)) or cut(df, name))
    spark.conf.set(key, str(64 << 20))
    try:
        df = spark.createDataFrame([(i, "a b " * i) for i in range(40)], "doc_id long, text string")
        got = packing.pack_documents(df, tokenizer_path()).groupBy("doc_id").sum("length").collect()
        assert limits == [str(2 << 20)] and spark.conf.get(key) == str(64 << 20)
        assert sorted(tuple(r) for r in got) == [(i, 2 * i + 1) for i in range(40)]
    finally:
        spark.conf.set(key, before)
