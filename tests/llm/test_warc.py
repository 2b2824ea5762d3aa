import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from reelsift.llm import warc
from reelsift.llm.queries import QUERIES

SMOKE = "/root/testdata/sf0.001"
BIG = "<p>" + "same " * 50 + "</p>"


def brute(rows):
    out = []
    for i, html in rows:
        body = (html or "").encode()
        first = min(j for j, h in rows if j is not None and (h or "") == (html or "")) if i is not None else None
        again = len(body) >= 100 and i is not None and i > first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def back(spark, pages):
    got = warc.read_archives(warc.archive(pages), with_payload=False)
    return sorted(((int(r.record_id) if r.record_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None)
                   for r in got.collect()), key=str)


def test_edges_round_trip(spark):
    rows = [(3, "http://a/\r\nX: y", BIG), (1, "http://b/ü", BIG), (2, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (9, "u", "é" * 60), (10, "u", "é" * 60), (11, "u", "x" * 300_000), (None, "u", BIG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    want = brute([(i, h) for i, _, h in rows if i is not None]) + [(None, len(BIG), hashlib.sha256(BIG.encode()).hexdigest(), "response", None)]
    assert back(spark, pages) == sorted(want, key=str)


def test_payloads_come_back_whole(spark):
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    manifest = warc.archive(pages)
    got = {int(r.record_id): r for r in warc.read_archives(manifest).collect()}
    for r in pages.collect():
        assert got[r.page_id].payload.decode() == r.html and got[r.page_id].target_uri == r.url
    path = manifest.first().path.replace("file:", "")
    whole = gzip.open(path).read()  # a plain gzip reader sees the members as one stream
    assert whole.count(b"WARC-Record-ID: ") >= manifest.first().records


def test_empty_table(spark):
    assert QUERIES  # the query reads the same functions
    assert back(spark, spark.createDataFrame([], "page_id long, url string, html string")) == []


def archive(*records):
    return b"".join(warc.member(r) for r in records)


def record(body=b"payload", **how):
    return warc.record_bytes(1, "u", body, hashlib.sha256(body).hexdigest(), **how)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_chunks_of_any_size_give_the_same_records(chunk):
    data = archive(record(b"a" * 1000), record(b""), record(b"b\r\n\r\nc"))
    assert [body for *_, body in warc.read_records(io.BytesIO(data), chunk)] == [b"a" * 1000, b"", b"b\r\n\r\nc"]


def test_damage_is_found():
    good = record()
    for bad in (good.replace(b"payload", b"pay1oad"), good.replace(b"Content-Length: 89", b"Content-Length: 88") if b"Content-Length: 89" in good else good[:-1],
                good[:-4], good + b"x", good.replace(b"WARC/1.1", b"JUNK/1.1", 1)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(archive(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(archive(good)[:-9])))
    assert list(warc.read_records(io.BytesIO(b""))) == []
