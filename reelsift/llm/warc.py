"""WARC archives: one gzip member per record, written by tasks, read back in sequence.

Writing: payloads of at least ``MIN_REVISIT`` bytes that repeat are stored once, by the record with
the smallest id; the others become ``revisit`` records that name it. Each task writes its records
to archives of about ``ROTATE`` bytes in the shared folder; their names hold the task attempt, and
only the archives in the returned manifest (a written table) count, so a lost or repeated task
leaves nothing but unused files behind.

Reading: each archive is streamed in small chunks through ``zlib``; a record's header ends at the
empty line, its block is framed by Content-Length, and block and payload digests are verified.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import cut_lineage, ensure_checkpoint_dir

MIN_REVISIT = 100
ROTATE = 64 << 20
CHUNK = 1 << 16
MAX_HEADER = 1 << 20
GZIP = 31  # zlib's window bits for one gzip member
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-record:"


class WarcError(ValueError):
    """A record that breaks the framing or fails its digest."""


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, digest, first): ``first`` is the record that holds the payload if this
    one only revisits it. Among equal payloads of ``MIN_REVISIT`` bytes or more the smallest id is
    the response; rows that repeat that id, and rows without an id, are responses too."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                        payload(F.col(f"`{payload_col}`")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = cut_lineage(rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
                           .agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "payloads")
    return rows.join(repeated, "digest", "left").withColumn("first", F.when(F.col("id") > F.col("first"), F.col("first")))


def record_bytes(id_: object, url: str | None, body: bytes, digest: str, first: object = None) -> bytes:
    """One record: a response, or a revisit that keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if first is not None else http + body
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{'' if id_ is None else id_}>",
             f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{first}>"]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}",
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return z.compress(record) + z.flush()


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC header, HTTP header, payload) of each record of an archive, in order. Holds one record
    at a time. Raises :class:`WarcError` on broken framing or a digest that doesn't match."""
    rest = stream.read(chunk)
    while rest:
        z = zlib.decompressobj(GZIP)
        held, header, need = bytearray(), None, None
        while True:  # one gzip member
            try:
                held += z.decompress(rest)
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from None
            if header is None and (end := held.find(b"\r\n\r\n")) >= 0:
                if not held.startswith(b"WARC/"):
                    raise WarcError("no WARC version line")
                header = _headers(bytes(held[:end]))
                if not header.get("content-length", "").isdigit():
                    raise WarcError("no content length")
                need = int(header["content-length"])
                del held[:end + 4]
            if header is None and len(held) > MAX_HEADER:
                raise WarcError("header without an end")
            if need is not None and len(held) > need + 4:
                raise WarcError("bytes beyond the content length")
            if z.eof:
                rest = z.unused_data or stream.read(chunk)
                break
            rest = stream.read(chunk)
            if not rest:
                raise WarcError("the archive ends within a record")
        if need is None or len(held) != need + 4 or held[need:] != b"\r\n\r\n":
            raise WarcError("the block is shorter than its content length")
        block = bytes(held[:need])
        _verify(header.get("warc-block-digest"), block)
        http, _, body = block.partition(b"\r\n\r\n")
        if header.get("warc-type") == "response":
            _verify(header.get("warc-payload-digest"), body)
        yield header, _headers(http), body


def _verify(digest: str | None, data: bytes) -> None:
    if digest:
        kind, _, value = digest.partition(":")
        if hashlib.new(kind, data).hexdigest() != value.lower():
            raise WarcError(f"digest mismatch: {digest}")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_archives(rows: DataFrame, folder: str, rotate: int = ROTATE) -> DataFrame:
    """Write (id, url, payload, digest, first) rows as archives below ``folder``, a folder that all
    executors share. Returns the written manifest (path, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        done, out, records, size, path = [], None, 0, 0, ""
        filesystem, root = _open(folder)
        for b in batches:
            for id_, url, body, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    filesystem.create_dir(root, recursive=True)
                    out = filesystem.open_output_stream(path, compression=None)  # not by the name: members are made here
                data = member(record_bytes(id_, url, body, digest, first))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= rotate:
                    out.close()
                    done.append((path.rsplit("/", 1)[1], records, size))
                    out, records, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((path.rsplit("/", 1)[1], records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _, _ in done]), pa.array([n for _, n, _ in done], pa.int64()),
                                              pa.array([n for _, _, n in done], pa.int64())], names=["path", "records", "bytes"])

    return cut_lineage(rows.select("id", "url", "payload", "digest", "first")
                       .mapInArrow(write, "path string, records long, bytes long"), "manifest")


READ_SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
               "payload_digest string, payload binary")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest.path``, an archive a task. A revisit has
    no payload of its own: its length and digest are those of the payload it stands for."""
    files = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                filesystem, name = _open(path)
                rows, size = [], 0
                with filesystem.open_input_stream(name, compression=None) as stream:
                    for head, http, body in read_records(stream):
                        clean = lambda k: re.sub(rf"^<{NAME}|>$", "", head[k]) if k in head else None
                        revisit = head["warc-type"] == "revisit"
                        rows.append((clean("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), clean("warc-refers-to"),
                                     int(http["content-length"]) if revisit else len(body),
                                     head["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(body).hexdigest(),
                                     body if with_payload and not revisit else None))
                        size += len(body)
                        if size >= 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(read, READ_SCHEMA)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row of ``pages`` to archives in a new shared folder; returns the manifest.
    A null payload is empty, a null url has no header, and an empty table writes no archive."""
    import uuid

    folder = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    return write_archives(mark_revisits(pages, id_col, url_col, payload_col), folder)
