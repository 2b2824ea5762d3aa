"""Hashes that occur often, counted in blocks; and bitmaps of hashes, known to every task and of bounded size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import cut_lineage, give_back, trimmed
from reelsift.llm.tokens import mixed, text_keys

#: Different hashes that a task counts before it passes them on, and hashes of a bucket on average.
HELD, BUCKET = 4_000_000, 500_000

#: Different phrases that a task counts before it passes them on.
HELD_PHRASES = 1_000_000

#: Bits of a filter at most (32 MB), and bits for each of its entries below that.
MAX_BITS, BITS_EACH = 1 << 28, 32


class Filter:
    """``bits`` (a power of two) bits from blocks of 64 KB. What was put in is found; of the rest, a share
    that grows with the entries is found as well."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        whole = bytearray(bits // 8)
        for i, raw in blocks.items():
            whole[i << 16:(i << 16) + len(raw)] = raw
        self.map = np.frombuffer(bytes(whole), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def broadcast_filter(hashes: DataFrame, count: int, bits_each: int | None = None):
    """A broadcast :class:`Filter` of the longs ``h``; its size follows their number up to MAX_BITS."""
    bits = min(MAX_BITS, 1 << max(19, ((bits_each or BITS_EACH) * max(1, count) - 1).bit_length()))

    def pack(table: pa.Table) -> pa.Table:
        at = table["at"].to_numpy()
        mine, inner = np.zeros(1 << 16, np.uint8), at & ((1 << 19) - 1)
        np.bitwise_or.at(mine, inner >> 3, np.left_shift(1, inner & 7).astype(np.uint8))
        return pa.table({"block": pa.array([int(at[0]) >> 19], pa.int32()), "bytes": pa.array([mine.tobytes()], pa.binary())})

    place = F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at")
    packed = hashes.select(place).distinct().groupBy(F.shiftright("at", 19).alias("b")).applyInArrow(pack, "block int, bytes binary")
    return hashes.sparkSession.sparkContext.broadcast(Filter(bits, {r.block: bytes(r.bytes) for r in packed.toLocalIterator()}))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(n, new) if len(new) else n


def frequent_hashes(df: DataFrame, of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], least: int, expected: int) -> DataFrame:
    """(h) written: the hashes whose counts in all of ``df`` reach ``least``. ``of`` gives hashes and counts
    of a batch (unsigned 64 bits, repeats allowed); ``expected``: about how many there are, for the number
    of buckets. A task sums its hashes and ships them sorted, cut by value into buckets, as bytes."""
    buckets = max(1, -(-expected // BUCKET))
    edges = (np.arange(buckets, dtype=np.float64) * (2.0 ** 64 / buckets)).astype(np.uint64)

    def emit(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cut = np.append(np.searchsorted(key, edges), len(key))
        some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([key[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()),
                                           pa.array([zlib.compress(n[cut[b]:cut[b + 1]].astype(np.int64).tobytes(), 1) for b in some], pa.binary())],
                                          ["bucket", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, counts = 0, [], []
        for batch in batches:
            for h, n in of(batch):
                key, n = summed([h], [n])
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > HELD:
                    yield emit(*summed(keys, counts))
                    held, keys, counts = 0, [], []
        if held:
            yield emit(*summed(keys, counts))

    def merge(table: pa.Table) -> pa.Table:
        key, n = summed([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()],
                        [np.frombuffer(zlib.decompress(x), np.int64) for x in table["counts"].to_pylist()])
        found = pa.table({"h": pa.array(key[n >= least].view(np.int64))})
        del key, n
        give_back()  # buckets are large
        return found

    blocks = df.mapInArrow(trimmed(count), "bucket int, keys binary, counts binary")
    return cut_lineage(blocks.groupBy("bucket").applyInArrow(merge, "h long"), "frequent-hashes")


def _phrase_sums(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"])
    return out.rename_columns(["lang", "phrase", "n"]).combine_chunks()


def frequent_phrases(df: DataFrame, of: Callable[[pa.RecordBatch], Iterator[pa.Table]], least: int, expected: int, name: str) -> DataFrame:
    """(lang, phrase, n, words) written: the phrases whose counts in all of ``df`` reach ``least``, and, with a
    null phrase, sums of all counts of a language as ``words``. ``of`` gives (lang, phrase, n) of a batch, repeats
    allowed; ``expected``: about how many there are. A task sums its phrases and ships them cut by hash into
    buckets, as Arrow streams, so the rows themselves stay out of the JVM."""
    buckets = max(1, -(-expected // BUCKET))

    def emit(tables: list[pa.Table]) -> pa.RecordBatch:
        t = _phrase_sums(tables)
        coded = t["lang"].combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        salt = text_keys(coded.dictionary)[codes] if len(t) else np.zeros(0, np.uint64)
        bucket = (mixed(text_keys(t["phrase"].combine_chunks()) + salt) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.append(np.searchsorted(bucket[order], np.arange(buckets)), len(order))
        t, some, blobs = t.take(pa.array(order)).combine_chunks(), [], []
        for b in np.flatnonzero(cut[1:] > cut[:-1]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as to:
                to.write_table(t.slice(cut[b], cut[b + 1] - cut[b]))
            some.append(int(b))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tables = 0, []
        for batch in batches:
            for t in of(batch):
                tables.append(t)
                held += t.num_rows
                if held > HELD_PHRASES:
                    tables = [_phrase_sums(tables)]
                    held = tables[0].num_rows
                    if held > HELD_PHRASES // 2:
                        yield emit(tables)
                        held, tables = 0, []
        if held:
            yield emit(tables)

    def merge(t: pa.Table) -> pa.Table:
        found = _phrase_sums([pa.ipc.open_stream(x.as_buffer()).read_all() for x in t["rows"]])
        sums = found.group_by("lang").aggregate([("n", "sum")])
        found = found.filter(pa.compute.greater_equal(found["n"], least))
        none, k = pa.nulls(found.num_rows, pa.int64()), sums.num_rows
        out = pa.table({"lang": pa.chunked_array([*found["lang"].chunks, *sums["lang"].chunks], pa.string()),
                        "phrase": pa.chunked_array([*found["phrase"].chunks, pa.nulls(k, pa.string())], pa.string()),
                        "n": pa.chunked_array([*found["n"].chunks, pa.nulls(k, pa.int64())], pa.int64()),
                        "words": pa.chunked_array([none, *sums["n_sum"].chunks], pa.int64())})
        del found, sums
        give_back()  # buckets are large
        return out

    blocks = df.mapInArrow(trimmed(count), "bucket int, rows binary")
    return cut_lineage(blocks.groupBy("bucket").applyInArrow(merge, "lang string, phrase string, n long, words long"), name)
