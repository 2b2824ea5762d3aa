"""Words of many texts as Arrow and numpy arrays: splitting, codes, joined slices, sliding extremes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task takes apart at a time.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``limit`` bytes of ``column``; a longer text comes alone."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


class Words:
    """The words of an array of texts, cut at space and 9 to 13: ``codes`` of all in a row, ``first``
    (a text's first word, and the end) and ``values`` (the different words)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(texts)
        flat, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        ends = ends - ends[0]
        there = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
        coded = flat.filter(there).dictionary_encode()
        self.first = kept[ends]
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = coded.dictionary

    def hashes(self, of: Callable[[bytes], int] = zlib.crc32) -> np.ndarray:
        """A 64-bit hash of every word of ``values``."""
        raw = self.values.cast(pa.binary()).to_pylist()
        return mixed(np.fromiter(map(of, raw), np.uint64, len(raw)))

    def keys(self) -> np.ndarray:
        """Another 64-bit hash of every word of ``values``, without a call for each."""
        return text_keys(self.values)

    def joined(self, start: np.ndarray, length: np.ndarray) -> pa.Array:
        """The words start .. start + length - 1 as texts, joined by one space."""
        at = spread(start, length)
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.values.take(pa.array(self.codes[at]))), " ")


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] numbers), start[1], ... one after the other."""
    length = np.asarray(length, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(np.asarray(start, np.int64) - before, length) + np.arange(int(length.sum()))


def text_keys(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of ``texts`` (no null): its bytes as digits of a number, stirred."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    size = np.diff(ends)
    digits = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1)
    base = np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    base[0] = 1
    digits *= np.cumprod(base)[np.arange(len(digits)) - np.repeat(ends[:-1] - ends[0], size)]
    there, out = np.flatnonzero(size), np.zeros(len(texts), np.uint64)
    if len(there):
        out[there] = np.add.reduceat(digits, (ends[:-1] - ends[0])[there])
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit numbers stirred, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive numbers of ``h`` (none if there are fewer)."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + size]
    return mixed(out)


def sliding(a: np.ndarray, n: int, best: Callable) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``n`` consecutive numbers, by doubling."""
    if len(a) < n:
        return a[:0]
    size = 1
    while 2 * size <= n:
        a, size = best(a[:-size], a[size:]), 2 * size
    return best(a[:len(a) - (n - size)], a[n - size:]) if size < n else a
