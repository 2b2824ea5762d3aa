"""Jaccard join of documents on word shingles by PartEnum signatures.

Sets of similar size share a band: a set of size s belongs to the band of its size and to the next,
so any two sets with Jaccard >= t meet in one. In a band with sets up to ``u`` elements such a pair
differs in at most ``k = 2u(1 - t)/(1 + t)`` elements. The element domain is hashed into ``n1``
first-level parts, of which one holds at most ``k2 = floor(k / n1)`` of the differences; that part is
hashed again into ``n2`` second-level parts, and every choice of ``n2 - k2`` of them is a signature.
Equal signatures make candidates; candidates are verified on their whole sets.

There are ``spare`` first-level parts more than needed, so similar sets agree in more than ``spare``
of them. All signatures stand in one order: rare ones, then frequent ones (passages that many
documents share, empty parts last) by how frequent they are. A set leaves out its last ``spare``
frequent ones: two sets that leave out the first signature they share would have to leave out all
others they share as well, which are too many. And a set that shares no more than ``spare``
signatures of a band, less those left out, with any other set has no similar one there.

``k2 = 0`` gives the fewest signatures (one per first-level part), ``k2 = 1`` or more the choices.

Copies are one class (equal sets). In signatures of many classes each class is first compared with
the one of most company. Classes that share a signature and are not one component by then are screened
by bit sketches: a bit holds the parity of the elements hashed to it, so two sketches differ in no more
bits than their sets do in elements. What may still be similar forms families, whose sets are compared
in blocks by matrix products that give the components and not the pairs. So no link between different
texts is lost, groups of near copies never give all their pairs, and sets that only share some passages
never meet in one family.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.llm.common import checked_broadcast, connected_components, cut_lineage, free, give_back, trimmed, words
from reelsift.llm.filters import broadcast_filter, frequent_hashes

WORD_CACHE = 100_000
MAX_BROADCAST_ROWS = 1_000_000  # of (class, family, id) rows, under 64 bytes each; beyond, the texts are shuffled
SLICE = 250  # documents whose signatures are held at a time
BLOCK_ROWS, BLOCK_ELEMENTS = 1000, 500_000  # of a group that one task compares
SIG_BYTES = 6  # of a signature: two that agree by chance cost a comparison
KEEP = np.uint64((1 << 8 * SIG_BYTES) - 1)
SKETCH_SALT = np.uint64(0xA0761D6478BD642F)
EMPTY = np.uint64(1)  # the bit that marks the signatures of empty parts; these count as frequent
BUCKET_SIGS = 250_000  # signatures of a range, about
SENT_SIGS = 500_000  # signatures that a task counts at a time
FREQUENT = (64, 512, 4096, 32768)  # sets with a signature: beyond the first it is frequent, beyond each more so
SKETCH_BITS = 4096  # of a sketch, at the most
SCREEN_ROWS = 20_000  # (signature, class) rows that are screened at a time, about
SCREEN_GROUP = 8_192  # classes of a signature, beyond which they are dealt to blocks
SCREEN_WORDS = 1 << 20  # of sketches that are held at a time
BLOCK_BITS = 1 << 15  # of one bitmap_construct_agg bitmap
DENSE, COLUMNS = 16, 1024  # elements of more sets than this go to the matrix product, so many at a time
LARGE = 1 << 20  # bytes of a group, from which on a worker gives memory back after it

_hashes: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles of a whole text; of the whole sequence
    where it has fewer words, and none without words."""
    ws = words(raw)
    if not ws:
        return np.zeros(0, np.uint64)
    if len(_hashes) > WORD_CACHE:
        _hashes.clear()
    get, ids = _hashes.get, []
    for w in ws:
        h = get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    a = np.array(ids, np.uint64)
    k = min(n, len(a))
    with np.errstate(over="ignore"):
        h = np.full(len(a) - k + 1, k, np.uint64)  # the length is part of a short sequence's hash
        for j in range(k):
            h = _mix(h + a[j:len(a) - k + 1 + j])
    return np.unique(h)


class Bands:
    """Size bands and the PartEnum parameters of each, for a threshold ``num / den``."""

    def __init__(self, num: int, den: int, k2: int = 0):
        self.num, self.den, self.k2 = num, den, k2
        self.uppers = [1]  # largest size of each band

    def band(self, size: int) -> int:
        while self.uppers[-1] < size:
            low = self.uppers[-1] + 1
            self.uppers.append(low * self.den // self.num)
        return int(np.searchsorted(self.uppers, size))

    @lru_cache(maxsize=None)  # noqa: B019  a few dozen bands
    def parts(self, band: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, spare) of a band that takes the sets of its own and of the size band before."""
        self.band(self.uppers[min(band, len(self.uppers) - 1)] + 1)
        while len(self.uppers) <= band:
            self.band(self.uppers[-1] + 1)
        u = self.uppers[band]
        k = 2 * u * (self.den - self.num) // (self.den + self.num)
        k2 = min(self.k2, k)
        least = -(-(k + 1) // (k2 + 1))
        spare = 0 if k2 else 1 + -(-least * 3 * (self.den - self.num) // (5 * self.den))
        return least + spare, (1 if k2 == 0 else k2 + 2), k2, spare

    def length(self, band: int) -> int:
        """Signatures of a set in one band."""
        n1, n2, k2, _ = self.parts(band)
        return n1 * comb(n2, k2)

    def sketch(self, elements: np.ndarray, band: int) -> bytes:
        """Parities of the elements in the cells of a band, three for four elements of its largest sets."""
        self.parts(band)
        bits = min(64 * -(-3 * self.uppers[band] // 256), SKETCH_BITS)
        cell = (_mix(elements ^ SKETCH_SALT) % np.uint64(bits)).astype(np.int64)
        return np.packbits(np.bincount(cell, minlength=bits) & 1).tobytes()

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """Hashes of (band, part, choice, its elements): equal for any two sets that agree there."""
        if len(elements) == 0:
            return np.zeros(0, np.uint64)
        own = self.band(len(elements))
        out = []
        for band in (own, own + 1):
            n1, n2, k2, _ = self.parts(band)
            salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64)
            with np.errstate(over="ignore"):
                h = _mix(elements ^ salt)
                cell = (h % np.uint64(n1)).astype(np.int64)
                sub = ((h >> np.uint64(40)) % np.uint64(n2)).astype(np.int64)
                value = _mix(elements + salt)
                cells = np.zeros(n1 * n2, np.uint64)
                np.add.at(cells, cell * n2 + sub, value)  # a sum does not depend on the order
                cells = _mix(cells + np.arange(n1 * n2, dtype=np.uint64)).reshape(n1, n2)
                full = np.bincount(cell * n2 + sub, minlength=n1 * n2).reshape(n1, n2)
                for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
                    h = _mix(cells[:, list(chosen)].sum(1, dtype=np.uint64) ^ (salt + np.uint64(c)))
                    out.append(h & ~EMPTY | np.where(full[:, list(chosen)].any(1), np.uint64(0), EMPTY))
        return np.concatenate(out) & KEEP


def _class(elements: np.ndarray) -> int:
    """64 bits that stand for the whole set; never 0 for a set with elements."""
    return xxhash.xxh64_intdigest(elements.tobytes()) or 1


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _meets(a: bytes, b: bytes, num: int, den: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(both) - common)


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, family, text) of the rows with the ids of the ``wanted`` (k, family, doc) classes."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.join(checked_broadcast(wanted, MAX_BROADCAST_ROWS), rows["doc"].eqNullSafe(wanted["doc"])).select("k", "family", "text")


def _is_class(elements: np.ndarray, k: int) -> bool:
    """Whether a text's set is the wanted one: an id may stand for several texts."""
    return len(elements) > 0 and int(_signed(np.array([_class(elements)], np.uint64))[0]) == k


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, k2: int = 0) -> DataFrame:
    """(k, family, band, n, elements) of the ``wanted`` (k, family, doc) classes: their
    texts are read and cut again. Rows that repeat an id and text repeat here."""
    texts = _texts(docs, wanted, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den, k2)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                out = []
                for k, family, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    e = shingle_set(text, n)
                    if _is_class(e, k):
                        out.append((k, family, bands.band(len(e)), len(e), e.tobytes()))
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())],
                                                 names=["k", "family", "band", "n", "elements"])
        _hashes.clear()

    return texts.mapInArrow(trimmed(cut), "k long, family long, band long, n long, elements binary")


def _packed(flat: np.ndarray) -> np.ndarray:
    """Signatures as bytes, ``SIG_BYTES`` each."""
    return np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]).ravel()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a binary column, and how many each row has."""
    sizes = np.fromiter((0 if x is None else len(x) // SIG_BYTES for x in column.to_pylist()), np.int64, len(column))
    return _signatures(b"".join(x for x in column.to_pylist() if x)), sizes


def _signatures(raw: bytes) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, SIG_BYTES)
    flat = np.zeros((len(rows), 8), np.uint8)
    flat[:, :SIG_BYTES] = rows
    return flat.view(np.int64).ravel()


def _counted(signed: DataFrame, buckets: int) -> DataFrame:
    """(sig, count) of the signatures that occur more than once; counts stop at 65535 a time.

    Signatures are shuffled as bytes, not as rows: a task sorts and counts ``SENT_SIGS`` of its own at
    a time and sends one row per range of signatures, so one of very many sets comes once for each."""
    shift = 8 * SIG_BYTES - (buckets - 1).bit_length()

    def ranges(raw: list[bytes]) -> pa.RecordBatch:
        sig, count = np.unique(_signatures(b"".join(raw)), return_counts=True)
        first = np.flatnonzero(np.r_[True, np.diff(sig >> shift) > 0])
        ends = np.r_[first[1:], len(sig)]
        packed, counts = _packed(sig.view(np.uint64)), np.minimum(count, 65535).astype("<u2")
        return pa.RecordBatch.from_arrays([
            pa.array(sig[first] >> shift), pa.array([packed[i * SIG_BYTES:j * SIG_BYTES].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()),
            pa.array([counts[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())], names=["bucket", "sigs", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in batches:
            for x in b.column(0):
                raw = x.as_py()
                if raw:
                    held.append(raw)
                    size += len(raw)
                if size > SENT_SIGS * SIG_BYTES:
                    yield ranges(held)
                    held, size = [], 0
        if held:
            yield ranges(held)

    def sums(t: pa.Table) -> pa.Table:
        sig = np.concatenate([_unpacked(c)[0] for c in t["sigs"].chunks])
        count = np.frombuffer(b"".join(t["counts"].to_pylist()), "<u2")
        order = np.argsort(sig, kind="stable")
        sig, count = sig[order], count[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        total = np.add.reduceat(count, first, dtype=np.int64)
        return pa.table({"sig": pa.array(sig[first][total > 1]), "count": pa.array(total[total > 1])})

    def add(t: pa.Table) -> pa.Table:
        found = sums(t)
        if t.nbytes > LARGE:
            give_back()
        return found

    sent = signed.select("sigs").mapInArrow(trimmed(send), "bucket long, sigs binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "sig long, count long")


def _bits(sigs: DataFrame, max_bits: int = 1 << 28) -> np.ndarray:
    """A filter of 16 bits a signature, up to ``max_bits`` (32 MB): what every task gets to know.
    Beyond that more signatures pass than are meant, which costs time and loses nothing."""
    bits = max(BLOCK_BITS, min(max_bits, 1 << (16 * sigs.count()).bit_length()))
    place = F.pmod("sig", F.lit(bits))
    blocks = (sigs.groupBy(F.shiftright(place, 15).alias("block"))
              .agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(BLOCK_BITS - 1))).alias("bitmap")).collect())  # max_bits / 8 bytes
    held = np.zeros(bits // 8, np.uint8)
    for r in blocks:
        held[r.block * BLOCK_BITS // 8:][:BLOCK_BITS // 8] = np.frombuffer(r.bitmap, np.uint8)
    return held


def _hit(held: np.ndarray, sig: np.ndarray) -> np.ndarray:
    at = sig & (8 * len(held) - 1)
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _kept(signed: DataFrame, twice: np.ndarray, frequent: list[np.ndarray], num: int, den: int, k2: int = 0) -> DataFrame:
    """(sig, k, up) of the signatures that pass the filter ``twice``, without the last ``spare`` frequent
    ones of each set and band. ``up``: of the band after the set's own."""
    shared = signed.sparkSession.sparkContext.broadcast((twice, frequent))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, frequent = shared.value
        bands = Bands(num, den, k2)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                sig, sizes = _unpacked(b.column(2))
                own = np.array([bands.length(x) if n else 0 for x, n in zip(b.column(1).to_pylist(), sizes.tolist(), strict=True)], np.int64)
                spare = np.array([bands.parts(x + i)[3] for x in b.column(1).to_pylist() for i in (0, 1)], np.int64)
                half = np.stack([own, sizes - own], 1).ravel()  # a set's parts in its own band, then in the next
                part = np.repeat(np.arange(len(half)), half)
                rank = np.zeros(len(sig), np.int8)
                for held in frequent:
                    rank += _hit(held, sig)
                rank[sig & 1 == 1] = len(frequent) + 1
                left_out = np.minimum(np.bincount(part, rank > 0, len(half)).astype(np.int64), spare)
                order = np.lexsort((sig, rank, part))
                keep = np.empty(len(sig), bool)
                keep[order] = np.arange(len(sig)) < (np.cumsum(half) - left_out)[part]  # parts stand together
                keep &= _hit(twice, sig)
                # a similar set agrees in more than ``spare`` parts, but for those left out
                keep &= (np.bincount(part, keep, len(half)) > spare - left_out)[part]
                k = np.repeat(b.column(0).fill_null(0).to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(k[keep]), pa.array((part & 1 == 1)[keep])], names=["sig", "k", "up"])

    return signed.mapInArrow(trimmed(test), "sig long, k long, up boolean")


def screened(group: np.ndarray, k: np.ndarray, c: np.ndarray, n: np.ndarray, bits: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) edges that join all sets of one ``group``, but for those of one component ``c``, whose
    sketches (rows of 64-bit words) do not rule out that they are similar."""
    order = np.argsort(group, kind="stable")
    group, c, n, bits = group[order], c[order], n[order], bits[order]
    ks, at = np.unique(k[order], return_inverse=True)
    root = np.arange(len(ks))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    most = max(1, SCREEN_WORDS // bits.shape[1])
    left = np.arange(len(group))
    for step in range(1, len(group)):
        left = left[left < len(group) - step]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        i, j = left, left + step
        open_ = (root[at[i]] != root[at[j]]) & (c[i] != c[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
        i, j = i[open_], j[open_]
        for first in range(0, len(i), most):
            x, y = i[first:first + most], j[first:first + most]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            hit = (den + num) * apart <= (den - num) * (n[x] + n[y])
            for a, b in zip(at[x[hit]].tolist(), at[y[hit]].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        if len(i):
            while (root[root] != root).any():
                root = root[root]
    tied = root != np.arange(len(ks))
    return ks[root[tied]], ks[tied]


def _screen(named: DataFrame, split: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) edges, written, that join what may be similar of the (sig, k, up, c) ``named`` classes with
    one of the (sig, rows) signatures ``split``, but for classes of one component ``c``. Every task takes
    many signatures; one of more than ``SCREEN_GROUP`` classes is dealt to pairs of blocks."""
    met = named.join(split, "sig")
    known = sketches.join(met.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    buckets = 1 + (split.agg(F.sum("rows")).first()[0] or 0) // SCREEN_ROWS
    blocks = F.ceil(F.col("rows") / SCREEN_GROUP)
    block = F.pmod(F.xxhash64("k"), blocks)
    dealt = (met.withColumn("pair", F.explode(F.when(blocks < 2, F.array(F.lit("0"))).otherwise(F.transform(
                F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.concat_ws("-", F.least(o, block), F.greatest(o, block))))))
             .select("k", "c", "up", F.xxhash64("sig", "pair").alias("g"))
             .join(known, "k").select("g", "k", "c", "n", F.when(F.col("up"), F.col("above")).otherwise(F.col("home")).alias("bits"),
                                      F.pmod("g", F.lit(buckets)).alias("bucket")))

    def screen(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        g, k, c, n = (t[x].to_numpy() for x in ("g", "k", "c", "n"))
        raw = t["bits"].to_pylist()
        sizes = np.fromiter((len(x) for x in raw), np.int64, len(raw))
        a, b = [], []
        for size in np.unique(sizes).tolist():
            here = np.flatnonzero(sizes == size)
            words = np.frombuffer(b"".join(raw[i] for i in here.tolist()), np.uint64).reshape(len(here), -1)
            x, y = screened(g[here], k[here], c[here], n[here], words, num, den)
            a.append(x)
            b.append(y)
        found = pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})
        if t.nbytes > LARGE:
            give_back()
        return found

    return cut_lineage(dealt.groupBy("bucket").applyInArrow(screen, "a long, b long").distinct(), "apart")


def _verify(centres: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The (a, b) pairs of a centre and a class of its ``family`` that meet the threshold, as a written
    table. The (k, family, text) ``texts`` meet their centre first and are cut and compared at once: a
    task that cut them in one Python worker and compared them in another would leave both behind."""
    left = centres.select(F.col("k").alias("a"), F.col("elements").alias("ea"))
    right = texts.select(F.col("family").alias("a"), F.col("k").alias("b"), "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for k, centre, text in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                e = shingle_set(text.cast(pa.binary()).as_py(), n)
                hit.append(_is_class(e, k) and _meets(centre.as_py(), e.tobytes(), num, den))
            yield b.select([0, 1]).filter(pa.array(hit, pa.bool_()))
        _hashes.clear()

    full = right.join(left, "a").select("a", "b", "ea", "text")
    return cut_lineage(full.mapInArrow(trimmed(keep), "a long, b long"), "links")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the ``left`` sets with the ``right`` ones. Elements of many
    sets are counted by a matrix product, those of a few sets pair by pair."""
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[order]
    del order
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[first, len(flat)])
    del flat
    run = np.repeat(np.arange(len(first), dtype=np.int32), count)
    few = np.repeat(count <= DENSE, count)
    out = np.zeros(len(left) * len(right), np.float32)
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))

    def add(a: np.ndarray, b: np.ndarray) -> None:
        i, j = row[a], column[b]
        here = (i >= 0) & (j >= 0)
        np.add.at(out, i[here] * len(right) + j[here], np.float32(1))

    a_run, a_owner = run[few], owner[few]
    add(a_owner, a_owner)
    for step in range(1, DENSE):
        same = np.flatnonzero(a_run[step:] == a_run[:-step])
        a, b = a_owner[same], a_owner[same + step]
        add(a, b)
        add(b, a)
    del a_run, a_owner
    run, owner = run[~few], owner[~few]
    out = out.reshape(len(left), len(right))
    many = np.flatnonzero(count > DENSE)
    starts = np.searchsorted(run, many)  # elements stand in the order of their runs
    for k in range(0, len(many), COLUMNS):
        here = slice(starts[k], starts[k + COLUMNS] if k + COLUMNS < len(many) else len(run))
        m = np.zeros((len(sets), min(COLUMNS, len(many) - k)), np.float32)
        m[owner[here], np.searchsorted(many[k:k + COLUMNS], run[here])] = 1
        out += m[left] @ m[right].T
    return out


def _shared_elements(sets: DataFrame, expected: int) -> DataFrame:
    """(k, family, band, n, kept, elements) written: the sets without elements that stand in no other.

    These add nothing to an intersection, and the size ``n`` is known. The filter may let some of them
    through, which changes nothing."""
    def of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, batch.num_rows, SLICE):
            flat = np.frombuffer(b"".join(batch.column(0).slice(at, SLICE).to_pylist()), np.uint64)
            yield flat, np.ones(len(flat), np.int64)

    sets = cut_lineage(sets.select("k", "family", "band", "n", "elements"), "family-sets")
    often = frequent_hashes(sets.select("elements"), of, 2, expected)
    known = broadcast_filter(often, often.count(), bits_each=8)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                flat = [np.frombuffer(x, np.uint64) for x in b.column(4).to_pylist()]
                flat = [x[known.value.has(x)] for x in flat]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([len(x) for x in flat], pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary())],
                                                 names=["k", "family", "band", "n", "kept", "elements"])

    reduced = cut_lineage(sets.mapInArrow(trimmed(reduce), "k long, family long, band long, n long, kept long, elements binary"), "shared-elements")
    free(sets, often, shuffles=True)
    return reduced


def _compare_families(sets: DataFrame, expected: int, num: int, den: int) -> DataFrame:
    """(a, b) edges that join what links within each family of ``sets`` (k, family, band, n, elements)
    with about ``expected`` elements.

    Sets of a family meet in the instances of their own size band and of the next; an instance with
    more than ``BLOCK_ROWS`` sets or ``BLOCK_ELEMENTS`` shared elements is dealt to blocks, and every
    pair of blocks is one group. A group gives edges to the smallest set each one reaches, never pairs."""
    reduced = _shared_elements(sets, expected)
    met = reduced.withColumn("meet", F.explode(F.array("band", F.col("band") + 1)))
    blocks = cut_lineage(met.groupBy("family", "meet").agg(
        F.count("*").alias("rows"), F.sum("kept").alias("total"), F.max(F.col("band") == F.col("meet")).alias("own"))
        .filter("own and rows > 1")  # where nobody is at home, all meet in their own band
        .select("family", "meet", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_ELEMENTS)).alias("blocks")), "blocks")
    dealt = (met.join(blocks, ["family", "meet"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
             .select("family", "meet", "low", "high", "block", "band", "k", "n", "elements"))

    def pairs(meet: int, low: int, high: int, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.argsort(t["k"].to_numpy(), kind="stable")
        ks, block, home, sizes = (x[order] for x in (t["k"].to_numpy(), t["block"].to_numpy(), t["band"].to_numpy() == meet, t["n"].to_numpy()))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        elements = t["elements"]
        both = overlaps([np.frombuffer(elements[i].as_buffer(), np.uint64) for i in order.tolist()], left, right)
        root = np.arange(len(ks))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, common in zip(left, both, strict=True):
            hit = den * common >= num * (sizes[i] + sizes[right] - common)
            hit &= home[i] | home[right]
            for j in np.flatnonzero(hit):
                a, b = find(int(i)), find(int(right[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
        top = np.array([find(i) for i in range(len(ks))])
        tied = top != np.arange(len(ks))
        return pa.table({"a": pa.array(ks[top[tied]], pa.int64()), "b": pa.array(ks[tied], pa.int64())})

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        found = pairs(*(x.as_py() for x in key[1:]), t)
        if t.nbytes > LARGE:
            give_back()
        return found

    edges = cut_lineage(dealt.groupBy("family", "meet", "low", "high").applyInArrow(compare, "a long, b long"), "edges")
    free(reduced, blocks, shuffles=True)
    return edges


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    num: int = 4, den: int = 5, k2: int = 0) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, class_id, component_id). Rows link when
    ``den * |intersection| >= num * |union|`` of their n-word shingle sets.

    ``class_id`` stands for the set (null without words or text: such rows link with nothing and are
    their own component); ``component_id`` is the smallest id reachable by links, null ids aside.
    Repeated rows share a class. Other columns of ``docs`` are not read. ``k2`` goes to :class:`Bands`:
    it changes the signatures, never the links.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc", id_type), T.StructField("n_shingles", T.LongType()),
                           T.StructField("k", T.LongType()), T.StructField("band", T.LongType()), T.StructField("sigs", T.BinaryType()),
                           T.StructField("home", T.BinaryType()), T.StructField("above", T.BinaryType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den, k2)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                sizes, ks, own, packed, home, above = [], [], [], [], [], []
                for text in b.column(1):
                    e = shingle_set(text.cast(pa.binary()).as_py(), n)
                    sizes.append(len(e))
                    ks.append(_class(e) if len(e) else 0)
                    own.append(bands.band(len(e)) if len(e) else 0)
                    packed.append(_packed(bands.signatures(e)).tobytes())
                    home.append(bands.sketch(e, own[-1]) if len(e) else None)
                    above.append(bands.sketch(e, own[-1] + 1) if len(e) else None)
                keys = np.array(ks, np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(_signed(keys), mask=keys == 0), pa.array(own, pa.int64()),
                                                  *(pa.array(x, pa.binary()) for x in (packed, home, above))],
                                                 names=["doc", "n_shingles", "k", "band", "sigs", "home", "above"])
        _hashes.clear()

    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    signed = cut_lineage(source.mapInArrow(trimmed(sign), schema), "signed")
    known = cut_lineage(signed.select("doc", "n_shingles", "k", "band"), "classes")
    sketches = cut_lineage(signed.select("k", F.col("n_shingles").alias("n"), "home", "above").filter("k is not null"), "sketches")
    rows = known.select("doc", "n_shingles", "k")

    # signatures of two sets or more; a filter lets few others pass, and they end at one class
    total = signed.agg(F.sum(F.octet_length("sigs"))).first()[0] or 0
    counted = cut_lineage(_counted(signed, 1 << max(4, (total // SIG_BYTES // BUCKET_SIGS).bit_length())), "twice")
    kept = _kept(signed.select("k", "band", "sigs"), _bits(counted), [_bits(counted.filter(f"count > {x}")) for x in FREQUENT], num, den, k2)
    near = cut_lineage(kept.distinct(), "near")
    free(signed, counted, shuffles=True)
    shared = near.groupBy("sig").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high").select("sig")
    members = cut_lineage(near.join(shared, "sig"), "members")
    free(near, shuffles=True)

    # large groups first: each class is compared with the class of most company (an original has more
    # than its edited copies, so it makes the better centre), so that most of a group is one component
    crowd = cut_lineage(members.groupBy("sig").count().filter(f"count > {FREQUENT[0]}"), "crowd")
    links, roots = None, None
    if crowd.limit(1).count():
        inside = cut_lineage(members.drop("up").join(crowd, "sig"), "inside")
        company = cut_lineage(inside.groupBy("k").agg(F.sum("count").alias("company"), F.collect_list("sig").alias("sigs")), "company")  # a set's own
        ranked = company.select(F.explode("sigs").alias("sig"), "k", "company")
        centres = cut_lineage(ranked.groupBy("sig").agg(F.max(F.struct("company", "k")).alias("centre")), "centres")
        stars = cut_lineage(ranked.join(centres, "sig").filter("k <> centre.k").groupBy("k").agg(F.max("centre").alias("centre"))
                            .select(F.col("centre.k").alias("a"), F.col("k").alias("b")), "stars")
        free(inside, centres)
        docs_of = cut_lineage(rows.join(company.select("k"), "k").groupBy("k").agg(F.min("doc").alias("doc")), "company-docs")
        hubs = cut_lineage(stars.select(F.col("a").alias("k")).distinct().join(docs_of, "k").select("k", F.col("k").alias("family"), "doc"), "hubs")
        others = cut_lineage(stars.select(F.col("b").alias("k"), F.col("a").alias("family")).join(docs_of, "k").select("k", "family", "doc"), "others")
        hub_sets = cut_lineage(_sets(docs, hubs, id_col, text_col, n, num, den, k2).dropDuplicates(["k"]), "hub-sets")
        links = _verify(hub_sets, _texts(docs, others, id_col, text_col), n, num, den)
        free(company, stars, docs_of, hubs, others, hub_sets, shuffles=True)
        roots = connected_components(links)

    # what shares signatures, is not one component yet and passes the screen is a family
    named = members.withColumn("c", F.col("k"))
    if roots is not None:
        named = cut_lineage(members.join(roots.toDF("k", "c"), "k", "left").select("sig", "k", "up", F.coalesce("c", "k").alias("c")), "named")
        free(members, roots)
    split = cut_lineage(named.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows"))
                        .filter("low < high").select("sig", "rows"), "split")
    apart = _screen(named, split, sketches, num, den)
    free(named, crowd, split, sketches, shuffles=True)
    families = connected_components(apart).toDF("k", "family")
    chosen = cut_lineage(known.join(families, "k").groupBy("k", "family").agg(
        F.min("doc").alias("doc"), F.min("band").alias("band"), F.min("n_shingles").alias("n")), "wanted")
    free(apart, families)
    expected = chosen.agg(F.sum("n")).first()[0] or 0
    more = _compare_families(_sets(docs, chosen.select("k", "family", "doc"), id_col, text_col, n, num, den, k2), expected, num, den)
    free(chosen)
    edges = links.unionByName(more) if links is not None else more
    roots = connected_components(edges)
    free(edges, shuffles=True)

    named = rows.join(roots.withColumnRenamed("v", "k"), "k", "left").select("doc", "n_shingles", "k", F.coalesce("c", "k").alias("root"))
    linked = cut_lineage(named, "roots")
    free(known, roots)
    lowest = cut_lineage(linked.filter("root is not null").groupBy("root").agg(F.min("doc").alias("low")), "lowest")
    whole = linked.filter("root is not null").join(lowest, "root").select("doc", "n_shingles", "k", F.col("low").alias("component_id"))
    bare = linked.filter("root is null").select("doc", "n_shingles", "k", F.col("doc").alias("component_id"))
    return whole.unionByName(bare).withColumnsRenamed({"doc": "doc_id", "k": "class_id"})
