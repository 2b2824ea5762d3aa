"""Near-duplicate embeddings by spherical-cap filters from a random product code.

A filter is a direction; a vector passes it if their inner product exceeds ``alpha``. Directions are
a product code: after a random rotation the coordinates are cut into blocks, each block has a small
random Gaussian codebook, and every choice of one codeword per block is a direction. List decoding
walks the blocks and keeps the partial choices that can still reach ``alpha``, so a vector finds all
filters it passes without looking at the others. Vectors meet in shared filters and every meeting
is verified by the cosine in double precision.

``alpha`` follows from the number of vectors (a filter holds about ``bucket`` of them), the number of
filters from ``meet``, the number of filters that a pair at the threshold shares on average. The
directions of one code resemble each other, so they are spread over ``codes`` independent ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import connected_components, cut_lineage, without

BLOCK_ROWS = 1500   # rows of a filter that one task compares with as many others
MAX_CODEWORDS = 1024  # of a block's codebook
ADDED = ("n_links", "component_id", "kept")


@dataclass(frozen=True)
class Filters:
    dim: int
    alpha: float
    blocks: int
    codewords: int
    codes: int
    seed: int

    @staticmethod
    def plan(n: int, dim: int, threshold: float, bucket: int = 48, meet: float = 15.0, codes: int = 12, seed: int = 23) -> Filters:
        """Parameters for ``n`` vectors of ``dim`` coordinates."""
        pass_ = min(0.02, bucket / max(n, 1))
        alpha = NormalDist().inv_cdf(1 - pass_)
        # P(both pass) at cosine ``threshold``: average over where the first one lies beyond alpha
        normal, spread = NormalDist(), math.sqrt(1 - threshold**2)
        xs = np.linspace(alpha, alpha + 6, 2001)
        density = np.exp(-xs**2 / 2) / math.sqrt(2 * math.pi)
        both = float((density * [1 - normal.cdf((alpha - threshold * x) / spread) for x in xs]).sum() * (xs[1] - xs[0]))
        count = math.ceil(meet / codes / both)
        blocks = 1
        while blocks < min(dim, 12) and count ** (1 / blocks) > MAX_CODEWORDS:
            blocks += 1
        blocks = max(blocks, min(dim, 2))
        return Filters(dim, alpha, blocks, math.ceil(count ** (1 / blocks)), codes, seed)

    def books(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """The rotation and the codebooks of each code; a direction has Gaussian coordinates of variance 1."""
        rng = np.random.default_rng(self.seed + 1000 * self.dim)
        widths = [len(x) for x in np.array_split(np.arange(self.dim), self.blocks)]
        return [(np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0], [rng.standard_normal((w, self.codewords)) for w in widths])
                for _ in range(self.codes)]

    def decode(self, unit: np.ndarray, books: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each row of ``unit`` passes."""
        found = [self._decode(unit, rotation, parts, i) for i, (rotation, parts) in enumerate(books)]
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])

    def _decode(self, unit: np.ndarray, rotation: np.ndarray, parts: list[np.ndarray], which: int) -> tuple[np.ndarray, np.ndarray]:
        turned, scores, at = unit @ rotation, [], 0
        for book in parts:
            scores.append(turned[:, at:at + len(book)] @ book)
            at += len(book)
        best = [s.max(1) for s in scores]
        row, code, total = np.arange(len(unit)), np.full(len(unit), which, np.int64), np.zeros(len(unit))
        for i, s in enumerate(scores):
            ahead = sum(best[i + 1:]) if i + 1 < len(scores) else np.zeros(len(unit))
            grown = total[:, None] + s[row]
            keep, word = np.nonzero(grown + ahead[row][:, None] >= self.alpha)
            row, code, total = row[keep], code[keep] * self.codewords + word, grown[keep, word]
        return row, code


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _earlier(lists: list[np.ndarray], bucket: int) -> np.ndarray:
    """A row of bits per vector: which of the filters before ``bucket`` it passes, as far as another
    vector of the group passes them too."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
    owner, flat = owner[flat < bucket], flat[flat < bucket]
    kinds, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    bits = np.zeros((len(lists), (int((count > 1).sum()) + 63) // 64 or 1), np.uint64)
    owner, at = owner[count[which] > 1], place[which[count[which] > 1]]
    np.bitwise_or.at(bits, (owner, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return bits


def compare(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, by parts, of the rows of ``x`` and ``y`` (one block if ``same``) with a cosine
    of at least ``threshold``."""
    for i in range(0, len(x), step):
        for j in range(i if same else 0, len(y), step):
            a, b = np.nonzero(x[i:i + step] @ y[j:j + step].T >= threshold)
            a, b = a + i, b + j
            yield (a[a < b], b[a < b]) if same else (a, b)


def _merge(top: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the trees of each pair: the larger root takes the smaller one, then all paths close."""
    while len(p):
        a, b = top[p], top[q]
        low = np.minimum(a, b)
        np.minimum.at(top, a, low)
        np.minimum.at(top, b, low)
        while (top != top[top]).any():
            top[:] = top[top]
        apart = top[p] != top[q]
        p, q = p[apart], q[apart]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                    bucket: int = 48, meet: float = 15.0, codes: int = 12, seed: int = 23) -> DataFrame:
    """``vectors`` plus ``n_links`` (other rows at a cosine of ``threshold`` or more, as far as the
    filters find them; equal rows always), ``component_id`` (smallest id reachable by links) and
    ``kept`` (the id is its component's). These replace columns of the same names.

    Rows without a usable vector link with nothing. Equal vectors are compared once and count with
    their number. Vectors of different lengths never link. Rows that repeat an id count each.
    """
    rows = without(vectors, [*ADDED, "_h", "_g", "_ok", "_row"])
    v = F.col(f"`{vec_col}`")
    # the class of equal vectors: two 64-bit hashes of the components (0.0 added: no negative zero)
    parts = F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0))
    keyed = rows.withColumns({"_ok": usable(v), "_h": F.xxhash64(parts), "_g": F.xxhash64(parts, F.lit(1))})
    small = cut_lineage(keyed.filter("_ok").groupBy("_h", "_g").agg(
        F.min(F.col(f"`{id_col}`")).alias("id"), F.count("*").alias("n"), F.any_value(v.cast("array<double>")).alias("v")), "classes")
    classes = cut_lineage(small.withColumn("c", F.monotonically_increasing_id()), "numbered")
    planned = {r.d: Filters.plan(r["count"], r.d, threshold, bucket, meet, codes, seed)
               for r in classes.groupBy(F.size("v").alias("d")).count().collect()}  # a row per vector length

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = {d: f.books() for d, f in planned.items()}
        for b in batches:
            ids, counts, vs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            sizes = np.asarray(vs.value_lengths())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = _unit(vs.take(pa.array(at)).flatten().to_numpy().reshape(-1, d))
                for k in range(0, len(at), 256):
                    some, xs = at[k:k + 256], x[k:k + 256]
                    row, code = planned[int(d)].decode(xs, books[int(d)])
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    cuts = np.searchsorted(row, np.arange(len(some) + 1))
                    full = np.flatnonzero(np.diff(cuts))  # a vector beyond every cap is met by none
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[some][full]), pa.array(counts[some][full]), pa.array([int(d)] * len(full), pa.int32()),
                        pa.array([u.tobytes() for u in xs[full]], pa.binary()),
                        pa.array([code[cuts[i]:cuts[i + 1]] for i in full], pa.list_(pa.int64()))], names=["c", "n", "d", "u", "filters"])

    coded = cut_lineage(classes.select("c", "n", "v").mapInArrow(decode, "c long, n long, d int, u binary, filters array<long>"), "coded")
    flat = coded.select(F.explode("filters").alias("f"), "c", "n", "d", "u", "filters")
    # a filter with more rows than a block is compared block by block: each row goes to all pairs of its own
    crowded = cut_lineage(coded.select(F.explode("filters").alias("f"), "d").groupBy("d", "f").count().filter(f"count > {BLOCK_ROWS}")
                          .select("d", "f", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks")), "crowded")
    dealt = (flat.join(crowded, ["d", "f"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
             .withColumn("own", F.pmod(F.xxhash64("c", F.lit(9)), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks"))

    def meet_up(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        d, f, low, high = (k.as_py() for k in key)
        own, c, n = t["own"].to_numpy(), t["c"].to_numpy(), t["n"].to_numpy()
        x = np.frombuffer(b"".join(t["u"].to_pylist()), np.float64).reshape(-1, d)
        bits = _earlier([v.values.to_numpy() for v in t["filters"]], f)
        links, top = np.zeros(len(c), np.int64), np.arange(len(c))
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        for a, b in compare(x[left], x[right], threshold, low == high):
            a, b = left[a], right[b]
            _merge(top, a, b)
            for k in range(0, len(a), 50_000):  # a pair counts in the first filter that it shares
                p, q = a[k:k + 50_000], b[k:k + 50_000]
                first = ~(bits[p] & bits[q]).any(1)
                links += np.bincount(p[first], n[q[first]], len(c)).astype(np.int64) + np.bincount(q[first], n[p[first]], len(c)).astype(np.int64)
        said = (links > 0) | (top != np.arange(len(c)))
        return pa.table({"c": pa.array(c[said], pa.int64()), "links": pa.array(links[said]), "root": pa.array(c[top[said]], pa.int64())})

    met = cut_lineage(dealt.groupBy("d", "f", "low", "high").applyInArrow(meet_up, "c long, links long, root long"), "met")
    roots = connected_components(met.filter("c <> root").distinct(), "c", "root").toDF("c", "top")
    links = met.groupBy("c").agg(F.sum("links").alias("links"))
    full = (classes.join(links, "c", "left").join(roots, "c", "left")
            .select("_h", "_g", "id", F.coalesce("links", F.lit(0)).alias("links"), "n", F.coalesce("top", "c").alias("top")))
    full = cut_lineage(full, "full")
    lowest = cut_lineage(full.groupBy("top").agg(F.min("id").alias("component_id")), "lowest")
    table = cut_lineage(full.join(lowest, "top").select("_h", "_g", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "table")
    fine = keyed.filter("_ok").join(table, ["_h", "_g"])
    none = keyed.filter("not _ok").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col(f"`{id_col}`")})
    out = [*[F.col(f"`{x}`") for x in rows.columns], F.col("n_links"), F.col("component_id"),
           F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")).alias("kept")]
    return fine.select(*out).unionByName(none.select(*out))
