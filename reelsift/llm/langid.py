"""Language identification by interpolated Kneser-Ney character models, one per language.

The models read letters word by word: ``^`` opens a word, ``$`` closes it, and the context never
leaves the word. N-grams of all languages share one sorted array of 64-bit hashes per order; beside
each hash stand, per language, its discounted probability and its weight as a context. A document's
cross-entropy is the sum over its words divided by the characters predicted, the language with the
lowest wins, and one whose cross-entropy lies above the language's calibrated limit is rejected.

Only the samples are bounded (``sample`` documents a language to fit, as many to calibrate, drawn by
a hash of the id); every document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.llm.common import crc_mod, without, trimmed
from reelsift.llm.tokens import slices

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
OPEN, CLOSE = 2, 3
CACHE_WORDS = 100_000  # words a worker remembers before it starts anew
CHUNK = 200_000        # words summed at a time
SHORT = 4.0            # short texts scatter: their limit is higher by this over the root of their symbols
LIMIT_DOCS = 20      # calibration documents from which on a language has a limit of its own
ADDED = ("lang_pred", "score", "cross_entropy", "n_predicted", "rejected")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def gram_hashes(runs: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of ``^run$`` of each run: the hashes of the 1..order-grams that end there
    (0 where the word is too short), its place in the word, and the run's index."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs)) + 2
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(runs) else 0
    text = chr(CLOSE).join(chr(OPEN) + r for r in runs) + chr(CLOSE) if runs else ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(total) - np.repeat(ends - sizes, sizes)
    out = np.zeros((order, total), np.uint64)
    h = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, order + 1):  # add the symbol k - 1 places back
            back = np.zeros(total, np.uint64)
            back[k - 1:] = codes[:total - k + 1]
            h = h + _mix(back + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
            out[k - 1] = np.where(place >= k - 1, np.maximum(_mix(h + np.uint64(k)), np.uint64(1)), 0)
    return out, place, np.repeat(np.arange(len(runs)), sizes)


class CharModels:
    """Kneser-Ney models of ``langs`` over shared sorted hash arrays.

    ``keys[k]``: sorted hashes of the (k+1)-grams; ``alpha[k]`` (rows x langs): discounted
    probability of the last symbol after its context; ``gamma[k]``: the share that the n-gram, as a
    context, leaves to the shorter one (1 where the language never saw it)."""

    def __init__(self, langs: list[str], counts: dict[str, Counter], order: int):
        self.langs, self.order = langs, order
        self.limits = np.full(len(langs), np.inf)
        self.tau = 8.0
        per_lang = [self._orders(counts[x]) for x in langs]
        symbols = {g for x in per_lang for g in x[0]}
        self.floor = 1.0 / (len(symbols) + 1)  # one share more for symbols never seen
        tables = [self._weights(x) for x in per_lang]
        self.keys, self.alpha, self.gamma = [], [], []
        for k in range(order):
            grams = sorted({g for a, _ in tables for g in a[k]} | {g for _, b in tables for g in b[k]})
            keys = self._keys(grams, k + 1)
            by_key = np.argsort(keys)
            self.keys.append(keys[by_key])
            self.alpha.append(np.array([[a[k].get(g, 0.0) for a, _ in tables] for g in grams], np.float32).reshape(-1, len(langs))[by_key])
            self.gamma.append(np.array([[b[k].get(g, 1.0) for _, b in tables] for g in grams], np.float32).reshape(-1, len(langs))[by_key])
        #: share that the unigrams leave to the uniform distribution, per language
        self.root = np.array([b[-1] for _, b in tables], np.float32)

    def _orders(self, words: Counter) -> list[Counter]:
        """Counts of the k-grams: tokens for the highest order and for those that open a word,
        distinct left neighbours (Kneser-Ney's continuation counts) for the others."""
        top = [Counter() for _ in range(self.order)]
        for run, n in words.items():
            w = chr(OPEN) + run + chr(CLOSE)
            for end in range(2, len(w) + 1):
                for k in range(1, min(self.order, end) + 1):
                    top[k - 1][w[end - k:end]] += n
        out: list[Counter] = [Counter() for _ in range(self.order)]
        out[-1] = top[-1]
        for k in range(self.order - 1):
            for g in top[k + 1]:
                out[k][g[1:]] += 1
            for g, n in top[k].items():
                if g[0] == chr(OPEN):
                    out[k][g] = n
        return out

    def _weights(self, orders: list[Counter]):
        """alpha by k-gram, and gamma by (k-1)-gram context stored with the contexts' own order."""
        alpha, gamma = [], [dict() for _ in range(self.order)]
        root = 1.0
        for k, counts in enumerate(orders):
            ones = sum(1 for n in counts.values() if n == 1)
            twos = sum(1 for n in counts.values() if n == 2)
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = Counter(), Counter()
            for g, n in counts.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            alpha.append({g: max(n - d, 0.0) / total[g[:-1]] for g, n in counts.items()})
            for c in total:
                left = d * kinds[c] / total[c]
                if k:
                    gamma[k - 1][c] = left
                else:
                    root = left
        gamma.append(root)
        return alpha, gamma

    def _keys(self, grams: list[str], k: int) -> np.ndarray:
        """Hashes as :func:`gram_hashes` gives them for the last symbol of each gram."""
        if not grams:
            return np.zeros(0, np.uint64)
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, k)
        h = np.zeros(len(grams), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(1, k + 1):
                h = h + _mix(codes[:, k - j] + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64))
            return np.maximum(_mix(h + np.uint64(k)), np.uint64(1))

    def bits(self, runs: list[str]) -> np.ndarray:
        """(runs x (langs + 1)): bits per language that each run costs, and its symbols predicted."""
        out = np.zeros((len(runs), len(self.langs) + 1))
        if not runs:
            return out
        hashes, place, owner = gram_hashes(runs, self.order)
        n = len(place)
        p = np.full((n, len(self.langs)), self.floor, np.float32)
        before = np.broadcast_to(self.root, (n, len(self.langs)))
        for k in range(self.order):
            keys = self.keys[k]
            if len(keys) == 0:
                break
            at = np.minimum(np.searchsorted(keys, hashes[k]), len(keys) - 1)
            seen = (keys[at] == hashes[k])[:, None]
            p = np.where((place >= k)[:, None], np.where(seen, self.alpha[k][at], 0) + before * p, p)
            g = np.where(seen, self.gamma[k][at], 1)
            before = np.ones_like(g)
            before[1:] = g[:-1]  # the context of a symbol ends one place before it
            before[place <= k] = 1
        cost = -np.log2(p)
        cost[place == 0] = 0  # the opening mark is given
        starts = np.flatnonzero(place == 0)
        out[:, :-1] = np.add.reduceat(cost, starts, axis=0)
        out[:, -1] = np.add.reduceat((place > 0).astype(float), starts)
        return out


class _Words(dict):
    """word -> row of the worker's cost matrix; new words wait in ``todo`` until :meth:`settle`."""

    def __init__(self, model: CharModels):
        super().__init__()
        self.model, self.todo = model, []
        self.costs = np.zeros((0, len(model.langs) + 1))

    def __missing__(self, word):
        self[word] = at = len(self)
        self.todo.append(word)
        return at

    def settle(self):
        runs, owner = [], []
        for i, word in enumerate(self.todo):
            for run in LETTERS.findall(word):
                runs.append(run)
                owner.append(i)
        new = np.zeros((len(self.todo), self.costs.shape[1]))
        step, start = 250_000, 0  # symbols looked up at a time
        while start < len(runs):
            size, end = 0, start
            while end < len(runs) and (size == 0 or size + len(runs[end]) <= step):
                size += len(runs[end]) + 2
                end += 1
            np.add.at(new, owner[start:end], self.model.bits(runs[start:end]))
            start = end
        self.costs = np.concatenate([self.costs, new])
        self.todo = []


def score_texts(texts: list[str | None], known: _Words) -> np.ndarray:
    """(texts x (langs + 1)): bits per language and symbols predicted, over the whole texts."""
    out = np.zeros((len(texts), known.costs.shape[1]))
    at, rows, sizes, held = 0, [], [], 0

    def flush():
        nonlocal rows, sizes, held, at
        known.settle()
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sizes_ = np.array(sizes, np.int64)
        full = sizes_ > 0
        starts = (np.cumsum(sizes_) - sizes_)[full]
        if len(starts):
            out[at:at + len(sizes)][full] = np.add.reduceat(known.costs[flat], starts, axis=0)
        at, rows, sizes, held = at + len(sizes), [], [], 0

    for text in texts:
        ws = text.lower().split() if text else []
        rows.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
        sizes.append(len(ws))
        held += len(ws)
        if held >= CHUNK:
            flush()
    flush()
    return out


def verdicts(bits: np.ndarray, model: CharModels):
    """Language index, score, cross-entropy, symbols and rejection; symbols 0: unknown language."""
    n = bits[:, -1]
    ce = bits[:, :-1] / np.maximum(n, 1)[:, None]
    best = ce.argmin(1)
    low = ce[np.arange(len(ce)), best]
    score = 1 / np.exp2(-(ce - low[:, None]) * np.minimum(n, model.tau)[:, None]).sum(1)
    return best, np.where(n > 0, score, 0.0), low, n.astype(np.int64), (n == 0) | (low > model.limits[best] + SHORT / np.sqrt(np.maximum(n, 1)))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, eligible: Column, *,
        order: int = 4, sample: int = 600, margin: float = 1.5) -> CharModels | None:
    """Learn from the ``eligible`` rows with a label: about ``sample`` documents a language fit the
    models (crc32 of the id, modulo 3, is 0), about as many others set the limits and the score's
    sharpness. None without labelled rows."""
    lab = docs.filter(eligible & F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
        (crc_mod(F.col(f"`{id_col}`"), 3) == 0).alias("fits"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(11)), F.lit(1 << 20)).alias("draw"))
    sizes = lab.groupBy("lang", "fits").count().collect()  # two rows a language
    if not sizes:
        return None
    spark = docs.sparkSession
    lone = {r.lang for r in sizes} - {r.lang for r in sizes if r.fits}
    below = [int(min(1.0, sample / r["count"]) * (1 << 20)) + 1 for r in sizes]
    rates = spark.createDataFrame(pa.table({"lang": pa.array([r.lang for r in sizes], pa.string()), "fits": pa.array([r.fits for r in sizes], pa.bool_()),
                                            "below": pa.array(below, pa.int32())}))  # a list would start workers of another kind, which stay
    drawn = lab.join(F.broadcast(rates), ["lang", "fits"]).filter("draw < below")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()),
                                              pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    fit_rows = drawn.filter(F.col("fits") | F.col("lang").isin(*lone)) if lone else drawn.filter("fits")
    words = (fit_rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")).collect())  # words of the sample
    counts: dict[str, Counter] = {r.lang: Counter() for r in sizes}
    for r in words:
        counts[r.lang][r.word] = r.n
    langs = sorted(x for x in counts if counts[x])
    if not langs:
        return None
    model = CharModels(langs, counts, order)

    rest = drawn.filter("not fits").select("lang", "text")
    shared = spark.sparkContext.broadcast(model)

    def cost(batches):
        known = _Words(shared.value)
        for b in batches:
            bits = score_texts(b.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_pydict({"lang": b.column(0), "bits": list(map(list, bits))},
                                             schema=pa.schema([("lang", pa.string()), ("bits", pa.list_(pa.float64()))]))

    held = [r for r in rest.mapInArrow(cost, "lang string, bits array<double>").collect() if r.bits[-1] > 0 and r.lang in langs]
    if held:
        bits = np.array([r.bits for r in held])
        own = np.array([langs.index(r.lang) for r in held])
        ce = bits[:, :-1] / bits[:, -1:]
        best = ce.argmin(1)
        right = own == best
        pooled = ce[right, best[right]].max(initial=-np.inf) if right.any() else np.inf
        for i in range(len(langs)):  # reject only what costs more than any labelled text did
            mine = ce[right & (own == i), i]
            model.limits[i] = mine.max(initial=-np.inf if mine.size >= LIMIT_DOCS else pooled) + margin
        def loss(tau):
            e = ce * np.minimum(bits[:, -1:], tau)
            return (e[np.arange(len(e)), own] + np.log2(np.exp2(-e + e.min(1, keepdims=True)).sum(1)) - e.min(1)).mean()
        model.tau = min((2.0**x for x in range(1, 9)), key=loss)
    return model


def identify(docs: DataFrame, model: CharModels | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` (a learned language, ``und`` for a null text or one without
    letters), ``score`` (0 to 1: the posterior over at most ``tau`` symbols), ``cross_entropy``
    (bits a symbol), ``n_predicted`` and ``rejected`` (no letters, or above the limit). These
    replace columns of the same names. Without a model all is ``und`` and nothing is rejected."""
    docs = without(docs, ADDED)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"),
                                 "n_predicted": F.lit(0).cast("long"), "rejected": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("cross_entropy", T.DoubleType()), T.StructField("n_predicted", T.LongType()),
                           T.StructField("rejected", T.BooleanType())])
    at = docs.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = _Words(m)
        for b in slices(batches, text_col, 2 << 20):
            if len(known) > CACHE_WORDS:
                known = _Words(m)
            best, score, ce, n, out = verdicts(score_texts(b.column(at).to_pylist(), known), m)
            langs = [m.langs[i] if k else UNKNOWN for i, k in zip(best, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64(), mask=n == 0), pa.array(n, pa.int64()), pa.array(out, pa.bool_())],
                names=[*b.schema.names, *ADDED])

    return docs.mapInArrow(trimmed(label), schema)
