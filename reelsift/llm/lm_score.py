"""Scoring documents with a gated recurrent language model trained on the corpus.

Tokens are words and one end per text. Counts of every training word come from the whole corpus.
The network reads and predicts ``SYMBOLS`` symbols: the end and the most frequent words, in classes
of ``CLASS`` by frequency; any other word is one of ``RARE`` classes by its last two characters, and
its share within the class follows its count (add one half, one unseen word more). So

    p(word | before) = p(class | state) * p(word | class, state)   for frequent words,
    p(word | before) = p(class | state) * (c + 0.5) / (N_class + 0.5 (V_class + 1))   for the others.

The network is a GRU in numpy, trained by truncated backpropagation on all training documents, each
read once: they are dealt to rounds and there to shards of ``least_tokens`` tokens or a little more.
Both numbers grow with the corpus, the rounds with the cube root of all shards. The shards of a round
train side by side from the same state; their weights and Adam's moments are written and averaged in
Spark, and the next round starts from them. Scoring carries the state across windows, over whole
documents. Frequent words (``head`` at most) are known to every worker; the counts of the
others come by a join of the documents' rare words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.llm.common import cut_lineage, free

CLASS, SYMBOLS, RARE = 32, 1024, 16
CLASSES = SYMBOLS // CLASS + RARE
HIDDEN = 24
END = 0
WINDOW, LANES = 16, 256     # of truncated backpropagation
LEAST_WINDOWS = 64          # of a lane, unless the lane is the only one
PIECE = 65_536              # symbols of a long document that one shard reads at a time
SCORE_WINDOW, SCORE_LANES = 16, 1024
BATCH_TOKENS = 2_000_000    # scored side by side
BAND, PARTIALS = 8_192, 64   # of the sums of weights
COUNT_WORDS = 400_000       # words that a task counts before it hands them on
READ_BYTES = 8 << 20        # of texts whose words are cut at a time
HEAP = 24 << 20             # bytes of arrays that a worker keeps for the next ones, see keep_heap
SAFE = 60.0                 # logits below it need no shift before their exponentials are summed
LOG10 = math.log(10)


def rare_classes(words: pa.Array) -> np.ndarray:
    """The class of each word, by its last two characters."""
    last = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    own = np.array([zlib.crc32(w.encode()) % RARE for w in last.dictionary.to_pylist()], np.int64)
    return own[last.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)


def slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``b`` in slices whose texts, in ``column``, have ``READ_BYTES`` at most (a longer one is alone)."""
    ends, first = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(), dtype=np.int64), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + READ_BYTES, side="right")))
        yield b.slice(first, last - first)
        first = last


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all of them in a row: those of :func:`common.words`."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    sizes, found = pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()
    there = pc.binary_length(found).to_numpy() > 0  # a gap at either end leaves an empty piece
    if not there.all():
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~there], minlength=len(sizes))
        found = found.filter(pa.array(there))
    return sizes, found


# ---- counts ----------------------------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (one string column), as a written table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return found.select(["word", "c_sum"]).rename_columns(["word", "c"])

        for b in batches:
            for some in slices(b, 0):
                found = words_of(some.column(0))[1].value_counts()
                held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
                if sum(map(len, held)) > 3 * COUNT_WORDS:
                    held = [summed()]
                    if len(held[0]) > COUNT_WORDS:
                        yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return cut_lineage(texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


@dataclass
class Vocabulary:
    """``head``: frequent words by count, each with its count; ``least``: the least count that all
    words of the head have; rare_n, rare_v: tokens and words of the rare classes."""

    head: list[bytes]
    count: np.ndarray
    least: int
    tokens: int
    distinct: int
    ends: int
    rare_n: np.ndarray
    rare_v: np.ndarray

    def base_floor(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))

    def rare_floor(self) -> np.ndarray:
        return np.log10(self.rare_n + 0.5 * (self.rare_v + 1))


def vocabulary(counts: DataFrame, ends: int, head: int) -> Vocabulary:
    """The head is cut at a power of 2 ** (1/8) of the count, so that it has ``head`` words at most."""
    eighth = F.floor(F.log2("c") * 8).cast("int")
    sizes = {r.b: (r.w, r.n) for r in counts.groupBy(eighth.alias("b")).agg(F.count("*").alias("w"), F.sum("c").alias("n")).collect()}  # a few hundred rows
    cut, have = max(sizes, default=0) + 1, 0
    for b in sorted(sizes, reverse=True):
        if have + sizes[b][0] > head:
            break
        cut, have = b, have + sizes[b][0]
    rows = counts.filter(eighth >= cut).collect()  # ``head`` rows at most
    rows.sort(key=lambda r: (-r.c, r.word))
    least = min((r.c for r in rows), default=1 << 62)
    frequent = counts.sparkSession.createDataFrame([(r.word,) for r in rows[:SYMBOLS - 1]], "word string")
    rare = counts.join(F.broadcast(frequent), "word", "left_anti").groupBy(
        (F.crc32(F.substring("word", -2, 2).cast("binary")) % RARE).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(RARE), np.zeros(RARE)
    for r in rare:
        n[r.k], v[r.k] = r.n, r.v
    tokens, distinct = sum(x for _, x in sizes.values()) + ends, sum(x for x, _ in sizes.values()) + (ends > 0)
    return Vocabulary([r.word.encode() for r in rows], np.array([r.c for r in rows], np.int64), int(least), tokens, distinct, ends, n, v)


class Reader:
    """word -> place in the head, -1 for the others; and what a place stands for."""

    def __init__(self, v: Vocabulary):
        self.head = pa.array(v.head, pa.binary()).cast(pa.string())
        self.floor, self.rare_floor = v.base_floor(), v.rare_floor()
        k = rare_classes(self.head)
        frequent = np.arange(len(v.head)) < SYMBOLS - 1
        self.symbol = np.append(np.where(frequent, np.arange(len(v.head)) + 1, SYMBOLS + k), -1).astype(np.int16)
        known = np.log10(v.count + 0.5) if len(k) else np.zeros(0)
        self.base = known - self.floor
        self.within = np.where(frequent, 0.0, known - self.rare_floor[k])
        self.end = math.log10(v.ends + 0.5) - self.floor

    def read(self, texts: pa.Array) -> list[pa.Array | np.ndarray]:
        """Of each text: its symbols (int16, with its end), their number, words of the head, what these
        add to both scores, and the words beyond the head with their counts."""
        sizes, found = words_of(texts)
        at = pc.index_in(found, value_set=self.head).fill_null(-1).to_numpy()
        symbols, inside, beyond = self.symbol[at], at[at >= 0], np.flatnonzero(at < 0)
        others = found.take(pa.array(beyond))
        classes = rare_classes(others)
        symbols[beyond] = SYMBOLS + classes
        owner = np.repeat(np.arange(len(sizes)), sizes)[beyond]
        missed = np.bincount(owner, minlength=len(sizes))

        def sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
            cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
            return np.array([x[i:j].sum() for i, j in zip(cuts, cuts[1:], strict=False)])

        base = sums(self.base[inside], sizes - missed) + self.end - missed * self.floor
        lm = sums(self.within[inside], sizes - missed) - sums(self.rare_floor[classes], missed)
        ends = np.cumsum(sizes + 1)
        whole = np.full(ends[-1] if len(ends) else 0, END, np.int16)
        inner = np.ones(len(whole), bool)
        inner[ends - 1] = False
        whole[inner] = symbols
        offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
        coded = others.dictionary_encode()
        key, n = np.unique(owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
        owner, word = np.divmod(key, max(1, len(coded.dictionary)))
        pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)), pa.array(n, pa.int64())], ["word", "n"])
        tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32()), pairs)
        return [raw, sizes + 1, sizes - missed, base, lm, tails]


# ---- the network -----------------------------------------------------------------------------

def first_weights(v: Vocabulary, seed: int = 29) -> dict[str, np.ndarray]:
    """Small random weights; the output biases are the corpus' own frequencies."""
    rng = np.random.default_rng(seed)
    slots = np.full(SYMBOLS, -1e9)
    frequent = min(len(v.head), SYMBOLS - 1)
    slots[END] = math.log(v.ends + 0.5)
    slots[1:frequent + 1] = np.log(v.count[:frequent] + 0.5)
    mass = np.concatenate([np.where(slots > -1e8, np.exp(slots), 0).reshape(-1, CLASS).sum(1), v.rare_n + 0.5 * (v.rare_v + 1)])
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"x": small(SYMBOLS + RARE, 3 * HIDDEN), "h": small(HIDDEN, 3 * HIDDEN), "c": small(HIDDEN, CLASSES),
            "cb": np.log(np.maximum(mass, 1e-6)).astype(np.float32), "w": small(HIDDEN, SYMBOLS), "wb": slots.astype(np.float32)}


def keep_heap() -> None:
    """The C library maps arrays of this size, and smaller ones until it has seen one, anew each time, and
    clearing their pages took a fifth of training. Once one is freed, smaller ones come from the heap."""
    np.empty(HEAP, np.uint8)


def split(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights as :func:`step` and :func:`outputs` use them: a table of its own for each gate, so
    that a gate's values lie together (halved for the sigmoids, which are taken as (1 + tanh(x / 2)) / 2),
    and output columns first, so that softmax sums run along memory. Biases are shifted to a maximum of 0
    in every softmax; states lie between -1 and 1, so if ``safe`` no logit reaches ``SAFE``, and the
    largest is above -``SAFE``."""
    q = {f"{k}{g}": np.ascontiguousarray(p[k][:, i * HIDDEN:(i + 1) * HIDDEN]) for k in "xh" for i, g in enumerate("rzn")}
    for k in ("xr", "xz", "hr", "hz"):
        q[k] *= 0.5
    within = p["wb"].reshape(-1, CLASS)
    return {**q, "c": np.ascontiguousarray(p["c"].T), "cb": (p["cb"] - p["cb"].max())[:, None], "w": np.ascontiguousarray(p["w"].T),
            "wb": (within - within.max(1, keepdims=True)).reshape(-1, 1), "safe": max(np.abs(p[k]).sum(0).max() for k in "cw") < SAFE}


def _gate(x: np.ndarray) -> np.ndarray:
    """The sigmoid of 2 ``x``, in place."""
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def step(q: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray):
    """One GRU step for symbols ``x`` and states ``h`` (a row each; ``q`` as :func:`split` gives it):
    new states, and what backpropagation needs."""
    r, z, ghn = h @ q["hr"], h @ q["hz"], h @ q["hn"]
    r += q["xr"].take(x, 0)
    z += q["xz"].take(x, 0)
    _gate(r)
    _gate(z)
    n = r * ghn
    n += q["xn"].take(x, 0)
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (r, z, n, ghn)


def _log_sums(x: np.ndarray, softmax: bool, safe: bool) -> np.ndarray:
    """The logarithm of each column's sum of exponentials; ``x`` becomes the softmax if asked for."""
    top = 0.0
    if not safe:
        top = x.max(0)
        x -= top
    np.exp(x, out=x)
    total = x.sum(0)
    if softmax:
        x /= total
    return np.log(total) + top


def classes_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < SYMBOLS, symbols // CLASS, SYMBOLS // CLASS + symbols - SYMBOLS).astype(np.uint8)


def outputs(q: dict[str, np.ndarray], states: np.ndarray, symbols: np.ndarray, grads: dict[str, np.ndarray] | None = None):
    """Log probability (natural) of each symbol after its state; with ``grads``, adds to them and
    returns the states' gradients of the summed negative log likelihood too. Tokens are put in the
    order of their classes, so that a class is a run of rows."""
    k = classes_of(symbols)
    order = np.argsort(k, kind="stable")
    k, symbols, states = k[order], symbols[order], states.take(order, 0)
    at = np.arange(len(k))
    x = q["c"] @ states.T
    x += q["cb"]
    own = x[k, at]
    out = (own - _log_sums(x, grads is not None, q["safe"])).astype(np.float64)
    back = None
    if grads is not None:
        x[k, at] -= 1
        grads["c"] += (x @ states).T
        grads["cb"] += x.sum(1)
        back = x.T @ q["c"]
    cuts = np.searchsorted(k, np.arange(SYMBOLS // CLASS + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        here, words_ = slice(cuts[c], cuts[c + 1]), slice(c * CLASS, (c + 1) * CLASS)
        s, j, at = states[here], symbols[here] - c * CLASS, np.arange(cuts[c + 1] - cuts[c])
        x = q["w"][words_] @ s.T
        x += q["wb"][words_]
        own = x[j, at]
        out[here] += own - _log_sums(x, grads is not None, q["safe"])
        if grads is not None:
            x[j, at] -= 1
            grads["w"][:, words_] += (x @ s).T
            grads["wb"][words_] += x.sum(1)
            back[here] += x.T @ q["w"][words_]
    logp = np.empty_like(out)
    logp[order] = out
    if grads is None:
        return logp, None
    unsorted = np.empty_like(back)
    unsorted[order] = back
    return logp, unsorted


def train_window(p, x: np.ndarray, y: np.ndarray, h: np.ndarray):
    """Gradients of one window (steps x lanes) by backpropagation that stops at its first step; an
    end as input opens a document with an empty state. Returns them, the mean loss and the states."""
    q, steps, states, kept = split(p), [], [], []
    for t in range(len(x)):
        on = (x[t] != END).astype(h.dtype)[:, None]
        before = h * on
        h, parts = step(q, x[t], before)
        steps.append(parts)
        states.append(h)
        kept.append((before, on))
    g = {k: np.zeros_like(a) for k, a in p.items()}
    logp, back = outputs(q, np.concatenate(states), y.ravel(), g)
    back = back.reshape(len(x), -1, HIDDEN)
    dh = np.zeros_like(h)
    wide = np.empty((len(x), x.shape[1], 3 * HIDDEN), h.dtype)
    for t in range(len(x) - 1, -1, -1):
        (r, z, n, ghn), (before, on) = steps[t], kept[t]
        dh += back[t]
        dn = (1 - z) * dh
        dn *= 1 - n * n
        dz = before - n
        dz *= dh
        dz *= z * (1 - z)
        dr = dn * ghn
        dr *= r * (1 - r)
        wide[t, :, :HIDDEN], wide[t, :, HIDDEN:2 * HIDDEN], wide[t, :, 2 * HIDDEN:] = dr, dz, dn
        dn *= r  # from here the gradient of the states' part
        gates = np.concatenate([dr, dz, dn], 1)
        g["h"] += before.T @ gates
        dh *= z
        dh += gates @ p["h"].T
        dh *= on
    symbols = x.ravel().astype(np.int16, copy=False)
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(np.diff(symbols, prepend=-1))
    g["x"][symbols[first]] = np.add.reduceat(wide.reshape(-1, 3 * HIDDEN).take(order, 0), first)
    return g, -logp.mean(), h


def with_moments(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights and Adam's state, which goes on from round to round: both moments, and the updates made."""
    return {**p, **{f"m.{k}": np.zeros_like(a) for k, a in p.items()}, **{f"s.{k}": np.zeros_like(a) for k, a in p.items()},
            "updates": np.zeros(1, np.float32)}


def train(state: dict[str, np.ndarray], docs: list[np.ndarray], rate: float, done: float = 0.0, share: float = 1.0) -> dict[str, np.ndarray]:
    """Adam over the documents once, laid end to end in at most ``LANES`` lanes; the few symbols that
    do not fill all lanes go to a last, shorter lane of their own. ``state`` is that of
    :func:`with_moments` (bare weights start anew); the rate falls evenly over the whole training,
    of which ``done`` lies behind and this call is ``share``."""
    keep_heap()
    state = {k: a.copy() for k, a in (state if "updates" in state else with_moments(state)).items()}
    p = {k: state[k] for k in state if k != "updates" and "." not in k}
    flat = np.concatenate(docs)
    lanes = max(1, min(LANES, len(flat) // (LEAST_WINDOWS * WINDOW)))
    length = len(flat) // lanes
    before = np.concatenate([[END], flat[:-1]])
    even = lanes * length
    parts = [(before[:even].reshape(lanes, length).T, flat[:even].reshape(lanes, length).T)]
    if even < len(flat):
        parts.append((before[even:, None], flat[even:, None]))
    total, n = sum(-(-len(x) // WINDOW) for x, _ in parts), 0
    for x, y in parts:
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for at in range(0, len(x), WINDOW):
            g, _, h = train_window(p, x[at:at + WINDOW], y[at:at + WINDOW], h)
            n += 1
            state["updates"] += 1
            made = float(state["updates"][0])
            now = rate * (1 - 0.9 * (done + share * n / total)) * x.shape[1] / lanes / (1 - 0.9**made)
            scale, root = 1.0 / y[at:at + WINDOW].size, math.sqrt(1 - 0.99**made)
            for k, a in p.items():
                m, s, d = state[f"m.{k}"], state[f"s.{k}"], g[k]
                d *= scale
                m *= 0.9
                m += 0.1 * d
                d *= d
                d *= 0.01
                s *= 0.99
                s += d
                np.sqrt(s, out=d)
                d /= root
                d += 1e-6
                np.divide(m, d, out=d)
                d *= now
                a -= d
    return state


def score_docs(p: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each document's symbols. Documents of like length run side by side,
    ``SCORE_LANES`` at a time, in windows; the states go on from one window to the next."""
    keep_heap()
    q = split(p)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    order, out = np.argsort(-sizes, kind="stable"), np.empty(len(docs))
    for first in range(0, len(docs), SCORE_LANES):
        some = order[first:first + SCORE_LANES]
        out[some] = _score_lanes(q, [docs[i] for i in some], sizes[some])
    return out


def _score_lanes(q: dict[str, np.ndarray], docs: list[np.ndarray], lens: np.ndarray) -> np.ndarray:
    """``docs`` from the longest to the shortest; a lane ends with its document."""
    flat, starts = np.concatenate(docs), np.cumsum(lens) - lens
    alive = np.searchsorted(-lens, -np.arange(int(lens[0]) + 1), side="left")  # documents longer than t
    total, h = np.zeros(len(docs)), np.zeros((len(docs), HIDDEN), q["hn"].dtype)
    lanes, y = np.arange(len(docs)), np.full(len(docs), END, flat.dtype)
    for at in range(0, int(lens[0]), SCORE_WINDOW):
        states, symbols, owner = [], [], []
        for t in range(at, min(at + SCORE_WINDOW, int(lens[0]))):
            n = alive[t]
            h, _ = step(q, y[:n], h[:n])
            y = flat.take(starts[:n] + t)
            states.append(h)
            symbols.append(y)
            owner.append(lanes[:n])
        logp, _ = outputs(q, np.concatenate(states), np.concatenate(symbols))
        total += np.bincount(np.concatenate(owner), logp, len(docs))
    return total / LOG10


# ---- on Spark --------------------------------------------------------------------------------

READ = "doc_id", "draw", "training", "copy", "n_tokens", "n_known", "base", "lm", "tail", "symbols"


def read_texts(docs: DataFrame, v: Vocabulary, id_col: str, text_col: str, training: Column, seed: int) -> DataFrame:
    """Every text once, as a written table: its symbols (int16), what the words of the head add to both
    scores, and the words beyond it (``tail``). ``draw`` deals rows to shards; ``copy`` counts rows that
    repeat their draw in a batch, so that many equal rows do not meet in one shard (which of them goes
    where follows the batches)."""
    shared, ends = docs.sparkSession.sparkContext.broadcast(Reader(v)), int(v.ends > 0)
    types = (docs.schema[id_col].dataType, T.LongType(), T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(),
             T.ArrayType(T.StructType().add("word", "string").add("n", "long")), T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value
        for whole in batches:
            seen: Counter = Counter()
            for b in slices(whole, 3):
                copies = []
                for draw in b.column(1).to_pylist():
                    copies.append(seen[draw])
                    seen[draw] += 1
                raw, n, known, base, lm, tails = reader.read(b.column(3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(copies, pa.int64()), pa.array(n, pa.int64()),
                                                  pa.array(known + ends, pa.int64()), pa.array(base), pa.array(lm), tails, raw], names=READ)

    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(seed)), F.lit(1 << 60))
    chosen = docs.select(F.col(f"`{id_col}`"), draw, F.coalesce(training, F.lit(False)), F.col(f"`{text_col}`").cast("string"))
    schema = T.StructType([T.StructField(k, t) for k, t in zip(READ, types, strict=True)])
    return cut_lineage(chosen.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "read")


def _learner(state, rate: float, done: float, share: float):
    """Trains one shard from the broadcast ``state``, on its pieces in the order of their draw."""
    def learn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("draw", "ascending"), ("place", "ascending"), ("symbols", "ascending")])
        texts = [np.frombuffer(s, np.int16) for s in t["symbols"].to_pylist()]
        new = train(state.value, texts, rate, done, share)
        return pa.table({"tokens": pa.array([sum(map(len, texts))], pa.int64()),
                         "weights": pa.array([np.concatenate([a.ravel() for a in new.values()]).tobytes()], pa.binary())})

    return learn


def dealt(read: DataFrame, slots: int) -> DataFrame:
    """(draw, place, slot, symbols): the training texts of ``read`` in pieces of ``PIECE`` symbols at
    most, dealt evenly to ``slots``."""
    pieces = read.filter("training").select("draw", "copy", "symbols", F.explode(F.sequence(F.lit(0), F.octet_length("symbols") - 1, F.lit(2 * PIECE))).alias("place"))
    return pieces.select("draw", "place", F.pmod(F.xxhash64("draw", "place", "copy"), F.lit(slots)).alias("slot"),
                         F.substring("symbols", F.col("place") + 1, F.lit(2 * PIECE)).alias("symbols"))


def averaged(found: DataFrame, state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of the shards' states by their tokens, summed in Spark: ``PARTIALS`` partial sums at
    most, then a sum per band of ``BAND`` numbers. ``state`` without shards."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for tokens, raw in zip(b.column("tokens").to_pylist(), b.column("weights"), strict=True):
                one = np.append(np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * tokens, tokens)
                total = one if total is None else total + one
        if total is not None:
            bands = [total[at:at + BAND].tobytes() for at in range(0, len(total), BAND)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(bands)), pa.int32()), pa.array(bands, pa.binary())], names=["band", "sums"])

    def together(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return pa.table({"band": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sum(np.frombuffer(s, np.float64) for s in t["sums"].to_pylist()).tobytes()], pa.binary())})

    partial = found.coalesce(PARTIALS).mapInArrow(add, "band int, sums binary")
    bands = sorted(partial.groupBy("band").applyInArrow(together, "band int, sums binary").collect(), key=lambda r: r.band)  # a row per ``BAND`` weights
    if not bands:
        return state
    flat = np.concatenate([np.frombuffer(r.sums, np.float64) for r in bands])
    cuts = np.cumsum([a.size for a in state.values()])
    return {k: x.reshape(a.shape).astype(np.float32) for (k, a), x in zip(state.items(), np.split(flat[:-1] / flat[-1], cuts[:-1]), strict=True)}


def counted(chosen: DataFrame, text_col: str, head: int):
    """(counts, vocabulary) of the training rows ``chosen``."""
    counts = word_counts(chosen.select(F.col(f"`{text_col}`").cast("string").alias("text")))
    return counts, vocabulary(counts, chosen.count(), head)


def learned(read: DataFrame, v: Vocabulary, least_tokens: int, rounds: int | None, rate: float, seed: int) -> dict[str, np.ndarray]:
    """The network's weights after all rounds over the training texts of ``read``."""
    sc = read.sparkSession.sparkContext
    state = with_moments(first_weights(v, seed))
    if v.tokens:
        rounds = rounds or max(2, round((v.tokens / least_tokens) ** (1 / 3)))
        shards = max(1, v.tokens // (rounds * least_tokens))
        pieces = dealt(read, rounds * shards)
        for i in range(rounds):
            learn = _learner(sc.broadcast(state), rate, i / rounds, 1 / rounds)
            mine = pieces.filter(f"slot >= {i * shards} and slot < {(i + 1) * shards}").repartition(shards, "slot")
            found = cut_lineage(mine.groupBy("slot").applyInArrow(learn, "tokens long, weights binary"), "weights")
            state = averaged(found, state)
            free(found)
    return {k: a for k, a in state.items() if k != "updates" and "." not in k}


def fit(docs: DataFrame, id_col: str, text_col: str, training: Column, *, head: int = 200_000, least_tokens: int = 500_000,
        rounds: int | None = None, rate: float = 0.02, seed: int = 29):
    """Counts and a network, both over all training documents. The network reads each document in one
    of ``rounds`` rounds, in shards of ``least_tokens`` tokens or a little more (one shard a round if
    there are fewer). By default the rounds grow with the cube root of the corpus' shards (two at
    least), so that a larger corpus gives more updates one after the other, and more side by side.
    Returns (counts, vocabulary, weights)."""
    chosen = docs.filter(training)
    counts, v = counted(chosen, text_col, head)
    read = read_texts(chosen, v, id_col, text_col, F.lit(True), seed)
    weights = learned(read, v, least_tokens, rounds, rate, seed)
    free(read)
    return counts, v, weights


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``base_score`` is the add-one-half unigram log10 probability, ``score`` the network's. A null
    text is empty: one end. Rows that repeat an id are scored each. Without training documents every
    count is 0 and the network stays as it starts."""
    counts, v, weights = model
    return scored(read_texts(docs, v, id_col, text_col, F.lit(False), 0), counts, v, weights)


def fit_score(docs: DataFrame, id_col: str, text_col: str, training: Column, *, head: int = 200_000, least_tokens: int = 500_000,
              rounds: int | None = None, rate: float = 0.02, seed: int = 29) -> DataFrame:
    """:func:`fit` on the training rows of ``docs`` and :func:`score` of all of them, with ``training``
    as a column too; each text is cut into symbols once for both."""
    counts, v = counted(docs.filter(training), text_col, head)
    read = read_texts(docs, v, id_col, text_col, training, seed)
    return scored(read, counts, v, learned(read, v, least_tokens, rounds, rate, seed), "training")


def scored(read: DataFrame, counts: DataFrame, v: Vocabulary, weights: dict[str, np.ndarray], *extra: str) -> DataFrame:
    """:func:`score` of texts that have been read, with columns ``extra`` of theirs."""
    shared = read.sparkSession.sparkContext.broadcast(weights)
    rows = read.select("doc_id", *extra, "n_tokens", "n_known", "base", "lm", "uid", "symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at, net = b.column("symbols"), 0, [np.zeros(0)]
            while at < len(texts):
                found, size = [], 0
                while at < len(texts) and (size == 0 or size < BATCH_TOKENS):
                    found.append(np.frombuffer(texts[at].as_buffer(), np.int16))
                    size += len(found[-1])
                    at += 1
                net.append(score_docs(shared.value, found))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(net))], names=[*b.schema.names[:-1], "net"])

    full = cut_lineage(rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("net", T.DoubleType())])), "scored")
    # counts of the words beyond the head, which no worker knows
    rare = counts.filter(F.col("c") < v.least)
    tail = read.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.n").join(rare, "word", "left")
    sums = tail.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more"),
                                   F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    full = full.join(sums, "uid", "left")
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return full.select("doc_id", *extra, "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
                       (F.col("base") + more).alias("base_score"), (F.col("lm") + F.col("net") + more).alias("score"))
