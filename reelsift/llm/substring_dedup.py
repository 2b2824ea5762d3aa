"""Substring dedup: every word covered by a window of words that also starts elsewhere goes.

A compressed FM-index per shard, searched backwards. What goes into a shard is decided by content, so
that equal windows always meet in one shard and the work grows with the text, not with shards times
documents:

1. A window's minimizer is the smallest hash among its 8-word sequences. Consecutive windows of one
   minimizer form a run; a run of at most 30 windows is a segment of at most 64 words. Equal windows
   have equal minimizers, so a window can only repeat if its minimizer occurs twice: one count by hash,
   known to all tasks as a bitmap of bounded size, leaves out nearly all other runs (a full bitmap
   would let more of them through, and lose none).
2. The remaining segments are cut out of their texts and counted by their words. Copies collapse here,
   before any shard sees them.
3. A minimizer with very many different segments (the edges of a passage that a third of all documents
   quote) is first thinned: a count by window hash leaves out windows that cannot repeat (a bitmap again).
4. Each shard builds an FM-index of its different segments (suffix order, Burrows-Wheeler transform,
   wavelet matrix of packed bits with counts per 64) and streams the segments that occur once through
   it: backward search gives the longest left and right extensions that still occur twice, and all
   windows inside them are reported. Segments that occur twice as a whole need no search.

Hashes only choose what is compared; what counts as equal are the words in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import cut_lineage, without
from reelsift.llm.filters import broadcast_filter, frequent_hashes
from reelsift.llm.tokens import Words, grams, slices, sliding, spread

WINDOW = 35
#: Words of a minimizer, and windows of a segment at most (a segment then has 64 words).
GRAM, RUN = 8, 30
#: Words that a shard indexes, on average.
SHARD_WORDS = 500_000
#: Different segments of one minimizer from which on its windows are thinned first.
CROWD = 256

PIECES = "key long, size int, run long, h long, content string"


def _runs(w: Words, window: int) -> tuple[np.ndarray, ...]:
    """The runs of all texts: text, first word (in all texts), windows, minimizer."""
    wide = window - GRAM + 1
    g = grams(w.hashes()[w.codes], GRAM) if len(w.codes) else np.zeros(0, np.uint64)
    low = sliding(g, wide, np.minimum)
    count = np.maximum(0, np.diff(w.first) - window + 1)  # windows of each text
    text, at = np.repeat(np.arange(len(count)), count), spread(w.first[:-1], count)
    least = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(at)))
    parts = -(-length // RUN)  # a long run (one sequence again and again) in parts
    inner = RUN * spread(np.zeros(len(parts), np.int64), parts)
    begin = np.repeat(starts, parts) + inner
    return text[begin], at[begin], np.minimum(RUN, np.repeat(length, parts) - inner), least[begin], g


def _minimizers(window: int):
    """(h, n): minimizers and how often they occur, up to two for each run."""
    reach = np.arange(RUN + window - GRAM)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, word, n, h, g = _runs(Words(batch["text"]), window)
            if len(h):
                seen = g[np.minimum(word[:, None] + reach, len(g) - 1)] == h[:, None]
                times = np.minimum(2, (seen & (reach < (n + window - GRAM)[:, None])).sum(1))
                found, back = np.unique(h, return_inverse=True)
                total = np.bincount(back, times, len(found)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["h", "n"])
    return go


def _cut(window: int, known):
    """The segments of the runs whose minimizers are ``known``; run is start * 64 + windows."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch["text"])
            text, word, n, h, _ = _runs(w, window)
            some = known.value.has(h)
            text, word, n, h = text[some], word[some], n[some], h[some]
            back, run = pa.array(text), (word - w.first[text]) * 64 + n
            yield pa.RecordBatch.from_arrays([batch["key"].take(back), batch["size"].take(back), pa.array(run), pa.array(h.view(np.int64)),
                                              w.joined(word, n + window - 1)], ["key", "size", "run", "h", "content"])
    return go


def _window_hashes(window: int):
    """Hashes of all windows of the segments, and their copies."""
    def of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in slices([batch], "content"):
            w = Words(part["content"])
            n = np.diff(w.first) - window + 1
            hashes = grams(w.hashes()[w.codes], window)
            yield hashes[spread(w.first[:-1], n)], np.repeat(part["copies"].to_numpy(), n)
    return of


def _thin(window: int, known):
    """Segments cut down to the runs of their windows that are ``known``: (g, off, h, content, copies)."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            w = Words(batch["content"])
            n = np.diff(w.first) - window + 1
            at = spread(w.first[:-1], n)
            row = np.repeat(np.arange(len(n)), n)
            some = known.value.has(grams(w.hashes()[w.codes], window)[at])
            at, row = at[some], row[some]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(at)))
            back = pa.array(row[begin])
            off = at[begin] - w.first[row[begin]]
            yield pa.RecordBatch.from_arrays([batch["g"].take(back), pa.array(off.astype(np.int32)), batch["h"].take(back),
                                              w.joined(at[begin], n + window - 1), batch["copies"].take(back)],
                                             ["g", "off", "h", "content", "copies"])
    return go


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``ids`` sorted by their first ``depth`` numbers at least, by prefix doubling."""
    n, rank, step = len(ids), ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        key = rank * (n + 2)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


class FMIndex:
    """FM-index of ``ids`` (numbers from 0): its Burrows-Wheeler transform as a wavelet matrix, one
    level of packed bits for each bit of a number, with the count of ones before every 64.

    ``depth`` bounds the length of what is searched."""

    def __init__(self, ids: np.ndarray, depth: int = 64):
        self.ids = ids = np.asarray(ids, np.int64)
        sigma = int(ids.max()) + 1 if len(ids) else 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=sigma))])  # rows of smaller numbers
        row = ids[suffix_order(ids, depth) - 1] if len(ids) else ids  # number before each suffix, in suffix order
        self.shifts = list(range(max(1, (sigma - 1).bit_length()) - 1, -1, -1))
        self.bits, self.ones, self.zeros = [], [], []
        for shift in self.shifts:
            one = (row >> shift) & 1
            packed = np.packbits(one.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1])
            self.zeros.append(len(row) - int(one.sum()))
            row = np.concatenate([row[one == 0], row[one == 1]])
        every = np.arange(sigma)
        self.base = self.before[:-1] - self._down(every, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place in the last level of the first ``i`` rows' numbers ``c``."""
        for shift, bits, ones, zeros in zip(self.shifts, self.bits, self.ones, self.zeros):
            block = i >> 6
            below = bits[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            rank = ones[block] + np.bitwise_count(below)
            i = np.where((c >> shift) & 1, zeros + rank, i - rank)
        return i

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows of ``c`` followed by what the rows low .. high - 1 begin with."""
        both = self._down(np.concatenate([c, c]), np.concatenate([low, high]))
        return self.base[c] + both[:len(c)], self.base[c] + both[len(c):]

    def reach(self, ends: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each end the smallest p >= stop for which ids[p .. end] occurs twice; end + 1 if none does."""
        c = self.ids[ends]
        low, high, p = self.before[c], self.before[c + 1], ends + 1
        live = np.flatnonzero(high - low >= 2)
        p[live] = ends[live]
        while len(live := live[p[live] > stops[live]]):
            lo, hi = self.step(self.ids[p[live] - 1], low[live], high[live])
            ok = hi - lo >= 2
            live = live[ok]
            low[live], high[live] = lo[ok], hi[ok]
            p[live] -= 1
        return p

    def repeated(self, begin: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
        """Bit i: window i of the ``n`` windows from ``begin`` occurs twice.

        A window that fails at p - 1 rules out all windows that start before p. One that holds is
        extended to the right as far as the text from its start still occurs twice (by bisection), and
        all windows inside are reported."""
        found, s, last = np.zeros(len(begin), np.uint64), begin.copy(), begin + n - 1
        todo = np.arange(len(begin))
        while len(todo):
            p = self.reach(s[todo] + window - 1, s[todo])
            hit = p <= s[todo]
            s[todo[~hit]] = p[~hit]
            got = todo[hit]
            first, low, high = s[got], s[got] + window - 1, last[got] + window - 1
            try_at = high.copy()  # whole first: most extensions go to the end
            while len(at := np.flatnonzero(low < high)):
                ok = self.reach(try_at[at], first[at]) <= first[at]
                low[at[ok]], high[at[~ok]] = try_at[at[ok]], try_at[at[~ok]] - 1
                try_at = (low + high + 1) // 2
            width = (low - window + 2 - first).astype(np.uint64)
            found[got] |= ((np.uint64(1) << width) - np.uint64(1)) << (first - begin[got]).astype(np.uint64)
            s[got] = low - window + 2
            todo = todo[s[todo] <= last[todo]]
        return found


def _search(window: int):
    """One shard: an index of all its segments, and the windows that occur twice in it as bits."""
    def go(table: pa.Table) -> pa.Table:
        w = Words(table["content"].combine_chunks())
        length = np.diff(w.first)
        start = np.cumsum(length + 1) - length - 1
        ids = np.zeros(int((length + 1).sum()), np.int64)  # 0 ends each segment
        ids[spread(start, length)] = w.codes + 1
        n = length - window + 1
        bits = ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
        once = np.flatnonzero(table["copies"].to_numpy() < 2)
        if len(once):
            bits[once] = FMIndex(ids, RUN + window - 1).repeated(start[once], n[once], window)
        some = pa.array(bits > 0)
        return pa.table({"part": table["part"].filter(some), "bits": pa.array(bits.view(np.int64)).filter(some)})
    return go


def _remove(window: int):
    """Every text without the words that its marked windows cover."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w, marks = Words(batch["text"]), batch["marks"]
            items = marks.flatten()
            many = np.diff(np.asarray(marks.offsets))
            row = np.repeat(np.arange(batch.num_rows), many)
            start = items.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = items.field("bits").to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.zeros(len(w.codes) + 1, np.int64)
            for i in range(RUN):
                on = (bits >> np.uint64(i)) & np.uint64(1) > 0
                at = w.first[row[on]] + start[on] + i
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            removed = before[w.first[1:]] - before[w.first[:-1]]
            words = np.diff(w.first)
            kept = Words.__new__(Words)
            kept.codes, kept.values = w.codes[~gone], w.values
            left = words - removed
            text = kept.joined(np.cumsum(left) - left, left)
            edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            # spans end with their text, even where the next text begins with a removed word
            split = np.zeros(len(w.codes) + 1, bool)
            split[w.first] = True
            begin = np.flatnonzero((edge[:len(gone)] == 1) | (split[:-1] & gone))
            stop = np.flatnonzero((edge == -1) | (split & np.concatenate([[False], gone])))
            of = np.searchsorted(w.first, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begin - w.first[of]), pa.array(stop - begin)], ["start", "length"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]).astype(np.int32)
            rest = [batch[c] for c in batch.schema.names if c not in ("text", "marks")]
            names = [c for c in batch.schema.names if c not in ("text", "marks")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(words), pa.array(removed), pa.ListArray.from_arrays(pa.array(ends), spans), text],
                                             [*names, "n_words", "n_removed", "removed", "kept_text"])
    return go


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, size, marks): for every text with such windows those that also start elsewhere, as
    array<struct<start, bits>> (bit i: the window at word start + i). ``texts`` has key, size and text."""
    if not GRAM < window <= 64 - RUN + 1:
        raise ValueError(f"window must be {GRAM + 1} to {64 - RUN + 1} words")
    counts = texts.mapInArrow(_minimizers(window), "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    often = cut_lineage(counts.filter("n >= 2").select("h"), "minimizers")
    known = broadcast_filter(often, often.count())
    pieces = cut_lineage(texts.mapInArrow(_cut(window, known), PIECES), "pieces")
    g = F.unhex(F.md5("content"))
    segments = cut_lineage(pieces.groupBy("h", "content").agg(F.count(F.lit(1)).alias("copies")).withColumn("g", g), "segments")

    crowds = segments.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("h")
    crowded = cut_lineage(segments.join(crowds, "h", "left_semi"), "crowded")
    twice = frequent_hashes(crowded.select("content", "copies"), _window_hashes(window), 2, RUN * crowded.count())
    thin = cut_lineage(crowded.select("g", "h", "content", "copies")
                       .mapInArrow(_thin(window, broadcast_filter(twice, twice.count())), "g binary, off int, h long, content string, copies long"), "thinned")
    plain = segments.join(crowds, "h", "left_anti")
    thin = thin.withColumn("part", g)
    indexed = plain.select("h", "content", "copies", F.col("g").alias("part")).unionByName(
        thin.groupBy("h", "content").agg(F.sum("copies").alias("copies")).withColumn("part", g).select("h", "content", "copies", "part"))
    words = segments.agg(F.sum(F.size(F.split("content", " ")))).first()[0] or 0
    shards = F.pmod(F.xxhash64("h"), F.lit(-(-words // SHARD_WORDS) or 1))
    found = cut_lineage(indexed.withColumn("shard", shards).groupBy("shard").applyInArrow(_search(window), "part binary, bits long"), "repeats")

    offs = plain.select("g", F.lit(0).alias("off"), F.col("g").alias("part")).unionByName(thin.select("g", "off", "part"))
    hits = offs.join(found, "part").select("g", "off", "bits")
    marks = pieces.select("key", "size", "run", g.alias("g")).join(hits, "g")
    start = (F.shiftright("run", 6) + F.col("off")).cast("long").alias("start")
    return marks.groupBy("key", "size").agg(F.collect_set(F.struct(start, "bits")).alias("marks"))


def remove_repeats(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` without its texts, and with n_words, n_removed (longs), removed (array<struct<start,
    length>> in words) and kept_text: the words that no repeated window covers, joined by one space.

    A window is ``window`` consecutive words (runs of anything but space and 9 to 13, unchanged) of one
    text, and is repeated if its words also start anywhere else, the same text included; all windows are
    judged on the input. Null and empty texts have no words and keep an empty text; texts shorter than a
    window keep all; rows that repeat a text all lose its windows; an empty table gives an empty one. No
    id is used, so null and repeated ids do no harm. Columns named like those added are replaced."""
    own = ["n_words", "n_removed", "removed", "kept_text", "_key", "_size", "marks"]
    rest = without(df.drop(text) if text not in own else df, own)
    body = F.coalesce(F.col(text), F.lit(""))
    source = df.select(*[F.col(f"`{c}`") for c in rest.columns], F.xxhash64(body).alias("_key"), F.octet_length(body).alias("_size"), body.alias("_text"))
    texts = source.select(F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("_text").alias("text"))
    marks = repeated_windows(texts, window).withColumnsRenamed({"key": "_key", "size": "_size"})
    none = F.array().cast("array<struct<start:long,bits:long>>")
    row = F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row") if rest.columns else F.lit(0).alias("row")
    joined = source.join(marks, ["_key", "_size"], "left").select(row, F.col("_text").alias("text"), F.coalesce("marks", none).alias("marks"))
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_remove(window), f"row {kind}, n_words long, n_removed long, removed array<struct<start:long,length:long>>, kept_text string")
    return out.select(*(["row.*"] if rest.columns else []), "n_words", "n_removed", "removed", "kept_text")
