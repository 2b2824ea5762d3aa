"""Phrase collocations, counted on a prefix-free parse of the corpus.

1. Every text is lower-cased (A-Z), its punctuation made a token of its own, and cut where the text
   itself says so: a trigger is a sequence of ``OVERLAP`` tokens whose hash is 0 modulo ``EVERY``.
   Chunks reach from one trigger to the end of the next, so neighbours overlap by ``OVERLAP`` tokens
   and equal passages fall into equal chunks. The different chunks of a language with their numbers of
   occurrences are the dictionary and the parse frequencies.
2. N-grams are counted inside the different chunks only, each weighted by its chunk's frequency. An
   n-gram belongs to the chunk in which it starts before the closing trigger (the last chunk of a text
   owns its end too), so those in overlaps count once; one of at most ``OVERLAP`` + 1 words that starts
   there also ends there.
3. A phrase reaches the least count only if all its parts do. Words are counted first, then hashes of
   pairs of frequent words (sorted, in blocks, merged in numpy), and then, exactly and by their words,
   the phrases all of whose pairs are frequent. The filters between the steps are bitmaps of bounded
   size: bits that are set without need cost time, and never a count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsift.llm.common import cut_lineage
from reelsift.llm.filters import broadcast_filter, frequent_hashes
from reelsift.llm.filters import frequent_phrases as counted
from reelsift.llm.tokens import Words, grams, mixed, slices, spread, text_keys

#: Longest phrase, tokens that neighbouring chunks share, and how many tokens there are to a trigger.
LONGEST = 5
OVERLAP, EVERY = LONGEST - 1, 48
#: Bytes of chunks for each phrase that a task passes on, about.
WORD_BYTES = 24
#: Ends a piece; no word holds it.
END = "."
PUNCTUATION = r"[.,;:!?\n\x0B\x0C\r]"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of every text: (lang, tail, content, pieces of the same in this batch)."""
    for batch in slices(batches, "text"):
        low = pc.ascii_lower(pc.fill_null(batch["text"], ""))
        w = Words(pc.replace_substring_regex(low, PUNCTUATION, f" {END} "))
        size = np.diff(w.first)
        text = np.flatnonzero(size)
        if not len(text):
            continue
        hashes = grams(w.keys()[w.codes], OVERLAP)
        # chunks start with a text or with a trigger that is wholly inside it
        place = spread(w.first[text] + 1, np.maximum(0, size[text] - OVERLAP))
        trigger = place[hashes[place] % np.uint64(EVERY) == 0] if len(place) else place
        starts = np.sort(np.concatenate([w.first[text], trigger]))
        row = np.searchsorted(w.first, starts, "right") - 1
        tail = np.append(row[1:] != row[:-1], True)
        end = np.where(tail, w.first[row + 1], np.append(starts[1:], 0) + OVERLAP)
        content = w.joined(starts, end - starts)
        lang = pc.fill_null(batch["lang"], "und").take(pa.array(row))
        groups = pa.table([lang, pa.array(tail), content], ["lang", "tail", "content"]).group_by(["lang", "tail", "content"]).aggregate([([], "count_all")])
        yield from groups.rename_columns(["lang", "tail", "content", "times"]).combine_chunks().to_batches()


class _Chunks:
    """The tokens of a batch of chunks, the pairs that each owns, and their weights."""

    def __init__(self, batch: pa.RecordBatch):
        self.w = w = Words(batch["content"])
        self.size = np.diff(w.first)
        self.row = np.repeat(np.arange(batch.num_rows), self.size)
        owned = self.size - np.where(batch["tail"].to_numpy(zero_copy_only=False), 0, OVERLAP)
        self.owned = np.arange(len(w.codes)) < (w.first[:-1] + owned)[self.row]
        self.times = batch["times"].to_numpy(zero_copy_only=False)[self.row]
        self.lang = batch["lang"]
        self.word = pc.not_equal(w.values, END).to_numpy(zero_copy_only=False)[w.codes]
        coded = batch["lang"].dictionary_encode()
        self.langs = coded.dictionary
        self.lang_of = coded.indices.to_numpy(zero_copy_only=False)[self.row]
        salt = np.array([zlib.crc32(x.encode()) for x in self.langs.to_pylist()], np.uint64)
        self.hash = mixed(w.keys()[w.codes] + mixed(salt + np.uint64(1))[self.lang_of])
        self.inner = np.append(self.row[1:] == self.row[:-1], False)[:len(self.row)]

    def pairs(self) -> np.ndarray:
        """Hash of the pair that starts at each token (of no use where none does)."""
        return mixed(self.hash * np.uint64(0x9E3779B97F4A7C15) + np.roll(self.hash, -1))


def _word_counts(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    for part in slices([batch], "content"):
        c = _Chunks(part)
        use = c.owned & c.word
        n = np.bincount(c.lang_of[use].astype(np.int64) * len(c.w.values) + c.w.codes[use], c.times[use], len(c.langs) * len(c.w.values)).astype(np.int64)
        found = np.flatnonzero(n)
        yield pa.table([c.langs.take(pa.array(found // len(c.w.values))), c.w.values.take(pa.array(found % len(c.w.values))), pa.array(n[found])],
                       ["lang", "phrase", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes by which a filter knows the words of (lang, phrase)."""
    for batch in batches:
        salt = np.array([zlib.crc32(x.encode()) for x in batch["lang"].to_pylist()], np.uint64)
        h = mixed(text_keys(batch["phrase"]) + mixed(salt + np.uint64(1)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


def _pair_hashes(words):
    """Pairs of frequent words by hash, and their weights."""
    def of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in slices([batch], "content"):
            c = _Chunks(part)
            good = c.word & words.value.has(c.hash)
            use = c.owned & c.inner & good & np.roll(good, -1)
            yield c.pairs()[use], c.times[use]
    return of


def _phrases(pairs, longest: int):
    """Phrases of 2 to ``longest`` words all of whose pairs pass, by their words."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for part in slices([batch], "content"):
            c = _Chunks(part)
            good = c.inner & c.word & np.roll(c.word, -1)
            good[good] = pairs.value.has(c.pairs()[good])
            all_good = good
            for n in range(2, longest + 1):
                at = np.flatnonzero(all_good & c.owned)
                if len(at):
                    table = pa.table([c.langs.take(pa.array(c.lang_of[at])), c.w.joined(at, np.full(len(at), n)), pa.array(c.times[at])], ["lang", "phrase", "n"])
                    yield table.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])
                all_good = all_good & np.append(good[n - 1:], np.zeros(min(n - 1, len(good)), bool))
    return of


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, words) with all words of each language, and (lang, phrase, n): every word and every phrase
    of up to ``longest`` words with at least ``least`` occurrences, overlapping ones included."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"longest must be 2 to {LONGEST}")
    source = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chunks = source.mapInArrow(_parse, "lang string, tail boolean, content string, times long")
    chunks = cut_lineage(chunks.groupBy("lang", "tail", "content").agg(F.sum("times").alias("times")), "chunks")
    size = chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    counts = counted(chunks, _word_counts, least, size // WORD_BYTES, "frequent-words")
    totals = counts.filter("phrase IS NULL").groupBy("lang").agg(F.sum("words").alias("words"))
    words = counts.filter("phrase IS NOT NULL")
    known = broadcast_filter(words.mapInArrow(_hashed, "h long"), words.count())
    tokens = totals.agg(F.sum("words")).first()[0] or 0
    often = frequent_hashes(chunks, _pair_hashes(known), least, tokens)
    pairs = broadcast_filter(often, often.count())
    phrases = counted(chunks, _phrases(pairs, longest), least, size // WORD_BYTES, "frequent-phrases").filter("phrase IS NOT NULL").select("lang", "phrase", "n")
    return totals, words.select("lang", "phrase", "n").unionByName(phrases)


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int | None = 2000, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the ``top`` phrases of 2 to ``longest``
    words (all with None) by score, then count, then phrase.

    Words are runs of anything but space and tab, A-Z lower-cased, in pieces that end at ``.,;:!?`` and
    10 to 13. n: the language's words, a: the phrase's occurrences (at least ``least``). Cut after its
    first k words it has l and r, the counts of both parts, and the score floor(1000 * a * n / (l * r));
    the lowest-scoring cut counts, of equal ones that with the smallest k. Products are decimals of 38
    digits. A phrase goes if a longer one of at least ``least`` occurrences holds its words in a row and
    occurs as often. A null language is ``und``; null and empty texts have no words; rows that repeat
    count again; an empty table gives none. Other columns are not read."""
    totals, frequent = frequent_phrases(df, text, lang, least, longest)
    frequent = frequent.withColumn("w", F.split("phrase", " "))
    long = frequent.filter(F.size("w") > 1).withColumnRenamed("n", "a")
    size = F.size("w")
    cuts = long.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, size - F.col("k")), " ").alias("rest"))
    part = frequent.select("lang", "phrase", "n")
    cuts = (cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
            .join(totals.withColumnRenamed("words", "n"), "lang"))
    whole = {c: F.col(c).cast("decimal(18,0)") for c in "alrn"}
    upper = (F.lit(1000).cast("decimal(4,0)") * whole["a"]).cast("decimal(20,0)") * whole["n"]
    score = F.expr("upper div lower")
    cuts = cuts.withColumn("upper", upper).withColumn("lower", whole["l"] * whole["r"]).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    inside = long.filter(size > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = left.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
