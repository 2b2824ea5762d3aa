"""Secret scans in DataFrame functions: three patterns, and character Markov models for the rest.

Two Markov chains over characters, one of random strings and one of ordinary identifiers, are
trained on all documents: strings that the patterns call secrets, and the other words. A run of key
characters whose mean log-likelihood ratio (random against identifier) passes a limit is a secret
too. The limit lies above nearly all ordinary runs.

Positions are code points. The matches of a pattern and the gaps between them add up to the text,
so their lengths give the places; they are summed block by block to stay linear in a long text.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import cut_lineage, free, without
from reelsift.operators.quantiles import kth

# The base patterns, their kinds in order, and the shortest match that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"  # 18 characters or more: a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 12

RUN = r"[A-Za-z0-9+/_=-]{16,}+"      # what the models judge
WORD = r"[A-Za-z0-9+/_=-]{8,}+"      # what they learn from
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1            # 0 is the start of a run
QUANTILE = 0.999                     # of ordinary runs lies under the limit
BLOCK = 256

ADDED = ("spans", "n_assign", "n_access", "n_hex", "n_markov")
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _places(text: Column, pattern: str, matches: Column, rank: int) -> Column:
    """(start, rank, end) of each of the ``matches`` of ``pattern`` in ``text``."""
    gaps = F.split(text, pattern, -1)

    def block(acc, b):
        first = b * BLOCK
        last = F.least(F.size(matches), first + BLOCK) - 1
        inner = F.aggregate(F.sequence(first, last), F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    def one(acc, i):
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(matches, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    found = F.flatten(F.aggregate(blocks, empty, block)["out"])
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(SPAN))


def base_matches(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_t`` (the text, null as empty) and the matches of each pattern."""
    return docs.withColumn("_t", F.coalesce(text, F.lit(""))).withColumns({
        "_assign": F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(0)),
        "_access": F.regexp_extract_all("_t", F.lit(ACCESS), F.lit(0)),
        "_hex": F.regexp_extract_all("_t", F.lit(HEX), F.lit(0))})


def _values() -> Column:
    """The second group of each assign match."""
    return F.when(F.size("_assign") > 0, F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))


def _chars(run: Column) -> Column:
    return F.filter(F.split(run, ""), lambda c: c != "")


def _index(c: Column) -> Column:
    """1 to the alphabet's size."""
    return F.call_function("locate", c, F.lit(ALPHABET))


def ratio(run: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a run's transitions."""
    step = lambda a, c: F.struct(_index(c).alias("was"), (a["sum"] + F.get(table, a["was"] * WIDTH + _index(c))).alias("sum"))
    start = F.struct(F.lit(0).alias("was"), F.lit(0.0).alias("sum"))
    return F.aggregate(_chars(run), start, step)["sum"] / F.length(run)


class Models:
    """``table``: log-likelihood ratio by (previous, next) character; ``limit``: least mean ratio."""

    def __init__(self, table: np.ndarray, limit: float):
        self.table, self.limit = table, limit

    def column(self) -> Column:
        """An array literal of WIDTH * WIDTH doubles (folded once by the optimizer)."""
        return F.split(F.lit(",".join(f"{x:.6g}" for x in self.table)), ",").cast("array<double>")


def train(docs: DataFrame, id_col: str, text_col: str) -> Models:
    """Both chains from all documents. Random strings also get half their weight from the uniform
    chain, so that other alphabets than those read are found; without any text both chains are
    uniform and nothing is added. Words are counted once (combined before the shuffle, then written);
    moves and limit come from the distinct ones."""
    rows = base_matches(docs.select(F.col(f"`{text_col}`").alias("text")), F.col("text"))
    rows = rows.withColumn("_secrets", F.concat("_access", "_hex", F.filter(_values(), lambda v: F.length(v) >= MIN_VALUE)))
    kept = rows.select(F.explode(F.concat(
        F.transform("_secrets", lambda v: F.struct(F.lit(True).alias("random"), v.alias("run"))),
        F.transform(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), lambda v: F.struct(
            F.exists("_secrets", lambda s: (F.instr(v, s) > 0) | (F.instr(s, v) > 0)).alias("random"), v.alias("run"))))).alias("w")).select("w.*")
    counted = cut_lineage(kept.groupBy("random", "run").count(), "secret-words")
    labelled = counted.filter(~F.col("random") | F.col("run").rlike(f"^{WORD}$"))
    moves = (labelled.withColumn("c", F.transform(_chars(F.col("run")), _index))
             .select("random", "count", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("c", F.lit(1), F.size("c") - 1)).alias("a"), F.col("c").alias("b"))).alias("m"))
             .filter("m.a is not null and m.b > 0")
             .groupBy("random", (F.col("m.a") * WIDTH + F.col("m.b")).alias("at")).agg(F.sum("count").alias("n")).collect())  # 2 * WIDTH ** 2 rows at most
    counts = {x: np.zeros((WIDTH, WIDTH)) for x in (True, False)}
    for r in moves:
        counts[r.random].flat[r["at"]] = r.n
    def chain(c: np.ndarray, smooth: float) -> np.ndarray:
        return (c + smooth) / (c.sum(1, keepdims=True) + smooth * WIDTH)
    random = (chain(counts[True], 1.0) + 1.0 / WIDTH) / 2
    table = np.log(random / chain(counts[False], 0.5)).ravel()
    models = Models(table, 0.0)
    plain = counted.filter(~F.col("random") & (F.length("run") >= 16)).select(ratio(F.col("run"), models.column()).alias("x"))
    plain = cut_lineage(plain, "secret-ratios")
    n = plain.count()
    top = kth(plain, max(0, math.ceil(QUANTILE * n) - 1), n) if n else 0.0
    models.limit = max(0.3, top + 0.1)
    free(counted, plain)
    return models


def scan(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``spans`` (start, rank in KINDS, end; by start, then kind) and a count of each
    kind. A null text is empty and has no spans. These replace columns of the same names. A run
    that overlaps a base span adds nothing."""
    docs = without(docs, [*ADDED, "_t", "_assign", "_access", "_hex", "_runs", "_base", "_more"])
    rows = base_matches(docs, F.col(f"`{text_col}`")).withColumn("_runs", F.regexp_extract_all("_t", F.lit(RUN), F.lit(0)))
    t = F.col("_t")
    values = _values()
    assign = F.filter(_places(t, ASSIGN, F.col("_assign"), 0), lambda s, i: F.length(F.get(values, i)) >= MIN_VALUE)
    rows = rows.withColumn("_base", F.array_sort(F.concat(assign, _places(t, ACCESS, F.col("_access"), 1), _places(t, HEX, F.col("_hex"), 2))))
    rows = rows.withColumn("_base", F.when(F.size("_assign") + F.size("_access") + F.size("_hex") > 0, F.col("_base"))
                           .otherwise(F.array().cast(SPAN)))
    table, limit = models.column(), F.lit(models.limit)
    judged = F.filter(_places(t, RUN, F.col("_runs"), 3), lambda s, i: ratio(F.get(F.col("_runs"), i), table) >= limit)
    more = F.filter(judged, lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("_more", F.when(F.exists("_runs", lambda r: ratio(r, table) >= limit), more).otherwise(F.array().cast(SPAN)))
    count = lambda rank: F.size(F.filter("_base", lambda s: s["rank"] == rank)).cast("long")
    out = rows.withColumns({"spans": F.array_sort(F.concat("_base", "_more")), "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                            "n_markov": F.size("_more").cast("long")})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
