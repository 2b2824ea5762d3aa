"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (their set of sources). Patterns and sources that hang
together form components, and each component is a flow network of its own: an arc per repetition
carries a pattern's words to the quotas of its sources at a cost that grows with the repetition
(convex), so no document is repeated before all that could serve the same source have been taken once.
A source that shares no document is a component of one. Each pattern then takes whole passes over its
documents and, for the rest, documents in the order of a seeded hash.

Patterns, sources, targets and components stay in Spark; a task solves many small components, or one
large one (its patterns and sources, never its documents). The hash threshold of a pattern is found by
splitting the hash range around it into parts, part sums in Spark, until the part that holds it is
small; the documents of that part are then tried one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.llm.common import connected_components, cut_lineage, trimmed, without
from reelsift.operators.ranking import global_rank

RANGE = 1 << 60     # of the seeded hash
PART_ROWS = 500     # documents of a part, about
PARTS = 1024        # parts of a range at most
TASK_SOURCES = 2000  # sources whose components one task solves, about
COPIES = 1024       # equal rows that one task numbers


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5,
            cap: float = 2.0) -> dict[str | None, float]:
    """Words due to each source: ``ratio`` times all words, shared by the weights (repeating over
    the sources by code point, null last); none above ``cap`` times its size, and what that leaves
    is shared among the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, due, still = ratio * sum(sizes.values()), {}, order
    while still:
        share = left / sum(weight[s] for s in still)
        over = [s for s in still if weight[s] * share > cap * sizes[s]]
        for s in over or still:
            due[s] = float(cap * sizes[s] if over else weight[s] * share)
        left -= sum(due[s] for s in over)
        still = [s for s in still if s not in due]
    return due


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (tail, head, capacity, cost) arc of the largest flow with the least cost, by
    successive shortest paths."""
    head, left, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(head)); head.append(b); left.append(c); cost.append(w)  # noqa: E702
        out[b].append(len(head)); head.append(a); left.append(0); cost.append(-w)  # noqa: E702
    while True:
        dist: list[float] = [float("inf")] * n
        via, queue, queued = [-1] * n, deque([source]), [False] * n
        dist[source] = 0
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in out[a]:
                if left[e] and dist[a] + cost[e] < dist[head[e]]:
                    dist[head[e]], via[head[e]] = dist[a] + cost[e], e
                    if not queued[head[e]]:
                        queue.append(head[e])
                        queued[head[e]] = True
        if via[sink] < 0:
            return left[1::2]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = head[via[at] ^ 1]
        step = min(left[e] for e in path)
        for e in path:
            left[e] -= step
            left[e ^ 1] += step


def route(patterns: list[tuple[list[str | None], int]], due: dict[str | None, float], repeats: int) -> list[int]:
    """Words that each (sources, size) pattern gives, repetitions counted."""
    names = list(due)
    place = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    arcs = [(0, 1 + i, size, r) for i, (_, size) in enumerate(patterns) for r in range(repeats)]
    first = len(arcs)
    arcs += [(1 + i, place[s], repeats * size, 0) for i, (own, size) in enumerate(patterns) for s in own]
    arcs += [(place[s], sink, round(due[s]), 0) for s in names]
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    given = [0] * len(patterns)
    for (_, b, _, _), f in zip(arcs[:first], flow[:first], strict=True):
        given[b - 1] += f
    return given


def fill(sizes: list[int], rest: int) -> list[int]:
    """Places of the ``sizes`` to take for a sum near ``rest``: in their order each that still fits,
    then, while it comes nearer, one more or one for another."""
    took = [False] * len(sizes)
    for i, s in enumerate(sizes):
        if s <= rest:
            took[i], rest = True, rest - s
    for _ in range(4):
        out = sorted((s, i) for i, s in enumerate(sizes) if not took[i])
        ins = [(0, None), *((s, i) for i, s in enumerate(sizes) if took[i])]
        best = (abs(rest), None, None)
        for s, i in ins:  # what is left out whose size comes nearest to rest + s
            at = bisect_left(out, (rest + s, -1))
            for size, j in out[max(0, at - 1):at + 1]:
                best = min(best, (abs(rest + s - size), i, j), key=lambda x: x[0])
        if best[2] is None:
            break
        if best[1] is not None:
            took[best[1]], rest = False, rest + sizes[best[1]]
        took[best[2]], rest = True, rest - sizes[best[2]]
    return [i for i, x in enumerate(took) if x]


@dataclass
class Mix:
    """sources: (source, source_size, target). state: (pattern, base, below, until): documents take
    ``base`` copies, and one more if their draw is under ``below``, or in ``picked`` where it is under
    ``until``. All written tables."""

    sources: DataFrame
    state: DataFrame
    picked: DataFrame


def pattern(sources: Column, is_array: bool) -> Column:
    """A text that stands for the set of sources; null is a source of its own."""
    own = F.coalesce(sources, F.array(F.lit(None).cast("string"))) if is_array else F.array(sources.cast("string"))
    return F.to_json(F.sort_array(F.array_distinct(own)), {"ignoreNullFields": "false"})


def row_keys(columns: list[str]) -> dict[str, Column]:
    """Two hashes of a row's columns: rows that agree in both are taken as equal."""
    own = [F.col(f"`{c}`") for c in columns]
    return {"_a": F.xxhash64(*own), "_b": F.xxhash64(F.lit(1), *own)}


def draw(seed: int) -> Column:
    """The seeded hash of a row, or of one of the equal rows."""
    return F.pmod(F.xxhash64("_a", "_b", "_copy", F.lit(seed)), F.lit(RANGE))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """(doc_id, source, size, pattern, _a, _b, _n, _copy, draw) of every row, as a written table. Rows
    equal in all columns are numbered (``_copy`` of ``_n``), so each has a draw of its own."""
    is_array = docs.schema[source_col].dataType.typeName() == "array"
    src = F.col(f"`{source_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), src.alias("source"), pattern(src, is_array).alias("pattern"),
                       *[c.alias(n) for n, c in row_keys(docs.columns).items()], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = rows.drop("text").schema.add("size", "long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column(5).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n, pa.int64())], names=[*b.schema.names[:5], "size"])

    equal = rows.mapInArrow(trimmed(measure), schema).groupBy("doc_id", "source", "pattern", "_a", "_b", "size").agg(F.count("*").alias("_n"))
    blocks = equal.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")))
    each = blocks.withColumn("_copy", F.explode(F.expr(f"sequence(_block * {COPIES}, least(_n, (_block + 1) * {COPIES}) - 1)"))).drop("_block")
    return cut_lineage(each.withColumn("draw", draw(seed)), "sized")


def source_targets(patterns: DataFrame, weights: tuple[float, ...], ratio: float, cap: float) -> DataFrame:
    """(s, source, source_size, target, own) written, as :func:`targets` has them: s numbers the sources by
    code point, null last. The share of a weight is raised until no source is above its cap."""
    listed = patterns.select(F.explode(F.from_json("pattern", "array<string>")).alias("source"), "size")
    each = listed.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(each, [F.col("source").isNull(), F.col("source")], out="s")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", weight), "sources")
    most = F.lit(cap) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(share) > most
        r = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("rest")).first()
        if r.n == full or r.rest is None:
            break
        full, share = r.n, (ratio * total - (r.taken or 0)) / r.rest
    due = F.when(F.col("weight") * F.lit(share) > most, most).otherwise(F.col("weight") * F.lit(share)).cast("double")
    return ranked.select("s", "source", "source_size", due.alias("target"))


def routed(patterns: DataFrame, sources: DataFrame, cap: int, flow: Callable) -> DataFrame:
    """(pattern, size, docs, given) written: the words that the flow takes of each pattern."""
    # sources by their numbers; patterns of several sources tie them together
    each = patterns.select("pattern", F.explode(F.from_json("pattern", "array<string>")).alias("source"))
    own = each.alias("e").join(sources.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source"))).select("pattern", F.col("s.s").alias("s"))
    own = cut_lineage(own, "pattern-sources")
    first = own.groupBy("pattern").agg(F.min("s").alias("first"))
    roots = connected_components(own.join(first, "pattern").select(F.col("first").alias("a"), F.col("s").alias("b")).filter("a <> b"))
    root = F.coalesce("c", "s").alias("component")
    dues = sources.join(roots.withColumnRenamed("v", "s"), "s", "left").select(root, "s", "target")
    nets = own.groupBy("pattern").agg(F.collect_list("s").alias("own"), F.min("s").alias("s")).join(patterns.drop("docs"), "pattern")  # a pattern's sources
    nets = nets.join(roots.withColumnRenamed("v", "s"), "s", "left").select(root, "pattern", "own", "size")
    none = F.lit(None)
    rows = nets.select("component", "pattern", "own", "size", none.cast("long").alias("s"), none.cast("double").alias("target")).unionByName(
        dues.select("component", none.cast("string").alias("pattern"), none.cast("array<bigint>").alias("own"), none.cast("long").alias("size"), "s", "target"))
    tasks = max(1, -(-sources.count() // TASK_SOURCES))

    def solve(table: pa.Table) -> pa.Table:
        nets: dict[int, tuple[list, dict]] = {}
        for r in table.to_pylist():
            found = nets.setdefault(r["component"], ([], {}))
            if r["pattern"] is None:
                found[1][r["s"]] = r["target"]
            else:
                found[0].append((r["pattern"], r["own"], r["size"]))
        out = []
        for _, (inner, due) in sorted(nets.items()):
            inner.sort()
            out += zip([p for p, *_ in inner], flow([(o, n) for _, o, n in inner], {s: due[s] for s in sorted(due)}, cap))
        return pa.table({"pattern": pa.array([p for p, _ in out], pa.string()), "given": pa.array([g for _, g in out], pa.int64())})

    given = rows.withColumn("_task", F.pmod(F.xxhash64("component"), F.lit(tasks))).groupBy("_task").applyInArrow(solve, "pattern string, given long")
    return cut_lineage(patterns.join(given, "pattern"), "given")


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, cap: int = 2, flow: Callable = route) -> Mix:
    """Targets, flow and thresholds for the table of :func:`sized`."""
    patterns = cut_lineage(rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("docs")), "patterns")
    sources = cut_lineage(source_targets(patterns, weights, ratio, cap), "targets")
    given = routed(patterns, sources, cap, flow)

    # hash thresholds: lo and width of the range in question, words still to take, documents in it
    base = F.when(F.col("size") > 0, F.expr("given div size")).otherwise(F.lit(0)).cast("long")
    state = given.select("pattern", base.alias("base"), F.lit(0).cast("long").alias("lo"), "docs", (F.col("given") - base * F.col("size")).alias("rest"))
    state = cut_lineage(state.withColumn("width", F.when(F.col("rest") > 0, F.lit(RANGE)).otherwise(F.lit(0)).cast("long")), "state")
    while True:
        wide = F.expr(f"docs > {2 * PART_ROWS} and width > 1")
        todo = state.filter(wide)
        if not todo.limit(1).count():
            break
        step = F.greatest(F.lit(1).cast("long"), F.expr(f"(width + greatest(2L, least({PARTS}L, docs div {PART_ROWS})) - 1) div greatest(2L, least({PARTS}L, docs div {PART_ROWS}))"))
        ranges = todo.select("pattern", "lo", (F.col("lo") + F.col("width")).alias("hi"), step.alias("step"), "rest")
        inside = rows.select("pattern", "draw", "size").join(ranges, "pattern").filter("draw >= lo and draw < hi")
        parts = inside.groupBy("pattern", "lo", "step", "rest", F.expr("(draw - lo) div step").alias("part")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n"))
        so_far = F.sum("size").over(Window.partitionBy("pattern").orderBy("part"))  # at most PARTS rows
        hit = (parts.withColumn("upto", so_far).filter("upto > rest").groupBy("pattern")
               .agg(F.min(F.struct("part", "lo", "step", "rest", F.expr("upto - size").alias("before"), "n")).alias("h")))
        moved = todo.select("pattern", "base").join(hit, "pattern").select(
            "pattern", "base", (F.col("h.lo") + F.col("h.part") * F.col("h.step")).alias("lo"), F.col("h.n").alias("docs"),
            (F.col("h.rest") - F.col("h.before")).alias("rest"), F.col("h.step").alias("width"))
        state = cut_lineage(state.filter(~wide).unionByName(moved), "state")

    state = state.select("pattern", "base", F.col("lo").alias("below"), (F.col("lo") + F.col("width")).alias("until"), "rest")
    last = rows.join(state, "pattern").filter("draw >= below and draw < until").groupBy("pattern", "draw", "rest").agg(F.sum("size").alias("size"))
    tasks = max(1, given.count() // 20)  # a pattern has two parts' documents at most

    def pick(table: pa.Table) -> pa.Table:
        out: list[tuple[str, int]] = []
        found: dict[str, list[tuple[int, int, int]]] = {}
        for r in table.to_pylist():
            found.setdefault(r["pattern"], []).append((r["draw"], r["size"], r["rest"]))
        for p, items in found.items():
            items.sort()
            out += [(p, items[i][0]) for i in fill([n for _, n, _ in items], items[0][2])]
        return pa.table({"pattern": pa.array([p for p, _ in out], pa.string()), "draw": pa.array([d for _, d in out], pa.int64())})

    picked = last.withColumn("_task", F.pmod(F.xxhash64("pattern"), F.lit(tasks))).groupBy("_task").applyInArrow(pick, "pattern string, draw long")
    return Mix(sources.select("source", "source_size", "target"), cut_lineage(state.drop("rest"), "state"), cut_lineage(picked, "picked"))


def copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (with ``pattern`` and ``draw``) plus ``copies``, how often the mix takes each."""
    known = rows.join(mix.state, "pattern", "left")
    n = F.col("base") + (F.col("draw") < F.col("below")).cast("long")
    outside = known.filter("not (draw >= below and draw < until)").withColumn("copies", n)
    inside = known.filter("draw >= below and draw < until").join(mix.picked.withColumn("_in", F.lit(1)), ["pattern", "draw"], "left") \
        .withColumn("copies", F.col("base") + F.coalesce("_in", F.lit(0)))
    keep = [*rows.columns, "copies"]
    return outside.select(*keep).unionByName(inside.select(*keep))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, **how) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it, with its columns.
    Rows without words are never taken; rows equal in all columns are drawn one by one (their copies
    come from one of them); an empty table stays empty. Columns named like those in use are dropped."""
    bare = without(docs, ["pattern", "draw", "copies", "base", "below", "until", "_in", "_a", "_b", "_n", "_copy", "_block", "rest"])
    rows = sized(bare, id_col, text_col, source_col, seed)
    mix = plan_mix(rows, **how)
    is_array = bare.schema[source_col].dataType.typeName() == "array"
    has_words = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = bare.filter(has_words).withColumns(row_keys(bare.columns))
    single = keyed.withColumns({"pattern": pattern(F.col(f"`{source_col}`"), is_array), "_copy": F.lit(0).cast("long")}).withColumn("draw", draw(seed))
    columns = [F.col(f"`{c}`") for c in bare.columns]
    again = cut_lineage(rows.filter("_n > 1"), "equal-rows")
    if again.limit(1).count():
        summed = cut_lineage(copies(again, mix).groupBy("_a", "_b").agg(F.sum("copies").alias("copies")), "equal-copies")
        several = keyed.join(summed, ["_a", "_b"]).dropDuplicates(["_a", "_b"]).select(*columns, "copies")
        one = single.join(summed.drop("copies"), ["_a", "_b"], "left_anti")
        taken = copies(one, mix).select(*columns, "copies").unionByName(several)
    else:
        taken = copies(single, mix).select(*columns, "copies")
    taken = taken.filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)
