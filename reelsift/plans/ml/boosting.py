"""Gradient-boosted regression trees that can go on: many rounds to a Spark job, predictions as a column.

Rows stay in their tasks. A round grows one tree on the residuals, level by level: each task sums its
residuals by node, feature and bin, the tasks of the (barrier) stage add their sums up, and all of them
take the same split. After ``ROUNDS`` rounds the job writes the rows with their running predictions and
hands the new trees to the driver; the next job goes on from there, so no round is ever fitted twice and
a lost executor costs one job.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from reelsift.session import cut_lineage

#: Rounds of a job, and rows of a task.
ROUNDS, ROWS_PER_TASK = 50, 20_000
ROWS = "part int, y double, pred double, draw long, x array<double>, told string"


def bin_edges(df: DataFrame, col: str, width: int, bins: int) -> list[list[float]]:
    """For each position of the array ``col`` at most ``bins`` - 1 ascending cuts between its values
    (quantiles; all values where there are few)."""
    at = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(col)[i], at, 10_000).alias(f"q{i}") for i in range(width)]).first()
    return [sorted(set(found[i] or [])) for i in range(width)]


def stop_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(best round so far, whether ``patience`` rounds without a better one have passed)."""
    best = int(np.argmin(losses))
    return best + 1, len(losses) - 1 - best >= patience


def grow(bins: np.ndarray, residual: np.ndarray, used: np.ndarray, features: np.ndarray, size: int, depth: int, min_rows: int,
         add: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, value, gain, row): a tree as full binary arrays (children of i at 2i + 1 and 2i + 2,
    feature -1 at leaves; rows with a bin up to ``bin`` go left) and the leaf of every row. The split of a
    node is the one that lowers the squared residuals most, of equal ones the first. ``add`` sums an array
    over all tasks."""
    nodes, width = (2 << depth) - 1, bins.shape[1]
    feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
    value, gain, row = np.zeros(nodes), np.zeros(nodes), np.zeros(len(bins), np.int64)
    for level in range(depth):
        first, count = (1 << level) - 1, 1 << level
        here = used & (row >= first)
        key = ((row[here] - first)[:, None] * width + np.arange(width)) * size + bins[here]
        cells = count * width * size
        total = add(np.concatenate([np.bincount(key.ravel(), np.repeat(residual[here], width), cells), np.bincount(key.ravel(), minlength=cells)]))
        g, n = total.reshape(2, count, width, size)
        whole_g, whole_n = g[:, :1].sum(2, keepdims=True), n[:, :1].sum(2, keepdims=True)
        left_g, left_n = np.cumsum(g, 2), np.cumsum(n, 2)
        right_g, right_n = whole_g - left_g, whole_n - left_n
        with np.errstate(divide="ignore", invalid="ignore"):
            better = left_g ** 2 / left_n + right_g ** 2 / right_n - whole_g ** 2 / whole_n
            mean = np.where(whole_n > 0, whole_g / whole_n, 0.0)[:, 0, 0]
        better[(left_n < min_rows) | (right_n < min_rows)] = -np.inf
        better[:, np.setdiff1d(np.arange(width), features)] = -np.inf
        best = better.reshape(count, -1).argmax(1)
        score = better.reshape(count, -1)[np.arange(count), best]
        ids, split = first + np.arange(count), score > 1e-12
        exists = np.ones(count, bool) if level == 0 else feature[(ids - 1) // 2] >= 0
        value[ids] = np.where(exists, mean, value[ids])
        split &= exists
        feature[ids[split]], cut[ids[split]], gain[ids[split]] = best[split] // size, best[split] % size, score[split]
        at, b = np.arange(count)[split], best[split]
        # the deepest leaves get their means from the parents' sums
        for child, sums, rows in ((1, left_g, left_n), (2, right_g, right_n)):
            value[2 * ids[split] + child] = sums[at, b // size, b % size] / rows[at, b // size, b % size]
        go = (row >= first) & (feature[row] >= 0)
        f = feature[row[go]]
        row[go] = 2 * row[go] + 1 + (bins[go, f] > cut[row[go]])
    return feature, cut, value, gain, row


def _summed(tasks: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sum over the tasks of the stage, in their order."""
    if tasks == 1:
        return lambda a: a
    context = BarrierTaskContext.get()

    def add(a: np.ndarray) -> np.ndarray:
        parts = context.allGather(base64.b64encode(np.ascontiguousarray(a, np.float64).tobytes()).decode())
        return np.sum([np.frombuffer(base64.b64decode(p)) for p in parts], axis=0).reshape(a.shape)
    return add


def _job(edges: list[list[float]], losses: list[float], settings: dict, tasks: int):
    """Up to ``ROUNDS`` more rounds on the rows of the stage."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else _SCHEMA.empty_table()
        part, y, pred, draw = (table[c].to_numpy() for c in ("part", "y", "pred", "draw"))
        draw = draw.view(np.uint64)
        x = np.array(table["x"].to_pylist(), np.float64).reshape(len(y), len(edges))
        bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1) if len(y) else np.zeros((0, len(edges)), np.int64)
        size, add, pred = max(len(e) for e in edges) + 1, _summed(tasks), pred.copy()
        known, seen, told = list(losses), part == 0, []
        for k in range(len(known), min(len(known) + settings["rounds"], settings["max_iter"])):
            bag = np.random.default_rng([settings["seed"], k // settings["bag_every"]]).integers(1, 1 << 62, dtype=np.uint64)
            used = seen & (((draw ^ bag) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) < settings["rows"] * (1 << 24))
            pick = max(1, int(np.ceil(settings["features"] * len(edges))))
            some = np.random.default_rng([settings["seed"], k, 1]).permutation(len(edges))[:pick]
            feature, cut, value, gain, row = grow(bins, y - pred, used, some, size, settings["depth"], settings["min_rows"], add)
            pred += settings["step"] * value[row]
            e, s = add(np.stack([np.bincount(part, (y - pred) ** 2, 2), np.bincount(part, minlength=2).astype(float)]))
            train, val = (float(e[i] / s[i]) if s[i] else None for i in (0, 1))
            told.append({"train": train, "val": val, "feature": feature.tolist(), "value": value.tolist(), "gain": gain.tolist(),
                         "cut": [edges[f][c] if f >= 0 and c < len(edges[f]) else 0.0 for f, c in zip(feature, cut)]})
            known.append(train if val is None else val)
            if stop_round(known, settings["patience"])[1]:
                break
        if tasks == 1 or BarrierTaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_pylist([{"part": -1, "told": json.dumps(told)}], schema=_SCHEMA)
        ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(edges))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(y), pa.array(pred), pa.array(draw.view(np.int64)),
                                          pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.nulls(len(y), pa.string())], schema=_SCHEMA)
    return go


_SCHEMA = pa.schema([("part", pa.int32()), ("y", pa.float64()), ("pred", pa.float64()), ("draw", pa.int64()), ("x", pa.list_(pa.float64())), ("told", pa.string())])


class Trees:
    """Fitted trees: ``base`` plus ``step`` times the leaf of every tree. Arrays are trees x nodes."""

    def __init__(self, base: float, step: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, gain: np.ndarray):
        self.base, self.step = base, step
        self.feature, self.cut, self.value, self.gain = feature, cut, value, gain

    def __len__(self) -> int:
        return len(self.feature)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                f = feature[node[inner]]
                node[inner] = 2 * node[inner] + 1 + (x[rows[inner], f] > cut[node[inner]])
            out += self.step * value[node]
        return out

    def importance(self, width: int) -> list[float]:
        """Share of each feature in the squared error that the splits took away."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], self.gain[inner], width)
        return (total / total.sum()).tolist() if total.sum() else total.tolist()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(int(t), int(n), int(self.feature[t, n]), float(self.cut[t, n]), float(self.value[t, n]), float(self.gain[t, n]), self.base, self.step)
                for t, n in zip(*map(np.ravel, np.indices(self.feature.shape)))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, cut double, value double, gain double, base double, step double")

    @staticmethod
    def of_table(df: DataFrame) -> Trees:
        """The trees of a written table: one row per node, some hundred trees of 63 nodes."""
        rows = df.orderBy("tree", "node").toArrow()
        shape = (len(rows["tree"].unique()), -1)
        columns = [rows[c].to_numpy().reshape(shape) for c in ("feature", "cut", "value", "gain")]
        return Trees(rows["base"][0].as_py(), rows["step"][0].as_py(), *columns)


def boost(df: DataFrame, max_iter: int = 1000, patience: int = 50, step: float = 0.05, depth: int = 5, min_rows: int = 20, rows: float = 0.8,
          bag_every: int = 5, features: float = 0.8, bins: int = 255, seed: int = 42) -> tuple[Trees, list[tuple]]:
    """Trees on ``df`` (part: 0 training, 1 validation; y; x: array<double> without nulls; draw: a long by
    which rows are sampled) and (round, training loss, validation loss) of every round run.

    From the mean of the training rows each round takes ``step`` of one tree on a share ``rows`` of them
    (drawn anew every ``bag_every`` rounds) and a share ``features`` of the features. It ends after
    ``patience`` rounds that do not lower the validation loss (the training loss, if there are no
    validation rows), at ``max_iter`` rounds at most; the trees up to the best round stay."""
    spark = df.sparkSession
    width = df.select(F.max(F.size("x"))).first()[0]
    train = df.where("part = 0")
    edges, base = bin_edges(train, "x", width, bins), float(train.agg(F.avg("y")).first()[0])
    table = cut_lineage(df.select(F.col("part").cast("int").alias("part"), F.col("y").cast("double").alias("y"), F.lit(base).alias("pred"), "draw", "x",
                                  F.lit(None).cast("string").alias("told")), "boosting")
    tasks = max(1, min(spark.sparkContext.defaultParallelism, table.count() // ROWS_PER_TASK))
    settings = {"max_iter": max_iter, "patience": patience, "step": step, "depth": depth, "min_rows": min_rows, "rows": rows, "bag_every": bag_every,
                "features": features, "seed": seed, "rounds": ROUNDS}
    losses, told = [], []
    while len(told) < max_iter:
        done = table.where("part >= 0").repartition(tasks).mapInArrow(_job(edges, losses, settings, tasks), ROWS, barrier=tasks > 1)
        table = cut_lineage(done, "boosting")
        told += json.loads(table.where("part = -1").first().told)
        losses = [t["train"] if t["val"] is None else t["val"] for t in told]
        if stop_round(losses, patience)[1]:
            break
    best = stop_round(losses, patience)[0]
    arrays = [np.array([t[c] for t in told[:best]]) for c in ("feature", "cut", "value", "gain")]
    return Trees(base, step, *arrays), [(i + 1, t["train"], t["val"]) for i, t in enumerate(told)]
