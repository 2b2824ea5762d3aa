"""A keyed table for streaming sinks: upserts by micro-batch, merged in levels, old files freed.

A micro-batch is written as a run. ``FAN_OUT`` runs of a level are merged into one of the next, keeping
the newest row of each key, so ``n`` batches leave about ``FAN_OUT * log(n)`` runs and a row is rewritten
once per level. A manifest names the runs that count and the last batch in them; it is written whole
under its batch's number, so a batch either counts or does not, and one that is replayed changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Runs of a level that are merged into one of the next.
FAN_OUT = 6


class KeyedTable:
    """The newest row of every key below ``path``. ``live``: a condition on the rows and on what was noted
    with the last batch; rows that fail it are dropped when runs merge, and are not read."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], live: Callable[[dict], object] | None = None):
        self.spark, self.path, self.keys, self.live = spark, path.rstrip("/"), keys, live
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> dict:
        """batch (-1 before the first), runs (level, name) from old to new, and notes."""
        done = [n for n in self._names("manifests") if n.endswith(".json")]
        if not done:
            return {"batch": -1, "runs": [], "notes": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{done[-1]}", wholetext=True).first()[0])

    def _commit(self, state: dict) -> None:
        name = f"{state['batch']:020d}.json"
        made = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._fs.rename(made, self._at(f"{self.path}/manifests/{name}"))  # in one step

    def _merged(self, runs: list[list], notes: dict) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/runs/{name}").withColumn("_run", F.lit(i)) for i, (_, name) in enumerate(runs)]
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        own = [c for c in rows.columns if c != "_run"]
        rest = [c for c in own if c not in self.keys]
        if len(runs) > 1:  # combined before the shuffle
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), "_run").alias("_row"))
            rows = rows.select(*[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in own])
        rows = rows.select(*own)
        return rows.where(self.live(notes)) if self.live else rows

    def now(self) -> DataFrame | None:
        """All rows, or None before the first batch."""
        state = self.manifest()
        return self._merged(state["runs"], state["notes"]) if state["runs"] else None

    def upsert(self, rows: DataFrame, batch: int, notes: dict | None = None) -> bool:
        """The ``rows`` (one per key) replace those of their keys; False if ``batch`` counts already."""
        state = self.manifest()
        if state["batch"] >= batch:
            return False
        notes = state["notes"] if notes is None else notes
        runs = [*state["runs"], [0, self._write(rows, f"{batch:020d}-0")]]
        while len(runs) >= FAN_OUT and len({level for level, _ in runs[-FAN_OUT:]}) == 1:
            level = runs[-1][0] + 1
            runs[-FAN_OUT:] = [[level, self._write(self._merged(runs[-FAN_OUT:], notes), f"{batch:020d}-{level}")]]
        self._commit({"batch": batch, "runs": runs, "notes": notes})
        self._free({name for _, name in [*runs, *state["runs"]]})
        return True

    def _write(self, rows: DataFrame, name: str) -> str:
        name = f"{name}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/runs/{name}")
        return name

    def _free(self, kept: set[str]) -> None:
        """Delete the runs that neither this manifest nor the one before names, and older manifests."""
        for name in self._names("runs"):
            if name not in kept:
                self._fs.delete(self._at(f"{self.path}/runs/{name}"), True)
        for name in self._names("manifests")[:-2]:
            self._fs.delete(self._at(f"{self.path}/manifests/{name}"), True)


def fresh(rows: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """The ``rows`` whose keys (nulls equal) are not ``known``."""
    if known is None:
        return rows
    a, b = rows.alias("a"), known.alias("b")
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_anti")
