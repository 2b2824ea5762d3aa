"""Run registered queries on Spark and their oracle SQL on DuckDB; compare results.

usage: python scripts/oracle_check.py [sf_dir] [name ...]
Compares row count, column names/kinds and an order-insensitive multiset of rows
(columns sorted by name, floats compared to 9 significant digits).
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from reelsift.queries import oracle_sql, queries  # noqa: E402
from reelsift.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return tuple(norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def kind(t: str) -> str:
    t = t.lower()
    if any(x in t for x in ("int", "long", "short", "byte")):
        return "int"
    if any(x in t for x in ("double", "float", "decimal", "real")):
        return "float"
    if "timestamp" in t:
        return "ts"
    if "date" in t:
        return "date"
    if "bool" in t:
        return "bool"
    if "char" in t or "string" in t:
        return "str"
    return t


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in records]


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sq = queries(), oracle_sql()
    names = names or sorted(qs)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
            stypes = {f.name: kind(f.dataType.simpleString()) for f in sdf.schema.fields}
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sq:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(sq[name])
            dcols = rel.columns
            dtypes = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"columns spark={sorted(scols)} duck={sorted(dcols)}")
        else:
            tm = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
            if tm:
                problems.append(f"types {tm}")
            if len(srows) != len(drows):
                problems.append(f"rows spark={len(srows)} duck={len(drows)}")
            a, b = Counter(rows_of(scols, srows)), Counter(rows_of(dcols, drows))
            if a != b:
                da, db = a - b, b - a
                problems.append(f"values differ: {sum(da.values())} spark-only e.g. {list(da)[:2]} / "
                                f"{sum(db.values())} duck-only e.g. {list(db)[:2]}")
        if problems:
            bad += 1
            print(f"FAIL {name}: " + " | ".join(problems))
        else:
            print(f"OK   {name}: {len(srows)} rows {ts:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
