"""Summarise the physical plans of the headline queries (docs/PLANS.md).

usage: python scripts/plan_report.py [sf_dir]
Counts exchanges and join strategies, and lists scan read schemas / pushed filters, from
``explain("formatted")`` of each query (plans only; nothing but the small eager
checkpoints the operators take is executed)."""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from reelsift.queries import queries  # noqa: E402
from reelsift.session import get_session  # noqa: E402


def summarise(plan: str) -> dict:
    count = lambda pat: len(re.findall(pat, plan))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]+)\]", plan)})
    return {
        "shuffles": count(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\(\d+\) Exchange\n"),
        "broadcasts": count(r"\(\d+\) BroadcastExchange"),
        "bhj": count(r"\(\d+\) BroadcastHashJoin"),
        "smj": count(r"\(\d+\) SortMergeJoin"),
        "partial_limits": count(r"\(\d+\) WindowGroupLimit"),
        "windows": count(r"\(\d+\) Window\b"),
        "cartesian": count(r"CartesianProduct|BroadcastNestedLoopJoin"),
        "python": count(r"ArrowEvalPython|BatchEvalPython"),
        "scans": [len(s.split(",")) for s in scans],
        "pushed": pushed,
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    lines = ["# Physical plan summary of the headline queries", "",
             f"Generated by `scripts/plan_report.py` on `{sf}` (initial AQE plans; AQE may still turn a",
             "shuffle join into a broadcast join from runtime sizes). *shuffles* counts Exchange nodes,",
             "*partial limits* the map-side WindowGroupLimit before a per-key top-n shuffle, *scan columns*",
             "the number of columns each parquet scan reads.", "",
             "| query | shuffles | broadcast joins | sort-merge joins | partial limits | windows | cross joins | python | scan columns | pushed filters |",
             "|---|---|---|---|---|---|---|---|---|---|"]
    for name in [n for n in HEADLINE if n != "stream_user_stats"]:
        buf = io.StringIO()
        with redirect_stdout(buf):
            qs[name](spark, sf).explain("formatted")
        s = summarise(buf.getvalue())
        lines.append(f"| `{name}` | {s['shuffles']} | {s['bhj']} | {s['smj']} | {s['partial_limits']} | {s['windows']} | "
                     f"{s['cartesian']} | {s['python']} | {s['scans']} | {'; '.join(s['pushed'])[:120]} |")
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    open(out, "w").write("\n".join(lines) + "\n")
    print("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
