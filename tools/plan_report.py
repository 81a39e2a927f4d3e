"""Summarise the physical plans of the headline queries (after execution, so
adaptive decisions are final): exchanges, join strategies, windows, Python
stages and the columns each scan reads. Writes PLANS.md.

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from gradewell.plans.registry import load_all  # noqa: E402
from gradewell.session import build_session  # noqa: E402

COUNTED = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
           "Exchange RoundRobinPartitioning", "BroadcastExchange", "BroadcastHashJoin",
           "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
           "Window", "MapInPandas", "ArrowEvalPython", "InMemoryTableScan"]


def _own_plan(plan: str) -> str:
    """Drop subtrees that do not describe work of this query: the plans under
    InMemoryRelation (persisted inputs built once) and the pre-optimisation
    "Initial Plan" copies that adaptive plans print next to the final one."""
    keep, skip_at = [], None
    for i, line in enumerate(plan.splitlines()):
        indent = len(line) - len(line.lstrip(" :+-"))
        if i > 0 and indent == 0:          # continuation of a literal holding a newline
            if skip_at is None:
                keep.append(line)
            continue
        if skip_at is not None and indent > skip_at:
            continue
        skip_at = None
        if "== Initial Plan ==" in line:
            skip_at = indent
            continue
        keep.append(line)
        if "InMemoryRelation" in line:
            skip_at = indent
    return "\n".join(keep)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    qs = load_all()
    out = ["# Physical plan summary of the headline queries", "",
           f"Generated by `python tools/plan_report.py` at `{sf}` after execution (final adaptive plans).",
           "Counts are operator occurrences in the executed plan, subqueries included;",
           "plans under `InMemoryRelation` (persisted inputs built once and reused) and the",
           "`Initial Plan` copies printed by adaptive execution are not counted.", "",
           "| query | " + " | ".join(c.replace("Exchange ", "X ") for c in COUNTED) + " |",
           "|---|" + "---|" * len(COUNTED)]
    scans = []
    for name in HEADLINE:
        df = qs[name].build(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = _own_plan(df._jdf.queryExecution().executedPlan().toString())
        counts = [str(len(re.findall(re.escape(c) + r"\b", plan))) for c in COUNTED]
        out.append(f"| `{name}` | " + " | ".join(counts) + " |")
        for m in re.finditer(r"FileScan parquet [^\[]*\[[^\]]*\].*?ReadSchema: (struct<[^>]*>)", plan):
            filters = re.search(r"PushedFilters: (\[[^\]]*\])", m.group(0))
            scans.append(f"| `{name}` | `{m.group(1)}` | `{filters.group(1) if filters else '[]'}` |")
    out += ["", "## Scans", "", "| query | ReadSchema | PushedFilters |", "|---|---|---|",
            *sorted(set(scans))]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")
    print("\n".join(out[:8 + len(HEADLINE)]))


if __name__ == "__main__":
    main()
