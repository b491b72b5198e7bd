"""Summarise the physical plans of the registered queries.

Usage: python tools/plan_report.py [--sf DIR] [name ...] > PLANS.md

For every query: columns read and filters pushed into each scan, number of
shuffles, join strategies, window-group limits and Python stages. Plans that
start from a checkpoint show ``Scan ExistingRDD`` (lineage cut on purpose).
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NODES = [
    "Exchange",
    "BroadcastExchange",
    "BroadcastHashJoin",
    "SortMergeJoin",
    "ShuffledHashJoin",
    "BroadcastNestedLoopJoin",
    "CartesianProduct",
    "HashAggregate",
    "ObjectHashAggregate",
    "SortAggregate",
    "Window",
    "WindowGroupLimit",
    "ArrowEvalPython",
    "MapInPandas",
    "Generate",
    "Scan parquet",
    "Scan ExistingRDD",
]


def plan_text(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def summarise(text: str) -> dict:
    tree = text.split("\n\n")[0]
    counts = Counter()
    for node in NODES:
        counts[node] = len(re.findall(r"[-+:] " + re.escape(node) + r"(?: |\()", tree)) + len(
            re.findall(r"^" + re.escape(node) + r" \(", tree, flags=re.M)
        )
    reads = re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
    pushed = [p for p in re.findall(r"PushedFilters: (\[[^\n]*\])", text) if p != "[]"]
    return {"counts": {k: v for k, v in counts.items() if v}, "reads": reads, "pushed": pushed}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from tessera.plans.queries import QUERIES
    from tessera.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    names = args.names or sorted(QUERIES)
    print(f"# Physical plans of the registered queries ({os.path.basename(args.sf)})\n")
    print("Generated by `tools/plan_report.py`. Counts are operator nodes of the final")
    print("physical plan; `Scan ExistingRDD` marks a reliable checkpoint (lineage cut).\n")
    print("| query | shuffles | joins | aggregates / windows | python | scans: columns read [pushed filters] |")
    print("|---|---|---|---|---|---|")
    for name in names:
        s = summarise(plan_text(QUERIES[name](spark, args.sf)))
        c = s["counts"]
        joins = ", ".join(f"{k} {v}" for k, v in c.items() if "Join" in k or k == "CartesianProduct") or "-"
        aggs = ", ".join(f"{k} {v}" for k, v in c.items() if "Aggregate" in k or "Window" in k) or "-"
        py = ", ".join(f"{k} {v}" for k, v in c.items() if k in ("ArrowEvalPython", "MapInPandas")) or "-"
        scans = "; ".join(s["reads"]) or ("checkpoint" if c.get("Scan ExistingRDD") else "-")
        if s["pushed"]:
            scans += " [" + "; ".join(s["pushed"]) + "]"
        shuffles = c.get("Exchange", 0)
        bcast = c.get("BroadcastExchange", 0)
        print(f"| `{name}` | {shuffles}{f' (+{bcast} broadcast)' if bcast else ''} | {joins} | {aggs} | {py} | {scans} |")
    spark.stop()


if __name__ == "__main__":
    main()
