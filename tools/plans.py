"""Print plan facts of registered queries: joins, exchanges, Python steps, single-task steps.

    python tools/plans.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import pathlib
import re
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

FACTS = {
    "scans": r"FileScan", "exchanges": r"\bExchange (?:hash|range|round)", "single": r"Exchange SinglePartition",
    "broadcast": r"BroadcastHashJoin", "merge": r"SortMergeJoin", "nested": r"NestedLoopJoin|CartesianProduct",
    "python": r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|BatchEvalPython", "window": r"\bWindow \[",
}


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from catalog import QUERIES
    from tools.compare import session

    spark = session()
    for name in args.names or QUERIES:
        plan = QUERIES[name](spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[-1]
        print(name, *[f"{k}={len(re.findall(p, plan))}" for k, p in FACTS.items()], flush=True)


if __name__ == "__main__":
    main()
