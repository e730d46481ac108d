"""Command line: list plan shapes that do not scale, per registered query (``plan_scan.py DIR [PREFIX …]``)."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tidewatch.session import build_session  # noqa: E402


def findings(plan: str) -> list[str]:
    out = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
    # a window without a partition key puts every row into one task
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line) and not re.search(r"\], \[[^\]]+\], \[", line):
            out.append("single-task window")
        if "BatchEvalPython" in line:
            out.append("row-at-a-time Python")
        if "collect_list" in line or "collect_set" in line:
            out.append("collect")
    return sorted(set(out))


def main() -> None:
    path, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        plan = fn(spark, path)._jdf.queryExecution().executedPlan().toString()
        found = findings(plan)
        if found:
            print(name, found, flush=True)


if __name__ == "__main__":
    main()
