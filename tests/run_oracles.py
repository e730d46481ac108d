"""Command line: compare registered queries with their SQL twins (``run_oracles.py DIR [PREFIX …]``)."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidewatch.session import build_session  # noqa: E402


def main() -> int:
    path, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(path), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, path)
            if name in oracles:
                issue = difference(df, con, oracles[name])
                note = "ok"
            else:
                issue, note = None, f"rows only: {df.count()}"
        except Exception as exc:  # report and go on
            issue, note = f"{type(exc).__name__}: {str(exc)[:600]!r}", ""
        bad += issue is not None
        print(f"{'FAIL' if issue else 'ok  '} {name} {time.time() - start:.1f}s {issue or note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
