"""Report queries are compiled by kind: results by hand, and scans that do not grow with the number of queries."""

from __future__ import annotations

import datetime
import statistics

import pytest

from tidewatch.operators import reporting


@pytest.fixture()
def series(spark, tmp_path):
    rows = []
    for i in range(40):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)
        rows += [("s", "a", at, float(i * 7 % 11)), ("s", "b", at, float(i))]
        if i % 2:
            rows.append(("s", "c", at, float(-i)))
    rows.append(("s", "b", datetime.datetime(2023, 1, 1), None))
    spark.createDataFrame(rows, "source string, metric string, ts timestamp, value double").write.parquet(str(tmp_path / "series"))
    return spark.read.parquet(str(tmp_path / "series")), rows


def made(metrics):
    out = [{"query_id": f"{m}_{k}", "query_type": "aggregation", "metric": m, "aggregation": k} for m in metrics for k in ("mean", "median", "std", "min", "max", "odd")]
    out += [{"query_id": f"{m}_t", "query_type": "trend", "metric": m, "window_size": 5} for m in metrics]
    return out + [{"query_id": f"{m}_{n}", "query_type": "correlation", "metric1": m, "metric2": n} for m in metrics for n in metrics]


def test_results_by_hand(series):
    df, rows = series
    got = {r.query_id: r for r in reporting.run_queries(df, [*made(["a", "b", "c", "none"]), {"query_id": "off", "query_type": "trend", "metric": "a", "enabled": False}]).collect()}
    values = {m: {ts: v for _, x, ts, v in rows if x == m and v is not None} for m in "abc"}
    want = {}
    for m, v in values.items():
        v = list(v.values())
        want |= {f"{m}_mean": statistics.fmean(v), f"{m}_odd": statistics.fmean(v), f"{m}_median": statistics.median(v), f"{m}_std": statistics.pstdev(v), f"{m}_min": min(v), f"{m}_max": max(v)}
        want[f"{m}_t"] = statistics.linear_regression(range(5), [values[m][t] for t in sorted(values[m])[-5:]]).slope
        for n, w in values.items():
            both = sorted(set(values[m]) & set(w))
            want[f"{m}_{n}"] = statistics.correlation([values[m][t] for t in both], [w[t] for t in both])
    assert set(got) == set(want)
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r.value for k, r in got.items()}
    assert got["b_c"].note == "strong" and got["b_t"].note == "increasing" and got["c_t"].note == "decreasing"
    assert (got["a_b"].metric, got["a_b"].metric2, got["a_odd"].name) == ("a", "b", "odd")


def test_scans_do_not_grow_with_the_queries(series):
    df, _ = series
    scans = lambda queries: reporting.run_queries(df, queries)._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert scans(made(["a", "b", "c"])) == scans(made(["a"]))


def test_no_query_gives_an_empty_table(series):
    df, _ = series
    out = reporting.run_queries(df, [{"query_id": "x", "query_type": "no_such_kind"}])
    assert out.columns == list(reporting.RESULT) and out.isEmpty()
    assert reporting.run_queries(df.limit(0), made(["a", "b"])).isEmpty()
