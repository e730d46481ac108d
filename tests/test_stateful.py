"""Rings of newest values across micro-batches, and what the listener writes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_graph_and_streams import BASE, run, stream, write_files

from tidewatch.streaming import stateful as Z
from tidewatch.streaming import streams as X

ROWS = "k string, ts timestamp, event_id long, value double"


def batches(n=5, size=40, seed=2):
    """Rows in any order of time; one key with most of them, one with few, a null key and values that are no numbers."""
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), BASE + dt.timedelta(seconds=rnd.randrange(500)), i, rnd.choice([None, float("nan"), 1.5 * i])) for i in range(n * size)]
    rows[7] = ("rare", BASE, 7, 3.0)
    return [rows[i * size : (i + 1) * size] for i in range(n)]


@pytest.mark.parametrize("buckets", [1, 5])
def test_rings_of_one_bucket_stay_apart(spark, tmp_path, buckets):
    Z.use_rocksdb(spark)
    rnd = random.Random(4)
    rows = [(f"u{rnd.randrange(40)}", BASE + dt.timedelta(seconds=rnd.randrange(500)), i, 1.5 * i) for i in range(300)]
    data = [rows[i : i + 100] for i in (0, 100, 200)]
    out = Z.last_values(stream(spark, write_files(spark, tmp_path, data, ROWS), ROWS), "k", "ts", "value", 6, gate=4, buckets=buckets)
    run(X.store_events(out, X.StreamConfig(f"apart{buckets}", str(tmp_path / "cp")), str(tmp_path / "o")))
    want, held = [], {}
    for batch in data:
        for k in {r[0] for r in batch}:
            new = [r[1:] for r in batch if r[0] == k]
            held[k] = sorted([*held.get(k, []), *new])[-6:]
            full = len(held[k]) >= 4
            want += [(k, *held[k][-1][:2], None, [x[2] for x in held[k]])] if full else [(k, *r, None) for r in new]
    got = [(r.k, r.ts, r.event_id, r.value, r["values"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ring_equals_a_list(spark, tmp_path):
    Z.use_rocksdb(spark)
    data = batches()
    where = write_files(spark, tmp_path, data, ROWS)
    out = Z.last_values(stream(spark, where, ROWS), "k", "ts", "value", 12, gate=9)
    run(X.store_events(out, X.StreamConfig("ring", str(tmp_path / "cp")), str(tmp_path / "o")))
    want, held = [], {}
    for rows in data:
        for k in {r[0] for r in rows}:
            new = [(r[1], r[2], r[3]) for r in rows if r[0] == k and r[3] is not None and r[3] == r[3]]
            if not new:
                continue
            held[k] = sorted([*held.get(k, []), *new])[-12:]
            if len(held[k]) >= 9:
                want.append((str(k), held[k][-1][0], held[k][-1][1], None, [x[2] for x in held[k]]))
            else:
                want += [(str(k), t, i, v, None) for t, i, v in new]
    got = [(str(r.k), r.ts, r.event_id, r.value, r["values"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(k == "rare" for k, *_ in got) and sum(v is not None for *_, v in got) > 5


def test_a_gate_over_the_ring_is_refused():
    with pytest.raises(ValueError):
        Z.Ring(5, 6, "bigint")


def test_aggregates_over_values(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],)], "values array<double>")
    got = df.select(*[f(F.col("values")).alias(k) for k, f in Z.OVER_VALUES.items()]).head().asDict()
    assert got == {"count": 3.0, "sum": 6.0, "average": 2.0, "min": 1.0, "max": 3.0}


def test_log_of_late_and_bad_rows(spark, tmp_path):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    data = [[("a", at(1), 1), ("a", at(300), 2)], [("a", at(301), 3)], [("b", at(302), 4)], [("a", at(2), 5), ("a", at(303), 6), (None, at(304), 7)]]
    schema = "k string, ts timestamp, event_id long"
    rows = Z.observed(stream(spark, write_files(spark, tmp_path, data, schema), schema), "x", "ts", F.col("k") == "b")
    out = X.window_aggregate(rows, "ts", "1 hour", ["k"], [F.count(F.lit(1)).alias("n")], watermark="10 minutes")
    with Z.MetricsLog(spark, str(tmp_path / "log")):
        run(X.store_events(out, X.StreamConfig("logged", str(tmp_path / "cp")), str(tmp_path / "o")))
    log = {r.batch_id: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert [log[i].total_events for i in range(4)] == [2, 1, 1, 3] and [log[i].error_count for i in range(4)] == [0, 0, 1, 0]
    assert [log[i].late_rows for i in range(4)] == [0, 0, 0, 1] and log[2].newest_event == at(302) and log[0].stream_id == "logged"
    total = Z.stream_metrics(spark.read.parquet(str(tmp_path / "log"))).head()
    assert (total.batches, total.total_events, total.error_count, total.late_rows) == (4, 7, 1, 1)
