"""Alert ids and investigations, also broken ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerting as A
from tidewatch.operators import rootcause as C

NOW = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def test_alerts_of_one_moment_have_their_own_ids(spark):
    rule = {"rule_id": "r", "name": "n", "description": "d", "metric": "m", "threshold": 0.0, "cooldown_minutes": 0, "channels": ["email", "e1", "nowhere"]}
    hits = spark.createDataFrame([("m", dt.datetime(2024, 1, 1), 1.0, i) for i in range(5)], "metric string, ts timestamp, value double, event_id long")
    raised = A.fire(hits, [rule])
    assert len({r.alert_id for r in raised.collect()}) == 5
    channels = [{"channel_id": "e1", "channel_type": "email"}, {"channel_id": "e2", "channel_type": "email"}, {"channel_id": "off", "channel_type": "email", "enabled": False}]
    sent = A.outbox(raised, channels)
    assert sent.count() == len({(r.alert_id, r.channel_id) for r in sent.collect()}) == 10
    assert "Exchange" not in A.route(raised.limit(5).select("*"), channels)._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert A.route(raised, []).count() == 0 and A.route(raised, []).columns[-2:] == ["channel_id", "channel_type"]


def series(spark):
    rows = [("m", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 500.0 if i in (7, 9) else float(i % 3)) for i in range(40)] + [("m", dt.datetime(2024, 1, 3), None)]
    return spark.createDataFrame(rows, "metric string, ts timestamp, value double")


def test_anomaly_is_the_first_of_equal_extremes(spark):
    found = C.anomalies(series(spark)).collect()
    assert [(r.metric, r.anomaly_type, r.anomaly_ts, r.position) for r in found] == [("m", "spike", dt.datetime(2024, 1, 1, 7), 7)]


def test_investigation_is_logged_once(spark, tmp_path):
    triggers = spark.createDataFrame([("a", "high"), ("b", "low"), ("a", "high")], "trigger_id string, severity string")
    since = F.lit("2000-01-01").cast("timestamp")
    path = str(tmp_path)
    for _ in range(2):
        rows = C.log_investigations(spark, path, triggers, [("s", series(spark))], since, NOW).collect()
        assert sorted(r.investigation_id for r in rows) == ["rca_a_20240301_000000", "rca_b_20240301_000000"]
    assert C.investigation_log(spark, path).count() == 2 and spark.read.parquet(f"{path}/anomalies").count() == 1
    assert {r.value: r.n for r in C.summary(C.investigation_log(spark, path)).where("dimension = 'status'").collect()} == {"completed": 2}


def test_failed_investigation_is_logged_and_tried_again(spark, tmp_path):
    triggers = spark.createDataFrame([("a", "high")], "trigger_id string, severity string")
    since, path = F.lit("2000-01-01").cast("timestamp"), str(tmp_path)
    broken = series(spark).withColumn("value", F.raise_error(F.lit("sensor is gone")).cast("double"))
    row = C.log_investigations(spark, path, triggers, [("s", broken)], since, NOW).head()
    assert row.status == "failed" and "sensor is gone" in row.error and row.completed_at is None
    assert C.log_investigations(spark, path, triggers, [("s", series(spark))], since, NOW).head().status == "completed"
    assert C.investigation_log(spark, path).count() == 1


def test_broken_run_is_done_again(spark, tmp_path, monkeypatch):
    triggers = spark.createDataFrame([("a", "high")], "trigger_id string, severity string")
    since, path = F.lit("2000-01-01").cast("timestamp"), str(tmp_path)
    with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
        m.setattr(C, "PARTS", ("series", "anomalies", "nothing of the kind"))
        m.setattr(C.Investigation, "__getattr__", lambda self, name: 1 / 0, raising=False)
        C.log_investigations(spark, path, triggers, [("s", series(spark))], since, NOW)
    assert C.log_investigations(spark, path, triggers, [("s", series(spark))], since, NOW).head().status == "completed"
    assert spark.read.parquet(f"{path}/anomalies").count() == 1
