"""Validation, quality, alerting, root cause and retention on small cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import aggregates as A
from tidewatch.operators import alerting as L
from tidewatch.operators import predicates as P
from tidewatch.operators import quality as Q
from tidewatch.operators import retention as T
from tidewatch.operators import rootcause as C
from tidewatch.operators import validation as V

SCHEMA = {
    "type": "object",
    "required": ["station", "depth"],
    "properties": {
        "station": {"type": "string"},
        "depth": {"type": "number", "minimum": -12, "maximum": 40},
        "ice": {"type": "boolean"},
        "current": {"type": "number"},
    },
}
RULES = [
    {"type": "min_length", "field": "station", "value": 4},
    {"type": "enum", "field": "buoy", "value": ["red", "green"]},
    {"type": "max_value", "field": "depth", "value": 35},
    {"type": "regex", "field": "log", "value": "^[0-9]{4}/[0-9]{2}$"},
    {"type": "not_null", "field": "current"},
]


def payloads(spark, *records):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "i int, p string")


def test_valid_and_faulty_readings(spark):
    good = {"station": "Pier 7", "depth": 11.5, "buoy": "red", "log": "2031/04", "current": 0.3}
    deep = {"station": "Rip", "depth": 38, "buoy": "blue", "log": "31/4", "current": None}
    rows = V.validate(payloads(spark, good, deep, {"depth": 99, "station": "Pier 8"}, "{half"), SCHEMA, RULES, payload="p").orderBy("i").collect()
    assert rows[0].is_valid and rows[0].errors == []
    fields = [e.split("'")[1] for e in rows[1].errors if e.startswith("Field")]
    assert not rows[1].is_valid and set(fields) == {"station", "buoy", "depth", "log", "current"}
    assert rows[2].errors[0] == "Schema validation failed: 99 is greater than the maximum of 40"
    assert not rows[3].is_valid


def test_null_is_not_absence(spark):
    rules = [{"type": "required", "field": "a"}, {"type": "not_null", "field": "a"}]
    got = [r.errors for r in V.validate(payloads(spark, {"a": None}, {}), rules=rules, payload="p").orderBy("i").collect()]
    assert got == [["Field 'a' cannot be null"], ["Required field 'a' is missing"]]


def test_falsy_values_skip_length_and_regex(spark):
    rules = [{"type": "min_length", "field": "a", "value": 3}, {"type": "regex", "field": "a", "value": "z"}]
    rows = V.validate(payloads(spark, {"a": ""}, {"a": 0}, {"a": False}, {"a": "q"}), rules=rules, payload="p").orderBy("i").collect()
    assert [len(r.errors) for r in rows] == [0, 0, 0, 2]


def test_zero_std_gives_no_anomaly(spark):
    got = V.validate(payloads(spark, {"a": 99}), limits={"a": {"z_score_threshold": 1, "mean": 0, "std": 0}}, payload="p").head()
    assert got.is_valid


def test_empty_batch(spark):
    empty = V.validate(payloads(spark, {"a": 1}).limit(0), rules=RULES, payload="p")
    assert V.totals(empty).head().validation_rate == 0
    assert V.error_summary(empty).count() == 0
    assert V.duplicate_count(empty, ["i"]).head().duplicate_records == 0


def test_rules_on_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "v double, k string")
    rules = [{"type": t, "column": "v"} for t in ("count", "sum", "mean", "median", "std", "most_common", "unique_count")]
    r = A.aggregate(df, rules).head()
    assert (r.v_count, r.v_sum, r.v_mean, r.v_median, r.v_most_common, r.v_unique_count) == (2, 0, None, None, None, 0)
    r = A.aggregate(df.limit(0), rules).head()
    assert r.v_count == 0 and r.v_sum == 0
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert A.aggregate(nan, [{"type": "mean", "column": "v"}]).head().v_mean == 1.0


def test_approximate_rules_are_close(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    r = A.aggregate(df, [
        {"type": "median", "column": "v", "exact": False}, {"type": "unique_count", "column": "v", "exact": False},
    ]).head()
    assert abs(r.v_median - 5000) < 50 and abs(r.v_unique_count - 10_000) < 1500


def test_trend_of_zero_and_single_values(spark):
    h = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("b", 1, 3.0), ("c", 1, 2.0), ("c", 2, 2.0)], "metric string, ts int, value double")
    got = {r.metric: (r.trend, r.change_percent) for r in A.trends(h).collect()}
    assert got == {"a": ("increasing", 0.0), "c": ("decreasing", 0.0)}


def test_rename_swap_and_clash(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = P.rename_fields(df, {"a": "tmp", "b": "a", "tmp": "b"})
    assert out.select("a", "b", "c").head() == (2, 1, 3)
    assert P.rename_fields(df, {"a": "c"}).columns == ["b", "c"] or P.rename_fields(df, {"a": "c"}).head().c == 1


def test_unknown_operator(spark):
    with pytest.raises(ValueError):
        P.condition("a", "near", 1)


def test_outlier_rule_needs_ten_values(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 1, 1, 1, 1000]], "v double")
    r = Q.check(df, [{"rule_id": "r", "rule_type": "outlier", "field_name": "v"}]).head()
    assert r.passed and r.score == 1.0 and r.issue_count == 0


def test_quality_on_no_rows(spark):
    df = spark.createDataFrame([], "v double, k string")
    rules = [{"rule_id": k, "rule_type": k, "field_name": "v"} for k in ("missing", "range", "duplicate", "outlier")]
    assert all(r.passed and r.score == 1.0 for r in Q.check(df, rules).collect())


def test_forest_quality_rule(spark):
    df = spark.createDataFrame([(i, float(i % 17)) for i in range(300)], "id int, v double")
    rule = {"rule_id": "f", "rule_type": "outlier", "field_name": "v", "parameters": {"method": "isolation_forest", "key_columns": ["id"], "max_outlier_pct": 0.5}}
    r = Q.check(df, [rule]).head()
    assert r.passed and 0 <= r.issue_pct <= 0.2


def brute_cooldown(times, cool):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t >= last + cool:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("stretch_rows", [1, 40, 1 << 20])
def test_cooldown_equals_brute_force(spark, stretch_rows):
    rnd = random.Random(stretch_rows)
    rows, want = [], set()
    for rule, cool, n, spread in (("hot", 60, 1500, 40_000), ("sparse", 30, 20, 100_000), ("burst", 10_000, 300, 500), ("zero", 0, 50, 100)):
        times = [rnd.randrange(spread) for _ in range(n)]
        for i, t in enumerate(times):
            rows.append((rule, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), f"{rule}{i:05d}", cool))
        if cool:
            for t in brute_cooldown(times, cool):
                want.add((rule, min(f"{rule}{i:05d}" for i, x in enumerate(times) if x == t)))
        else:
            want |= {(rule, f"{rule}{i:05d}") for i in range(n)}
    df = spark.createDataFrame(rows, "rule_id string, ts timestamp, event_id string, cooldown_seconds int").repartition(6)
    got = L.cooldown(df, stretch_rows=stretch_rows).select("rule_id", "event_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_cooldown_continues_from_earlier_runs(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("r", at(s), s, 60) for s in (10, 50, 70, 100, 130)], "rule_id string, ts timestamp, event_id int, cooldown_seconds int")
    last = spark.createDataFrame([("r", at(0))], "rule_id string, ts timestamp")
    assert sorted(r.event_id for r in L.cooldown(df, last_fired=last).collect()) == [70, 130]


def test_escalation_states(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    raised = spark.createDataFrame(
        [(a, at(0), d, "active", 0) for a, d in (("quiet", 30), ("early", 30), ("late", 30), ("none", None))],
        "alert_id string, created_at timestamp, delay_minutes int, status string, escalation_level int",
    )
    actions = spark.createDataFrame(
        [("early", "acknowledge", at(10), "u"), ("early", "resolve", at(20), "u"), ("late", "acknowledge", at(40), "u")],
        "alert_id string, action string, acted_at timestamp, acted_by string",
    )
    got = {r.alert_id: (r.status, r.escalation_level) for r in L.escalate(raised, actions, F.lit(at(60))).collect()}
    assert got == {"quiet": ("escalated", 1), "early": ("resolved", 0), "late": ("acknowledged", 1), "none": ("active", 0)}
    soon = {r.alert_id: r.status for r in L.escalate(raised, actions, F.lit(at(15))).collect()}
    assert soon["quiet"] == "active" and soon["early"] == "acknowledged"


def test_payloads_per_channel(spark):
    raised = spark.createDataFrame(
        [("a1", "Alert: X", "m", "critical", "active", dt.datetime(2024, 1, 1), {"k": "v"}, ["slack", "webhook_alerts", "slack_alerts", "gone"])],
        "alert_id string, title string, message string, severity string, status string, created_at timestamp, metadata map<string,string>, channels array<string>",
    )
    got = {r.channel_id: json.loads(r.payload) for r in L.outbox(raised, L.DEFAULT_CHANNELS).collect()}
    assert set(got) == {"slack_alerts", "webhook_alerts"}
    assert got["slack_alerts"]["attachments"][0]["color"] == "#8b0000"
    assert got["webhook_alerts"]["metadata"] == {"k": "v"}


def metric_rows(spark, **series):
    rows = [("s", m, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for m, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "source string, metric string, ts timestamp, value double")


def test_default_triggers(spark):
    bad = metric_rows(spark, accuracy=[0.7], latency_ms=range(10), alerts_count=[8])
    assert {r.trigger_id for r in C.fired(bad).collect()} == {"critical_performance", "sustained_latency", "multiple_alerts"}
    fine = metric_rows(spark, accuracy=[0.7, 0.9], latency_ms=[5] * 9, alerts_count=[8])
    assert C.fired(fine).count() == 0


def test_anomaly_takes_the_first_largest_point(spark):
    flat = [1.0, -1.0] * 10
    r = C.anomalies(metric_rows(spark, m=[*flat, 9.0, *flat, 9.0], steady=[1.0] * 30)).collect()
    assert len(r) == 1 and r[0].position == 20 and r[0].anomaly_type == "spike"


def test_no_causes(spark):
    quiet = metric_rows(spark, a=range(12), b=[1.0, 0.0] * 6)
    done = C.investigate([("s", quiet.drop("source"))], F.lit("2024-01-01").cast("timestamp"))
    impact = done.impact.head()
    assert impact.overall_impact == "low" and impact.impact_score == 0 and impact.affected_metrics in ([], None)
    assert [r.recommendation for r in done.recommendations.collect()] == list(C.CALM_ADVICE)


def test_purge_stored_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), f"p{i // 10}") for i in range(40)]
    spark.createDataFrame(rows, "i int, ts timestamp, part string").write.partitionBy("part").parquet(path)
    assert T.purge_partitions(spark, path, "ts", "2024-02-01", 16, ["part"]) == 15
    left = spark.read.parquet(path)
    assert sorted(r.i for r in left.collect()) == list(range(15, 40))
    assert not (tmp_path / "t" / "part=p0").exists()
    assert T.purge_partitions(spark, path, "ts", "2024-02-01", 16, ["part"]) == 0
