"""Queries over alerting, root causes and report tables; events are the metric stream."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.operators import alerting as A
from tidewatch.operators import reporting as R
from tidewatch.operators import rootcause as C
from tidewatch.operators.predicates import compare
from tidewatch.plans.registry import ORACLES, query, tidy
from tidewatch.plans.tables import scratch

RULES = [
    {"rule_id": "r_error", "name": "Errors", "description": "Error event", "metric": "error", "threshold": 0.0,
     "operator": ">", "severity": "error", "channels": ["email", "sms_alerts"], "delay_minutes": 30, "cooldown_minutes": 60},
    {"rule_id": "r_click", "name": "Big click", "description": "Large click", "metric": "click", "threshold": 100.0,
     "operator": ">=", "severity": "warning", "channels": ["slack", "nowhere"], "delay_minutes": 15, "cooldown_minutes": 0},
    {"rule_id": "r_view", "name": "Small view", "description": "Small view", "metric": "view", "threshold": 20.0,
     "operator": "<", "severity": "info", "channels": ["webhook"], "cooldown_minutes": 360},
    {"rule_id": "r_odd", "name": "Odd", "description": "Unknown operator", "metric": "view", "threshold": 1.0,
     "operator": "~", "severity": "critical", "channels": ["email"], "cooldown_minutes": 5},
    {"rule_id": "r_off", "name": "Off", "description": "Disabled", "metric": "view", "threshold": 1.0, "enabled": False},
]
RULES_SQL = """rules(rule_id, name, description, metric, threshold, op, severity, delay, cool) AS (VALUES
  ('r_error', 'Errors', 'Error event', 'error', 0.0, '>', 'error', 30, 60), ('r_click', 'Big click', 'Large click', 'click', 100.0, '>=', 'warning', 15, 0),
  ('r_view', 'Small view', 'Small view', 'view', 20.0, '<', 'info', NULL, 360)),
  hits AS (SELECT r.*, event_id, ts, value FROM events JOIN rules r ON event_type = metric
    WHERE CASE op WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold ELSE value < threshold END)"""
FIRED_SQL = f"""{RULES_SQL}, walk AS (
    SELECT rule_id, cool, min(ts) AS ts FROM hits WHERE cool > 0 GROUP BY 1, 2
    UNION ALL SELECT * FROM (SELECT w.rule_id, w.cool, (SELECT min(h.ts) FROM hits h WHERE h.rule_id = w.rule_id
      AND h.ts >= w.ts + to_minutes(w.cool)) AS ts FROM walk w) WHERE ts IS NOT NULL),
  fired AS (SELECT h.* FROM hits h JOIN walk w ON h.rule_id = w.rule_id AND h.ts = w.ts
    QUALIFY row_number() OVER (PARTITION BY h.rule_id, h.ts ORDER BY event_id) = 1
    UNION ALL SELECT * FROM hits WHERE cool = 0)"""
CHANNELS = [
    {"channel_id": "email_alerts", "channel_type": "email"},
    {"channel_id": "slack_alerts", "channel_type": "slack"},
    {"channel_id": "webhook_alerts", "channel_type": "webhook"},
    {"channel_id": "sms_alerts", "channel_type": "sms"},
    {"channel_id": "email_old", "channel_type": "email", "enabled": False},
]


def metric_events(t):
    return t.events.select(F.col("event_type").alias("metric"), "ts", "value", "event_id")


@query("alert_breaches", f"WITH {RULES_SQL} SELECT rule_id, event_id, value FROM hits")
def alert_breaches(t):
    return A.breaches(metric_events(t), RULES).select("rule_id", "event_id", "value")


def fired_hits(t):
    hits = A.breaches(metric_events(t), RULES).withColumn("cooldown_seconds", F.col("cooldown_minutes") * 60)
    return A.cooldown(hits)


@query("alert_cooldown", f"WITH RECURSIVE {FIRED_SQL} SELECT rule_id, event_id FROM fired")
def alert_cooldown(t):
    return fired_hits(t).select("rule_id", "event_id")


@query(
    "alert_cooldown_per_user",
    """WITH RECURSIVE hits AS (SELECT user_id, ts, event_id FROM events WHERE value > 30), walk AS (
      SELECT user_id, min(ts) AS ts FROM hits GROUP BY 1
      UNION ALL SELECT * FROM (SELECT w.user_id, (SELECT min(h.ts) FROM hits h WHERE h.user_id = w.user_id AND h.ts >= w.ts + INTERVAL 12 HOUR) AS ts FROM walk w) WHERE ts IS NOT NULL)
    SELECT h.user_id, h.event_id FROM hits h JOIN walk w ON h.user_id = w.user_id AND h.ts = w.ts""",
)
def alert_cooldown_per_user(t):
    hits = t.events.filter("value > 30").select("user_id", "ts", "event_id", F.lit(12 * 3600).alias("cooldown_seconds"))
    return A.cooldown(hits, keys=["user_id"]).select("user_id", "event_id")


ALERTS_SQL = f"""{FIRED_SQL}, alerts AS (SELECT rule_id || '_' || strftime(ts, '%Y%m%d_%H%M%S_%f') || '_' || event_id AS alert_id, rule_id, 'Alert: ' || name AS title, description || ' - ' || metric || ': ' || value AS message, metric,
  severity, ts AS created_at, delay, event_id, value FROM fired)"""


def raised(t):
    return A.alerts(fired_hits(t))


@query(
    "alert_rows",
    f"""WITH RECURSIVE {ALERTS_SQL} SELECT alert_id, rule_id, title, severity, 'active' AS status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM alerts""",
)
def alert_rows(t):
    return tidy(raised(t).select("alert_id", "rule_id", "title", "severity", "status", "created_at"))


STATE_SQL = f"""{ALERTS_SQL}, u AS (SELECT DISTINCT alert_id, rule_id, severity, date_trunc('second', created_at) AS created_at, delay FROM alerts),
  actions AS (SELECT alert_id, CASE WHEN n % 3 = 0 THEN 'acknowledge' ELSE 'resolve' END AS action, created_at + to_minutes((n % 50)::INT) AS acted_at
    FROM (SELECT alert_id, created_at, minute(created_at) * 7 + second(created_at) AS n FROM u) WHERE n % 4 <> 0),
  state AS (SELECT u.*, action, acted_at, coalesce(created_at + to_minutes(delay) <= TIMESTAMP '2024-01-25' AND (acted_at IS NULL OR acted_at > created_at + to_minutes(delay)), false) AS overdue
    FROM u LEFT JOIN (SELECT * FROM actions WHERE acted_at <= TIMESTAMP '2024-01-25') USING (alert_id)),
  current AS (SELECT alert_id, rule_id, severity, created_at, CASE action WHEN 'resolve' THEN 'resolved' WHEN 'acknowledge' THEN 'acknowledged' ELSE CASE WHEN overdue THEN 'escalated' ELSE 'active' END END AS status,
    overdue::BIGINT AS escalation_level FROM state)"""


def alert_states(t):
    """Distinct alerts to the second, with actions derived from their times."""
    whole = raised(t).withColumn("created_at", F.date_trunc("second", "created_at")).dropDuplicates(["alert_id"])
    n = F.minute("created_at") * 7 + F.second("created_at")
    actions = whole.withColumn("n", n).filter("n % 4 <> 0").select(
        "alert_id", F.when(F.col("n") % 3 == 0, "acknowledge").otherwise("resolve").alias("action"),
        (F.col("created_at") + F.make_dt_interval(mins=F.col("n") % 50)).alias("acted_at"), F.lit("ops").alias("acted_by"),
    )
    return A.escalate(whole, actions, F.lit("2024-01-25").cast("timestamp"))


@query("alert_escalation_and_state", f"WITH RECURSIVE {STATE_SQL} SELECT alert_id, status, escalation_level FROM current")
def alert_escalation_and_state(t):
    return tidy(alert_states(t).select("alert_id", "status", "escalation_level"))


@query(
    "alert_counts",
    f"""WITH RECURSIVE {STATE_SQL}, c AS (SELECT * FROM current WHERE created_at >= TIMESTAMP '2024-01-10')
    SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM c UNION ALL SELECT 'status', status, count(*) FROM c GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'rule_id', rule_id, count(*) FROM c GROUP BY 2""",
)
def alert_counts(t):
    return A.counts(alert_states(t), F.lit("2024-01-10").cast("timestamp"))


@query(
    "alert_recent",
    f"WITH RECURSIVE {STATE_SQL} SELECT alert_id, status FROM current ORDER BY created_at DESC, alert_id DESC LIMIT 10",
)
def alert_recent(t):
    return A.recent(alert_states(t)).select("alert_id", "status")


@query(
    "alert_routing",
    f"""WITH RECURSIVE {ALERTS_SQL}, ch(rule_id, channel_id, channel_type) AS (VALUES ('r_error', 'email_alerts', 'email'), ('r_error', 'sms_alerts', 'sms'),
      ('r_click', 'slack_alerts', 'slack'), ('r_view', 'webhook_alerts', 'webhook'))
    SELECT DISTINCT alert_id, channel_id, channel_type FROM alerts JOIN ch USING (rule_id)""",
)
def alert_routing(t):
    return A.route(raised(t), CHANNELS).select("alert_id", "channel_id", "channel_type")


@query(
    "alert_outbox",
    f"""WITH RECURSIVE {ALERTS_SQL}, a AS (SELECT *, upper(severity) AS loud, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS c FROM alerts)
    SELECT alert_id, 'email_alerts' AS channel_id, 'email' AS channel_type, '[' || loud || '] ' || title || chr(10) || chr(10) || 'Alert Details:' || chr(10) || '- Title: ' || title || chr(10) ||
      '- Message: ' || message || chr(10) || '- Severity: ' || severity || chr(10) || '- Created: ' || c || chr(10) || '- Alert ID: ' || alert_id || chr(10) || chr(10) || 'Please take appropriate action.' AS payload
    FROM a WHERE rule_id = 'r_error'
    UNION ALL SELECT alert_id, 'sms_alerts', 'sms', 'ALERT [' || loud || ']: ' || title || ' - ' || message FROM a WHERE rule_id = 'r_error'
    UNION ALL SELECT alert_id, 'slack_alerts', 'slack', '{{"text":"🚨 *' || title || '*","attachments":[{{"color":"#ffa500","fields":[{{"title":"Message","value":"' || message || '","short":false}},{{"title":"Severity","value":"' || severity ||
      '","short":true}},{{"title":"Alert ID","value":"' || alert_id || '","short":true}},{{"title":"Created","value":"' || c || '","short":true}}]}}]}}' FROM a WHERE rule_id = 'r_click'
    UNION ALL SELECT alert_id, 'webhook_alerts', 'webhook', '{{"alert_id":"' || alert_id || '","title":"' || title || '","message":"' || message || '","severity":"' || severity || '","status":"active","created_at":"' || c ||
      '","metadata":{{"metric_name":"' || metric || '","metric_value":"' || value || '"}}}}' FROM a WHERE rule_id = 'r_view'""",
)
def alert_outbox(t):
    """Messages of all rules, in the form of every kind of channel."""
    return A.outbox(raised(t), CHANNELS)


# daily model metrics from lineitem, under the names the default rules use
DAILY_MODEL_SQL = """daily AS (SELECT date_trunc('month', l_shipdate) AS ts, avg(CASE WHEN l_discount < 0.09 THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(l_quantity) * 7.84 AS latency_ms, avg(l_tax) * 2.5 AS drift_score, count(*) % 9 AS alerts_count FROM lineitem GROUP BY 1),
  series AS (SELECT 'performance' AS source, 'accuracy' AS metric, ts, accuracy AS value FROM daily UNION ALL SELECT 'performance', 'latency_ms', ts, latency_ms FROM daily
    UNION ALL SELECT 'quality', 'drift_score', ts, drift_score FROM daily UNION ALL SELECT 'alerts', 'alerts_count', ts, alerts_count::DOUBLE FROM daily)"""


def model_daily(t):
    return t.lineitem.groupBy(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("ts")).agg(
        F.avg(F.when(F.col("l_discount") < 0.09, 1.0).otherwise(0.0)).alias("accuracy"),
        (F.avg("l_quantity") * 7.84).alias("latency_ms"),
        (F.avg("l_tax") * 2.5).alias("drift_score"),
        (F.count(F.lit(1)) % 9).alias("alerts_count"),
    )


def model_series(t):
    names = {"accuracy": "performance", "latency_ms": "performance", "drift_score": "quality", "alerts_count": "alerts"}
    items = F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(m).alias("metric"), F.col("ts"), F.col(m).cast("double").alias("value")) for m, s in names.items()
    ])
    return model_daily(t).select(F.inline(items))


@query(
    "alert_default_rules",
    f"""WITH {DAILY_MODEL_SQL}, h AS (SELECT 'performance_degradation' AS rule_id, ts, value FROM series WHERE metric = 'accuracy' AND value < 0.85
      UNION ALL SELECT 'high_latency', ts, value FROM series WHERE metric = 'latency_ms' AND value > 200
      UNION ALL SELECT 'data_drift', ts, value FROM series WHERE metric = 'drift_score' AND value > 0.1)
    SELECT rule_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM h""",
)
def alert_default_rules(t):
    return tidy(A.breaches(model_series(t), A.DEFAULT_RULES).select("rule_id", "ts", "value"))


RCA_TRIGGERS = [
    {**C.DEFAULT_TRIGGERS[0], "conditions": {"type": "threshold", "metric": "accuracy", "threshold": 0.95, "operator": "<"}},
    {"trigger_id": "latency_moves", "severity": "high", "conditions": {"type": "trend", "metric": "latency_ms", "trend_direction": "any", "window_size": 10, "threshold": 0.001}},
    {"trigger_id": "never", "conditions": {"type": "compound", "conditions": []}},
    {"trigger_id": "nested", "severity": "low", "conditions": {"type": "compound", "logic": "OR", "conditions": [
        {"type": "threshold", "metric": "accuracy", "threshold": 0.0, "operator": "<"},
        {"type": "compound", "logic": "AND", "conditions": [
            {"type": "anomaly", "metric": "drift_score", "anomaly_threshold": 0.001},
            {"type": "threshold", "metric": "alerts_count", "threshold": 9, "operator": "<"}]}]}},
    {"trigger_id": "absent_metric", "conditions": {"type": "threshold", "metric": "nope", "threshold": 1}},
]


@query(
    "rca_triggers",
    f"""WITH {DAILY_MODEL_SQL}, last AS (SELECT metric, arg_max(value, ts) AS v, max(ts) AS mt FROM series GROUP BY 1),
    l10 AS (SELECT value, 10 - row_number() OVER (ORDER BY ts DESC) AS x FROM series WHERE metric = 'latency_ms' QUALIFY row_number() OVER (ORDER BY ts DESC) <= 10),
    z AS (SELECT abs(any_value(l.v) - avg(value)) / stddev_pop(value) AS z FROM series s JOIN last l USING (metric) WHERE metric = 'drift_score' AND ts < mt)
    SELECT 'critical_performance' AS trigger_id, 'critical' AS severity FROM last WHERE metric = 'accuracy' AND v < 0.95
    UNION ALL SELECT 'latency_moves', 'high' FROM (SELECT regr_slope(value, x) AS s FROM l10) WHERE abs(s) > 0.001
    UNION ALL SELECT 'nested', 'low' FROM z, last WHERE metric = 'alerts_count' AND v < 9 AND z > 0.001""",
)
def rca_triggers(t):
    return C.fired(model_series(t), RCA_TRIGGERS)


@query(
    "rca_default_triggers",
    f"""WITH {DAILY_MODEL_SQL}, last AS (SELECT metric, arg_max(value, ts) AS v FROM series GROUP BY 1),
    l10 AS (SELECT value, 10 - row_number() OVER (ORDER BY ts DESC) AS x FROM series WHERE metric = 'latency_ms' QUALIFY row_number() OVER (ORDER BY ts DESC) <= 10)
    SELECT 'critical_performance' AS trigger_id, 'critical' AS severity FROM last WHERE metric = 'accuracy' AND v < 0.75
    UNION ALL SELECT 'sustained_latency', 'high' FROM (SELECT regr_slope(value, x) AS s FROM l10) WHERE s > 0.1
    UNION ALL SELECT 'multiple_alerts', 'medium' FROM last a, last b WHERE a.metric = 'alerts_count' AND a.v > 5 AND b.metric = 'accuracy' AND b.v < 0.8""",
)
def rca_default_triggers(t):
    return C.fired(model_series(t))


@query(
    "alert_process_metrics",
    f"""WITH {DAILY_MODEL_SQL} SELECT 'alerting' AS system, 'performance_degradation' AS item, count(*) AS n FROM daily WHERE accuracy < 0.85 HAVING count(*) > 0
    UNION ALL SELECT 'alerting', 'high_latency', count(*) FROM daily WHERE latency_ms > 200 HAVING count(*) > 0
    UNION ALL SELECT 'alerting', 'data_drift', count(*) FROM daily WHERE drift_score > 0.1 HAVING count(*) > 0
    UNION ALL SELECT 'root_cause', 'low_accuracy', 1 FROM (SELECT arg_max(accuracy, ts) AS v FROM daily) WHERE v < 0.95""",
)
def alert_process_metrics(t):
    trigger = {"trigger_id": "low_accuracy", "conditions": {"type": "threshold", "metric": "accuracy", "threshold": 0.95, "operator": "<"}}
    return A.process_metrics(
        model_daily(t), ["accuracy", "latency_ms", "drift_score", "alerts_count"], A.DEFAULT_RULES, C.fired(model_series(t), [trigger])
    )


@query(
    "alert_process_metrics_cooldown",
    f"""WITH RECURSIVE {FIRED_SQL}, due AS (SELECT DISTINCT 'rep' || c_nationkey AS report_id FROM customer WHERE c_nationkey % 5 <> 0)
    SELECT 'alerting' AS system, rule_id AS item, count(*) AS n FROM fired GROUP BY 2 UNION ALL SELECT 'reporting', report_id, 1 FROM due""",
)
def alert_process_metrics_cooldown(t):
    """Events as a wide table of metrics through rules with cooldown, next to the reports that are due."""
    names = ["error", "click", "view"]
    wide = t.events.select("ts", "event_id", *[F.when(F.col("event_type") == n, F.col("value")).alias(n) for n in names])
    key = F.concat(F.lit("rep"), F.col("c_nationkey").cast("string"))
    configs = t.customer.select(key.alias("report_id"), F.lit("daily").alias("frequency"), F.lit("09:00").alias("at"), (F.col("c_nationkey") % 5 != 0).alias("enabled")).distinct()
    due = R.due(configs, F.lit("2024-01-01 09:02:00").cast("timestamp"))
    return A.process_metrics(wide, names, RULES, due_reports=due, tiebreak="event_id")


# hourly means per event type as metric series
HOURLY_SQL = """hourly AS (SELECT event_type AS metric, date_trunc('day', ts) AS ts, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2)"""


def hourly(t):
    return t.events.groupBy(
        F.col("event_type").alias("metric"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query(
    "rca_collect",
    f"""WITH {HOURLY_SQL} SELECT 'performance' AS source, 'performance_' || metric AS metric, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM hourly WHERE ts >= TIMESTAMP '2024-01-20'
    UNION ALL SELECT 'system', 'system_' || metric, strftime(ts, '%Y-%m-%d %H:%M:%S'), n::DOUBLE FROM hourly WHERE ts >= TIMESTAMP '2024-01-20'""",
)
def rca_collect(t):
    h = hourly(t)
    sources = [("performance", h), ("system", h.select("metric", "ts", F.col("n").cast("double").alias("value")))]
    return tidy(C.collect(sources, F.lit("2024-01-20").cast("timestamp")))


CORR_SQL = f"""{HOURLY_SQL}, pairs AS (SELECT a.metric AS metric1, b.metric AS metric2, count(*) AS n, corr(a.value, b.value) AS r
  FROM hourly a JOIN hourly b ON a.ts = b.ts AND a.metric <> b.metric GROUP BY 1, 2 HAVING count(*) > 10)"""
STRENGTH_SQL = "CASE WHEN abs(r) > 0.8 THEN 'strong' WHEN abs(r) > 0.7 THEN 'moderate' END"


@query(
    "rca_correlations",
    f"WITH {CORR_SQL} SELECT metric1, metric2, n, round(r, 6) AS correlation, {STRENGTH_SQL} AS strength FROM pairs",
)
def rca_correlations(t):
    return tidy(C.correlations(hourly(t), symmetric=True))


ANOMALY_SQL = f"""{HOURLY_SQL}, st AS (SELECT metric, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM hourly GROUP BY 1),
  zz AS (SELECT h.*, m, s, abs(value - m) / s AS z, row_number() OVER (PARTITION BY h.metric ORDER BY h.ts) - 1 AS pos FROM hourly h JOIN st USING (metric) WHERE st.n > 10 AND s > 0),
  an AS (SELECT * FROM zz WHERE z > 1.5 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY z DESC, ts) = 1)"""


@query(
    "rca_anomalies",
    f"""WITH {ANOMALY_SQL} SELECT metric, CASE WHEN value > m THEN 'spike' ELSE 'drop' END AS anomaly_type, round(z, 6) AS severity, round(least(0.95, z / 5), 6) AS confidence,
    round(value, 6) AS anomaly_value, round(m, 6) AS mean_value, round(s, 6) AS std_value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS anomaly_ts, pos AS position FROM an""",
)
def rca_anomalies(t):
    return tidy(C.anomalies(hourly(t), limit=1.5))


# causes: anomalies and correlations of user-level series, busy "system" series, failed orders as deployments
CAUSE_SQL = """se AS (SELECT 'u' || (user_id % 4) AS metric, date_trunc('day', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2),
  both_s AS (SELECT * FROM se UNION ALL SELECT 'total', ts, sum(value) FROM se GROUP BY ts),
  st AS (SELECT metric, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM both_s GROUP BY 1),
  an AS (SELECT b.metric, max(abs(value - m) / s) AS z, arg_max(CASE WHEN value > m THEN 'spike' ELSE 'drop' END, abs(value - m) / s) AS k FROM both_s b JOIN st USING (metric) WHERE st.n > 10 AND s > 0 GROUP BY 1),
  pr AS (SELECT a.metric AS m1, b.metric AS m2, corr(a.value, b.value) AS r FROM both_s a JOIN both_s b ON a.ts = b.ts AND a.metric <> b.metric GROUP BY 1, 2 HAVING count(*) > 10),
  causes AS (SELECT 'anomaly' AS type, metric AS metrics, 'Significant ' || k || ' detected in ' || metric AS description, z AS severity, least(0.95, z / 5) AS confidence FROM an WHERE z > 3
    UNION ALL SELECT 'correlation', m1 || ',' || m2, 'Strong correlation between ' || m1 || ' and ' || m2, abs(r), 0.8 FROM pr WHERE abs(r) > 0.8
    UNION ALL SELECT 'system', 'system_' || metric, 'High ' || metric || ' usage detected', m / 100, 0.7 FROM st WHERE m > 90
    UNION ALL SELECT 'deployment', '', 'Recent failed deployments detected: ' || count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'F') * 1.0 / count(*), 0.8 FROM orders)"""


def cause_table(t):
    per = t.events.groupBy(
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("metric"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"),
    ).agg(F.sum("value").alias("value"))
    series = per.unionByName(per.groupBy("ts").agg(F.sum("value").alias("value")).withColumn("metric", F.lit("total")))
    deployed = t.orders.select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"))
    return C.root_causes(C.anomalies(series), C.correlations(series, symmetric=True), series, deployed)


@query(
    "rca_root_causes",
    f"WITH {CAUSE_SQL} SELECT type, metrics, description, round(severity, 5) AS severity, round(confidence, 5) AS confidence FROM causes",
)
def rca_root_causes(t):
    return tidy(cause_table(t).withColumn("metrics", F.concat_ws(",", "metrics")), 5)


IMPACT_SQL = f"""{CAUSE_SQL}, sc AS (SELECT avg(severity) * avg(confidence) AS s, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(string_split(metrics, ',')) AS x FROM causes) WHERE x <> '') AS affected FROM causes)"""


@query(
    "rca_impact",
    f"""WITH {IMPACT_SQL} SELECT CASE WHEN s > 0.8 THEN 'critical' WHEN s > 0.6 THEN 'high' WHEN s > 0.4 THEN 'medium' ELSE 'low' END AS overall_impact, round(s, 5) AS impact_score,
    CASE WHEN s > 0.8 THEN 'severe' WHEN s > 0.6 THEN 'significant' WHEN s > 0.4 THEN 'moderate' ELSE 'minimal' END AS business_impact,
    CASE WHEN s > 0.8 THEN 'days' WHEN s > 0.4 THEN 'hours' ELSE 'immediate' END AS recovery_time, affected AS affected_metrics FROM sc""",
)
def rca_impact(t):
    return tidy(C.impact(cause_table(t)).withColumn("affected_metrics", F.concat_ws(",", "affected_metrics")), 5)


@query(
    "rca_recommendations",
    f"""WITH {IMPACT_SQL} SELECT unnest(CASE type WHEN 'anomaly' THEN ['Investigate the anomaly in ' || metrics, 'Consider implementing anomaly detection alerts']
      WHEN 'correlation' THEN ['Investigate the relationship between ' || replace(metrics, ',', ' and '), 'Consider if this correlation indicates a causal relationship']
      WHEN 'system' THEN ['Monitor ' || metrics || ' more closely', 'Consider scaling resources if usage remains high']
      ELSE ['Review recent deployment failures', 'Implement deployment rollback procedures', 'Add deployment health checks'] END) AS recommendation FROM causes
    UNION ALL SELECT unnest(['Implement immediate monitoring and alerting', 'Consider rolling back recent changes', 'Schedule incident review meeting']) FROM sc WHERE s > 0.6""",
)
def rca_recommendations(t):
    causes = cause_table(t)
    return C.recommendations(causes, C.impact(causes))


@query(
    "rca_investigation",
    f"""WITH {CORR_SQL}, st AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS s FROM hourly GROUP BY 1 HAVING count(*) > 10 AND stddev_pop(value) > 0),
    an AS (SELECT h.metric, max(abs(value - m) / s) AS z FROM hourly h JOIN st USING (metric) GROUP BY 1),
    causes AS (SELECT z AS severity, least(0.95, z / 5) AS confidence FROM an WHERE z > 3 UNION ALL SELECT abs(r), 0.8 FROM pairs WHERE abs(r) > 0.8),
    t AS (SELECT count(*) AS c, coalesce(avg(severity) * avg(confidence), 0) AS s FROM causes)
    SELECT 'correlations' AS result, (SELECT count(*) FROM pairs) AS n UNION ALL SELECT 'anomalies', count(*) FROM an WHERE z > 2.5 UNION ALL SELECT 'causes', c FROM t
    UNION ALL SELECT 'impact', 1 UNION ALL SELECT 'recommendations', 2 * c + CASE WHEN s > 0.6 THEN 3 WHEN c = 0 THEN {len(C.CALM_ADVICE)} ELSE 0 END FROM t""",
)
def rca_investigation(t):
    """Whole chain on one window of the event series: number of rows of each result."""
    h = hourly(t).select("metric", "ts", "value")
    done = C.investigate([("performance", h)], F.lit("2024-01-01").cast("timestamp"))
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("result"), "n")
        for name, df in (("correlations", done.correlations), ("anomalies", done.anomalies), ("causes", done.causes),
                         ("impact", done.impact), ("recommendations", done.recommendations))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "rca_investigation_log",
    ORACLES["rca_triggers"].replace("SELECT 'critical_performance' AS trigger_id, 'critical' AS severity", "SELECT trigger_id, severity, 'rca_' || trigger_id || '_20240201_120000' AS investigation_id, 'completed' AS status, '2024-02-01 12:00:00' AS created_at, true AS timed FROM (SELECT 'critical_performance' AS trigger_id, 'critical' AS severity") + ")",
)
def rca_investigation_log(t):
    """One row per fired trigger, written with the parts of its investigation; asked twice, it is made once."""
    path, now = scratch(t.spark), datetime(2024, 2, 1, 12, tzinfo=timezone.utc)
    triggers = C.fired(model_series(t), RCA_TRIGGERS)
    for _ in range(2):
        C.log_investigations(t.spark, path, triggers, [("performance", hourly(t).select("metric", "ts", "value"))], F.lit("2024-01-01").cast("timestamp"), now)
    log = C.investigation_log(t.spark, path)
    return tidy(log.select("trigger_id", "severity", "investigation_id", "status", "created_at", ((F.col("started_at") <= F.col("completed_at")) & F.col("error").isNull()).alias("timed")))


INVESTIGATION_SQL = """inv AS (SELECT 'i' || o_orderkey AS investigation_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'in_progress' END AS status,
  CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'low' END AS severity, o_orderdate AS created_at, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_minutes((o_custkey % 90)::INT) END AS completed_at FROM orders)"""


def investigations(t):
    s = F.col("o_orderstatus")
    at = F.col("o_orderdate").cast("timestamp")
    return t.orders.select(
        F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("investigation_id"),
        F.when(s == "F", "failed").when(s == "O", "completed").otherwise("in_progress").alias("status"),
        F.when(F.col("o_orderpriority") < "3", "high").otherwise("low").alias("severity"),
        at.alias("created_at"), at.alias("started_at"),
        F.when(s != "P", at + F.make_dt_interval(mins=(F.col("o_custkey") % 90).cast("int"))).alias("completed_at"),
    )


@query(
    "rca_summary",
    f"""WITH {INVESTIGATION_SQL}, i AS (SELECT *, epoch(completed_at) - epoch(started_at) AS d FROM inv WHERE created_at >= TIMESTAMP '1996-01-01')
    SELECT 'total' AS dimension, NULL AS value, count(*) AS n, round(avg(d), 4) AS mean_seconds FROM i
    UNION ALL SELECT 'status', status, count(*), round(avg(d), 4) FROM i GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*), round(avg(d), 4) FROM i GROUP BY 2""",
)
def rca_summary(t):
    return tidy(C.summary(investigations(t), F.lit("1996-01-01").cast("timestamp")), 4)


@query(
    "rca_recent",
    f"WITH {INVESTIGATION_SQL} SELECT investigation_id, status FROM inv ORDER BY created_at DESC, investigation_id DESC LIMIT 10",
)
def rca_recent(t):
    return C.recent(investigations(t)).select("investigation_id", "status")


@query(
    "threshold_operators",
    "SELECT event_id, "
    + ", ".join(f"value {o} 25.0 AS {n}" for o, n in ((">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le"), ("=", "eq"), ("<>", "ne")))
    + ", false AS unknown FROM events",
)
def threshold_operators(t):
    x = F.col("value")
    names = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "==": "eq", "!=": "ne", "~": "unknown"}
    return t.events.select("event_id", *[compare(o, x, F.lit(25.0)).alias(n) for o, n in names.items()])


# ---- reports ----

REPORT_QUERIES = [
    {"query_id": "a1", "query_type": "aggregation", "metric": "click", "aggregation": "mean"},
    {"query_id": "a2", "query_type": "aggregation", "metric": "click", "aggregation": "median"},
    {"query_id": "a3", "query_type": "aggregation", "metric": "view", "aggregation": "std"},
    {"query_id": "a4", "query_type": "aggregation", "metric": "view", "aggregation": "min"},
    {"query_id": "a5", "query_type": "aggregation", "metric": "view", "aggregation": "max"},
    {"query_id": "a6", "query_type": "aggregation", "metric": "view", "aggregation": "odd"},
    {"query_id": "t1", "query_type": "trend", "metric": "error", "window_size": 10},
    {"query_id": "c1", "query_type": "correlation", "metric1": "click", "metric2": "view"},
    {"query_id": "x1", "query_type": "custom", "sql": "SELECT 'rows' AS name, count(*) AS value FROM {series}"},
    {"query_id": "off", "query_type": "trend", "metric": "error", "enabled": False},
    {"query_id": "skipped", "query_type": "no_such_kind"},
]


@query(
    "report_queries",
    f"""WITH {HOURLY_SQL}, l10 AS (SELECT value, 10 - row_number() OVER (ORDER BY ts DESC) AS x FROM hourly WHERE metric = 'error' QUALIFY row_number() OVER (ORDER BY ts DESC) <= 10),
    t AS (SELECT regr_slope(value, x) AS s FROM l10), r AS (SELECT corr(a.value, b.value) AS r FROM hourly a JOIN hourly b ON a.ts = b.ts AND a.metric = 'click' AND b.metric = 'view')
    SELECT 'a1' AS query_id, 'aggregation' AS query_type, 'click' AS metric, NULL AS metric2, 'mean' AS name, round(avg(value), 6) AS value, NULL AS note FROM hourly WHERE metric = 'click'
    UNION ALL SELECT 'a2', 'aggregation', 'click', NULL, 'median', round(quantile_cont(value, 0.5), 6), NULL FROM hourly WHERE metric = 'click'
    UNION ALL SELECT 'a3', 'aggregation', 'view', NULL, 'std', round(stddev_pop(value), 6), NULL FROM hourly WHERE metric = 'view'
    UNION ALL SELECT 'a4', 'aggregation', 'view', NULL, 'min', round(min(value), 6), NULL FROM hourly WHERE metric = 'view'
    UNION ALL SELECT 'a5', 'aggregation', 'view', NULL, 'max', round(max(value), 6), NULL FROM hourly WHERE metric = 'view'
    UNION ALL SELECT 'a6', 'aggregation', 'view', NULL, 'odd', round(avg(value), 6), NULL FROM hourly WHERE metric = 'view'
    UNION ALL SELECT 't1', 'trend', 'error', NULL, 'slope', round(s, 6), CASE WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END FROM t
    UNION ALL SELECT 'c1', 'correlation', 'click', 'view', 'correlation', round(r, 6), CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END FROM r
    UNION ALL SELECT 'x1', 'custom', NULL, NULL, 'rows', count(*)::DOUBLE, NULL FROM hourly""",
)
def report_queries(t):
    return tidy(R.run_queries(hourly(t), REPORT_QUERIES))


@query(
    "report_data",
    f"""WITH {DAILY_MODEL_SQL} SELECT source, metric, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM series
    WHERE source IN ('performance', 'quality') AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'""",
)
def report_data(t):
    limits = [F.lit(x).cast("timestamp") for x in ("1996-01-01", "1997-12-31")]
    return tidy(R.report_data(model_series(t), ["performance", "quality"], *limits))


@query(
    "report_insights",
    f"""WITH {DAILY_MODEL_SQL}, s AS (SELECT avg(accuracy) AS a, max(drift_score) AS d FROM daily), n AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P')
    SELECT 'key_insight' AS kind, printf('Average accuracy: %.3f', a) AS text FROM s UNION ALL SELECT 'recommendation', 'Consider model retraining due to low accuracy' FROM s WHERE a < 0.9
    UNION ALL SELECT 'key_insight', printf('Maximum drift score: %.3f', d) FROM s UNION ALL SELECT 'recommendation', 'High data drift detected - investigate data quality' FROM s WHERE d > 0.1
    UNION ALL SELECT 'key_insight', 'Active alerts: ' || n FROM n UNION ALL SELECT 'recommendation', 'High number of active alerts - review system health' FROM n WHERE n > 5""",
)
def report_insights(t):
    alerts = t.orders.select(F.when(F.col("o_orderstatus") == "P", "active").otherwise("resolved").alias("status"))
    return R.insights(model_series(t), alerts)


@query(
    "report_chart_series",
    """SELECT event_type AS metric, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, round(avg(value), 6) AS value FROM events
    WHERE event_type IN ('click', 'view') GROUP BY 1, 2""",
)
def report_chart_series(t):
    return tidy(R.chart_series(metric_events(t), ["click", "view"]))


@query(
    "report_chart_counts",
    """WITH n AS (SELECT count(*) AS t FROM orders) SELECT 'total' AS dimension, NULL AS value, t AS n, 100.0::DOUBLE AS percent FROM n
    UNION ALL SELECT 'severity', o_orderpriority, count(*), round(count(*) * 100.0 / any_value(t), 6) FROM orders, n GROUP BY 2
    UNION ALL SELECT 'type', o_orderstatus, count(*), round(count(*) * 100.0 / any_value(t), 6) FROM orders, n GROUP BY 2""",
)
def report_chart_counts(t):
    alerts = t.orders.select(F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("type"))
    return tidy(R.chart_counts(alerts, ["severity", "type"]))


CONFIG_SQL = """configs AS (SELECT 'rep' || c_custkey AS report_id, CASE c_custkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS frequency,
  lpad((c_custkey % 24)::VARCHAR, 2, '0') || ':' || lpad((c_custkey % 60)::VARCHAR, 2, '0') AS due_at, c_nationkey % 5 <> 0 AS enabled, c_mktsegment AS report_type FROM customer)"""


def report_configs(t):
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return t.customer.select(
        F.concat(F.lit("rep"), k.cast("string")).alias("report_id"),
        F.when(k % 3 == 0, "daily").when(k % 3 == 1, "weekly").otherwise("monthly").alias("frequency"),
        F.concat(two(k % 24), F.lit(":"), two(k % 60)).alias("at"),
        (F.col("c_nationkey") % 5 != 0).alias("enabled"), F.col("c_mktsegment").alias("report_type"),
    )


@query(
    "report_due",
    f"""WITH {CONFIG_SQL} SELECT report_id FROM configs WHERE enabled AND abs(9 * 3600 + 120 - (split_part(due_at, ':', 1)::INT * 60 + split_part(due_at, ':', 2)::INT) * 60) < 300
      AND frequency IN ('daily', 'weekly', 'monthly')""",
)
def report_due(t):
    # 2024-01-01 is a Monday and the first of the month: every frequency can be due
    return R.due(report_configs(t), F.lit("2024-01-01 09:02:00").cast("timestamp")).select("report_id")


@query(
    "report_summary",
    f"""WITH {CONFIG_SQL} SELECT 'total_configs' AS dimension, NULL AS value, count(*) AS n FROM configs UNION ALL SELECT 'active_configs', NULL, count(*) FILTER (enabled) FROM configs
    UNION ALL SELECT 'report_type', report_type, count(*) FROM configs GROUP BY 2 UNION ALL SELECT 'total_generated', NULL, count(*) FROM orders""",
)
def report_summary(t):
    return R.summary(report_configs(t), t.orders)


@query(
    "report_recent",
    "SELECT 'g' || o_orderkey AS report_id FROM orders ORDER BY o_orderdate DESC, 'g' || o_orderkey DESC LIMIT 10",
)
def report_recent(t):
    made = t.orders.select(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("report_id"), F.col("o_orderdate").alias("generated_at"))
    return R.recent(made).select("report_id")
