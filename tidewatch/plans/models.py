"""Queries over model performance, A/B tests and lifecycle, on predictions derived from ``lineitem`` and ``events``."""

from pyspark.sql import functions as F

from tidewatch.operators import abtest as B
from tidewatch.operators import lifecycle as L
from tidewatch.operators import performance as M
from tidewatch.plans.registry import ORACLES, query, rnd, stamp, tidy

PRED_SQL = """pred AS (SELECT 'm' || (l_suppkey % 10) AS model_id, strftime(l_shipdate, '%Y-%m') AS batch_id, l_shipdate AS ts,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y_true, CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS y_pred,
  l_discount AS score, l_quantity + 10 * l_tax AS latency_ms, l_extendedprice AS price, l_quantity * 1500 AS guess, l_returnflag, l_linestatus
  FROM lineitem)"""


def predictions(t):
    return t.lineitem.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")).alias("model_id"),
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM").alias("batch_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y_true"),
        F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("y_pred"),
        F.col("l_discount").alias("score"),
        (F.col("l_quantity") + 10 * F.col("l_tax")).alias("latency_ms"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_quantity") * 1500).alias("guess"),
        "l_returnflag",
        "l_linestatus",
    )


def class_sql(keys: str, src: str = "pred", yt: str = "y_true", yp: str = "y_pred", name: str = "cls") -> str:
    """Weighted scores per key, from per-class counts."""
    return f"""{name}_c AS (SELECT {keys}, c, sum(s) AS s, sum(p) AS p, sum(tp) AS tp FROM (
        SELECT {keys}, {yt} AS c, 1 AS s, 0 AS p, CASE WHEN {yt} = {yp} THEN 1 ELSE 0 END AS tp FROM {src}
        UNION ALL SELECT {keys}, {yp}, 0, 1, 0 FROM {src}) GROUP BY {keys}, c),
    {name}_r AS (SELECT *, coalesce(tp * 1.0 / nullif(p, 0), 0) AS pr, coalesce(tp * 1.0 / nullif(s, 0), 0) AS re FROM {name}_c),
    {name} AS (SELECT {keys}, sum(tp) * 1.0 / sum(s) AS accuracy, sum(pr * s) / sum(s) AS "precision", sum(re * s) / sum(s) AS recall,
        sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * s) / sum(s) AS f1_score FROM {name}_r GROUP BY {keys})"""


def auc_sql(keys: str, score: str, src: str = "pred", name: str = "auc") -> str:
    part = f"PARTITION BY {keys}"
    return f"""{name}_k AS (SELECT {keys}, y_true, max(y_true) OVER ({part}) AS hi, min(y_true) OVER ({part}) AS lo,
        rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({part}, {score}) - 1) / 2.0 AS r FROM {src}),
    {name} AS (SELECT {keys}, CASE WHEN max(hi) = min(lo) THEN 0.0 ELSE (sum(r) FILTER (y_true = hi) - count(*) FILTER (y_true = hi)
        * (count(*) FILTER (y_true = hi) + 1) / 2.0) / (count(*) FILTER (y_true = hi) * 1.0 * count(*) FILTER (y_true < hi)) END AS auc_score
        FROM {name}_k GROUP BY {keys})"""


METRIC_OUT = """round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1_score, 6) AS f1_score"""


@query(
    "perf_classification_by_model",
    f"WITH {PRED_SQL}, {class_sql('model_id')} SELECT model_id, {METRIC_OUT} FROM cls",
)
def perf_classification_by_model(t):
    return tidy(M.classification(predictions(t), ["model_id"]))


@query(
    "perf_classification_multiclass",
    f"WITH {PRED_SQL}, m AS (SELECT model_id, l_returnflag AS y_true, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS y_pred FROM pred), "
    f"{class_sql('model_id', 'm')} SELECT model_id, {METRIC_OUT} FROM cls",
)
def perf_classification_multiclass(t):
    p = predictions(t).select(
        "model_id", F.col("l_returnflag").alias("y_true"),
        F.when(F.col("l_linestatus") == "O", "N").otherwise("A").alias("y_pred"),
    )
    return tidy(M.classification(p, ["model_id"]))


@query(
    "perf_auc",
    f"WITH {PRED_SQL}, {auc_sql('model_id', 'score')} SELECT model_id, round(auc_score, 6) AS auc_score FROM auc",
)
def perf_auc(t):
    return tidy(M.auc(predictions(t), ["model_id"], "score"))


@query(
    "perf_auc_labels",
    f"""WITH pred AS (SELECT lang, quality AS y_true, n_chars AS score FROM labels JOIN documents USING (doc_id)),
    {auc_sql('lang', 'score')} SELECT lang, round(auc_score, 6) AS auc_score FROM auc""",
)
def perf_auc_labels(t):
    p = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", F.col("quality").alias("y_true"), F.col("n_chars").alias("score")
    )
    return tidy(M.auc(p, ["lang"], "score"))


REGRESSION_SQL = """reg AS (SELECT {k}, avg((price - guess) ** 2) AS mse, avg(abs(price - guess)) AS mae,
  greatest(max(price), max(guess)) - least(min(price), min(guess)) AS span FROM pred GROUP BY {k})"""


@query(
    "perf_regression",
    f"""WITH {PRED_SQL}, {REGRESSION_SQL.format(k='model_id')} SELECT model_id, round(mse, 4) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
    round(1 - sqrt(mse) / span, 6) AS accuracy, round(1 - mae / span, 6) AS "precision", round(1 - sqrt(mse) / span, 6) AS recall,
    round(1 - sqrt(mse) / span, 6) AS f1_score, round(1 - sqrt(mse) / span, 6) AS auc_score FROM reg""",
)
def perf_regression(t):
    p = predictions(t).withColumn("y_true", F.col("price")).withColumn("y_pred", F.col("guess"))
    return tidy(M.regression(p, ["model_id"]).withColumn("mse", F.round("mse", 4)))


BATCH_SQL = f"""{PRED_SQL}, {class_sql('model_id, batch_id')}, {auc_sql('model_id, batch_id', 'y_pred')},
  batches AS (SELECT model_id, batch_id, max(ts) AS ts, avg(latency_ms) AS latency_ms FROM pred GROUP BY 1, 2),
  metrics AS (SELECT *, CASE WHEN latency_ms > 0 THEN 1000.0 / latency_ms ELSE 0 END AS throughput_rps
    FROM batches JOIN cls USING (model_id, batch_id) JOIN auc USING (model_id, batch_id))"""
ALL_METRICS = METRIC_OUT + """, round(auc_score, 6) AS auc_score, round(latency_ms, 6) AS latency_ms, round(throughput_rps, 6) AS throughput_rps"""
STAMP_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


@query(
    "perf_batch_metrics",
    f"WITH {BATCH_SQL} SELECT model_id, batch_id, {STAMP_SQL.format(c='ts')} AS ts, {ALL_METRICS} FROM metrics",
)
def perf_batch_metrics(t):
    return tidy(M.batch_metrics(predictions(t)))


@query(
    "perf_metrics_by_model_type",
    f"""WITH {BATCH_SQL}, {REGRESSION_SQL.format(k='model_id, batch_id')}, typed AS (
      SELECT model_id, batch_id, accuracy, auc_score FROM metrics WHERE model_id <= 'm3'
      UNION ALL SELECT model_id, batch_id, CASE WHEN span = 0 THEN 1 ELSE 1 - sqrt(mse) / span END, CASE WHEN span = 0 THEN 1 ELSE 1 - sqrt(mse) / span END FROM reg WHERE model_id BETWEEN 'm4' AND 'm6'
      UNION ALL SELECT DISTINCT model_id, batch_id, 0.5, 0.5 FROM pred WHERE model_id > 'm6')
    SELECT model_id, batch_id, round(accuracy, 6) AS accuracy, round(auc_score, 6) AS auc_score FROM typed""",
)
def perf_metrics_by_model_type(t):
    m = F.col("model_id")
    p = predictions(t)
    p = p.withColumn("y_true", F.when(m.between("m4", "m6"), F.col("price")).otherwise(F.col("y_true"))).withColumn(
        "y_pred", F.when(m.between("m4", "m6"), F.col("guess")).otherwise(F.col("y_pred"))
    )
    models = p.select("model_id").distinct().withColumn(
        "model_type",
        F.when(m <= "m3", "classification").when(m <= "m6", "regression").otherwise("clustering"),
    )
    return tidy(M.metrics_by_model_type(p, models).select("model_id", "batch_id", "accuracy", "auc_score"))


def thresholds(t, metrics):
    """Alert limits of every model seen in the data."""
    limits = F.array(*[
        F.struct(F.lit(n).alias("metric_name"), F.lit(v).alias("threshold_value"))
        for n, v in (("accuracy", 0.52), ("latency_ms", 27.0), ("f1_score", 0.5))
    ])
    return metrics.select("model_id").distinct().select("model_id", F.inline(limits))


BREACH_SQL = """breaches AS (SELECT model_id, batch_id, ts, 'accuracy' AS metric_name, accuracy AS current_value, 0.52::DOUBLE AS threshold_value FROM metrics WHERE accuracy < 0.52
  UNION ALL SELECT model_id, batch_id, ts, 'latency_ms', latency_ms, 27.0::DOUBLE FROM metrics WHERE latency_ms > 27
  UNION ALL SELECT model_id, batch_id, ts, 'f1_score', f1_score, 0.5::DOUBLE FROM metrics WHERE f1_score < 0.5)"""


@query(
    "perf_threshold_alerts",
    f"""WITH {BATCH_SQL}, {BREACH_SQL} SELECT model_id, batch_id, metric_name, round(current_value, 6) AS current_value, threshold_value,
    'threshold_breach' AS alert_type, 'warning' AS severity FROM breaches""",
)
def perf_threshold_alerts(t):
    m = M.batch_metrics(predictions(t))
    return tidy(M.threshold_alerts(m, thresholds(t, m)).drop("ts", "message"))


DEGRADE_SQL = """w AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts, batch_id) AS rn,
    avg(accuracy) OVER f AS ba, avg(latency_ms) OVER f AS bl FROM metrics
    WINDOW f AS (PARTITION BY model_id ORDER BY ts, batch_id ROWS BETWEEN 10 PRECEDING AND 2 PRECEDING)),
  degraded AS (SELECT model_id, batch_id, ts, 'accuracy' AS metric_name, accuracy AS current_value, ba AS threshold_value, (ba - accuracy) / ba AS degradation_pct FROM w WHERE rn > 10 AND ba > 0 AND (ba - accuracy) / ba > 0.1
  UNION ALL SELECT model_id, batch_id, ts, 'latency', latency_ms, bl, (latency_ms - bl) / bl FROM w WHERE rn > 10 AND bl > 0 AND (latency_ms - bl) / bl > 0.2)"""


@query(
    "perf_degradation_alerts",
    f"""WITH {BATCH_SQL}, {DEGRADE_SQL} SELECT model_id, batch_id, metric_name, round(current_value, 6) AS current_value,
    round(threshold_value, 6) AS threshold_value, round(degradation_pct, 6) AS degradation_pct, 'degradation' AS alert_type, 'error' AS severity FROM degraded""",
)
def perf_degradation_alerts(t):
    return tidy(M.degradation_alerts(M.batch_metrics(predictions(t))).drop("ts", "message"))


SUMMARY_SQL = """per_model AS (SELECT model_id, count(*) AS total_predictions, avg(accuracy) AS avg_accuracy, avg("precision") AS avg_precision, avg(recall) AS avg_recall,
  avg(f1_score) AS avg_f1_score, avg(auc_score) AS avg_auc_score, avg(latency_ms) AS avg_latency_ms, avg(throughput_rps) AS avg_throughput_rps,
  min(accuracy) AS min_accuracy, max(accuracy) AS max_accuracy, min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms, max(ts) AS last_updated
  FROM metrics WHERE ts >= TIMESTAMP '1997-01-01' GROUP BY 1)"""


def since():
    return F.lit("1997-01-01").cast("timestamp")


@query(
    "perf_summary",
    f"""WITH {BATCH_SQL}, {SUMMARY_SQL} SELECT model_id, total_predictions, {', '.join(f'round({c}, 6) AS {c}' for c in
    ['avg_accuracy', 'avg_precision', 'avg_recall', 'avg_f1_score', 'avg_auc_score', 'avg_latency_ms', 'avg_throughput_rps', 'min_accuracy', 'max_accuracy', 'min_latency_ms', 'max_latency_ms'])},
    {STAMP_SQL.format(c='last_updated')} AS last_updated FROM per_model""",
)
def perf_summary(t):
    return tidy(M.summary(M.batch_metrics(predictions(t)), since()))


@query(
    "perf_alert_counts",
    f"""WITH {BATCH_SQL}, {BREACH_SQL}, a AS (SELECT model_id, metric_name FROM breaches)
    SELECT model_id, 'total' AS dimension, NULL AS value, count(*) AS n FROM a GROUP BY 1
    UNION ALL SELECT model_id, 'severity', 'warning', count(*) FROM a GROUP BY 1
    UNION ALL SELECT model_id, 'alert_type', 'threshold_breach', count(*) FROM a GROUP BY 1
    UNION ALL SELECT model_id, 'metric_name', metric_name, count(*) FROM a GROUP BY 1, 3""",
)
def perf_alert_counts(t):
    m = M.batch_metrics(predictions(t))
    return tidy(M.alert_counts(M.threshold_alerts(m, thresholds(t, m))))


@query(
    "perf_fleet_summary",
    f"""WITH {BATCH_SQL}, {SUMMARY_SQL}, {BREACH_SQL}, models AS (SELECT DISTINCT 'm' || (s_suppkey % 12) AS model_id FROM supplier),
    c AS (SELECT model_id, count(*) AS n FROM breaches GROUP BY 1)
    SELECT count(*) AS total_models, count(*) FILTER (model_id <> 'm3') AS active_models, round(sum(coalesce(avg_accuracy, 0)) / count(*), 6) AS avg_accuracy,
      round(sum(coalesce(avg_latency_ms, 0)) / count(*), 6) AS avg_latency_ms, sum(coalesce(total_predictions, 0))::BIGINT AS total_predictions,
      sum(coalesce(n, 0))::BIGINT AS total_alerts FROM models LEFT JOIN per_model USING (model_id) LEFT JOIN c USING (model_id)""",
)
def perf_fleet_summary(t):
    m = M.batch_metrics(predictions(t))
    models = t.supplier.select(F.concat(F.lit("m"), (F.col("s_suppkey") % 12).cast("string")).alias("model_id")).distinct()
    models = models.withColumn("enabled", F.col("model_id") != "m3")
    return tidy(M.fleet_summary(models, M.summary(m, since()), M.threshold_alerts(m, thresholds(t, m))))


TREND_NAMES = ("accuracy", "precision", "recall", "f1_score", "latency_ms")


@query(
    "perf_trends",
    f"WITH {BATCH_SQL}, l AS ("
    + " UNION ALL ".join(
        f"""SELECT model_id, '{c}' AS metric_name, regr_slope("{c}", epoch(ts)) AS slope FROM metrics GROUP BY 1 HAVING count(*) > 1"""
        for c in TREND_NAMES
    )
    + """) SELECT model_id, metric_name, round(slope * 1e9, 4) AS slope_e9, CASE WHEN slope > 0 THEN 'improving' ELSE 'degrading' END AS trend_direction,
    CASE WHEN metric_name = 'latency_ms' THEN slope < 0 ELSE slope > 0 END AS is_better FROM l""",
)
def perf_trends(t):
    out = M.trends(M.batch_metrics(predictions(t)))
    return out.select(
        "model_id", "metric_name", rnd(F.col("slope") * 1e9, 4).alias("slope_e9"), "trend_direction", "is_better"
    )


# ---- A/B ----

AB_SQL = """traffic AS (SELECT 'checkout' AS test_id, user_id, ts, event_id, value,
  CASE WHEN ('0x' || substr(md5('checkout:' || user_id), 1, 8))::BIGINT % 100 < 50 THEN 'B' ELSE 'A' END AS assigned_model FROM events)"""


def ab_traffic(t):
    return B.assign(t.events.select("user_id", "ts", "event_id", "value"), "checkout")


@query(
    "ab_assignment",
    """SELECT user_id, CASE WHEN ('0x' || substr(md5('t30:' || user_id), 1, 8))::BIGINT % 100 < 30 THEN 'B' ELSE 'A' END AS assigned_model,
       'A' AS disabled_model FROM (SELECT DISTINCT user_id FROM events)""",
)
def ab_assignment(t):
    users = t.events.select("user_id").distinct()
    return users.select(
        "user_id", B.arm("t30", "user_id", 0.3).alias("assigned_model"), B.arm("t30", "user_id", 0.3, False).alias("disabled_model")
    )


AB_JOIN_SQL = """asg AS (SELECT test_id, user_id, arg_max(assigned_model, event_id) AS assigned_model FROM (
    SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS test_id, user_id, event_id,
      CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'A' END AS assigned_model FROM events WHERE event_type = 'view') GROUP BY 1, 2),
  p AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS test_id, user_id, event_id, value,
    strftime(ts, '%d') AS batch_id, CASE WHEN value > 40 THEN 1 ELSE 0 END AS y_true, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS y_pred
    FROM events WHERE event_type = 'purchase')"""


def ab_attached(t):
    e = t.events.withColumn("test_id", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    traffic = e.filter(F.col("event_type") == "view").select(
        "test_id", "user_id", F.when(F.col("event_id") % 3 == 0, "B").otherwise("A").alias("assigned_model"),
        F.col("event_id").alias("ts"),
    )
    preds = e.filter(F.col("event_type") == "purchase").select(
        "test_id", "user_id", "event_id", "value", F.date_format(F.col("ts").cast("timestamp"), "dd").alias("batch_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") > 40, 1).otherwise(0).alias("y_true"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(0).alias("y_pred"), F.col("value").alias("latency_ms"),
    )
    return B.attach_results(preds, traffic)


@query(
    "ab_attach_results",
    f"WITH {AB_JOIN_SQL} SELECT p.test_id, p.user_id, event_id, assigned_model FROM p JOIN asg USING (test_id, user_id)",
)
def ab_attach_results(t):
    return ab_attached(t)[0].select("test_id", "user_id", "event_id", "assigned_model")


@query(
    "ab_rejected_results",
    f"WITH {AB_JOIN_SQL} SELECT p.test_id, p.user_id, event_id FROM p LEFT JOIN asg USING (test_id, user_id) WHERE assigned_model IS NULL",
)
def ab_rejected_results(t):
    return ab_attached(t)[1].select("test_id", "user_id", "event_id")


@query(
    "ab_arm_means",
    f"""WITH {AB_JOIN_SQL}, pred AS (SELECT test_id, user_id, batch_id, assigned_model, y_true, y_pred, value FROM p JOIN asg USING (test_id, user_id)),
    {class_sql('test_id, user_id, batch_id, assigned_model')}, lat AS (SELECT test_id, user_id, batch_id, assigned_model, avg(value) AS l FROM pred GROUP BY 1, 2, 3, 4)
    SELECT test_id, assigned_model, count(*) AS n, round(avg(accuracy), 6) AS avg_accuracy, round(avg("precision"), 6) AS avg_precision,
    round(avg(recall), 6) AS avg_recall, round(avg(f1_score), 6) AS avg_f1_score, round(avg(l), 6) AS avg_latency_ms
    FROM cls JOIN lat USING (test_id, user_id, batch_id, assigned_model) GROUP BY 1, 2""",
)
def ab_arm_means(t):
    return tidy(B.arm_means(B.result_metrics(ab_attached(t)[0])))


@query(
    "ab_analysis",
    f"""WITH {AB_SQL}, s AS (SELECT test_id, count(*) FILTER (assigned_model = 'A')::DOUBLE AS na, count(*) FILTER (assigned_model = 'B')::DOUBLE AS nb,
      avg(value) FILTER (assigned_model = 'A') AS ma, avg(value) FILTER (assigned_model = 'B') AS mb, var_samp(value) FILTER (assigned_model = 'A') AS va,
      var_samp(value) FILTER (assigned_model = 'B') AS vb, var_pop(value) FILTER (assigned_model = 'A') AS pa, var_pop(value) FILTER (assigned_model = 'B') AS pb
      FROM traffic GROUP BY 1),
    d AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sp, sqrt(pa / na + pb / nb) AS se FROM s),
    e AS (SELECT *, (ma - mb) / (sp * sqrt(1 / na + 1 / nb)) AS t, na + nb - 2 AS df FROM d WHERE na >= 100 AND nb >= 100),
    g AS (SELECT i::DOUBLE AS i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM generate_series(0, 4000) q(i)),
    p AS (SELECT test_id, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * sum(w * (1 + (t * i / 4000) ** 2 / df) ** (-(df + 1) / 2)) * abs(t) / 12000 AS pv
      FROM e, g GROUP BY test_id, t, df)
    SELECT test_id, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, na::BIGINT AS sample_size_a, nb::BIGINT AS sample_size_b, round(t, 6) AS t_statistic,
      round(pv, 6) AS p_value, pv < 0.05 AS statistical_significance, round((mb - ma) / sp, 6) AS effect_size,
      CASE WHEN pv < 0.05 THEN CASE WHEN mb > ma THEN 'B' ELSE 'A' END END AS winner, round(mb - ma - 1.96 * se, 6) AS ci_lower, round(mb - ma + 1.96 * se, 6) AS ci_upper
    FROM e JOIN p USING (test_id)""",
)
def ab_analysis(t):
    return tidy(B.analyze(ab_traffic(t), "value"))


@query(
    "ab_traffic_summary",
    f"""WITH {AB_SQL} SELECT test_id, count(*) AS total_traffic, count(*) FILTER (assigned_model = 'A') AS model_a_traffic,
    count(*) FILTER (assigned_model = 'B') AS model_b_traffic, count(*) FILTER (value > 20) AS traffic_with_results FROM traffic GROUP BY 1""",
)
def ab_traffic_summary(t):
    return B.traffic_summary(ab_traffic(t).withColumn("has_result", F.col("value") > 20))


@query(
    "ab_portfolio",
    """WITH s AS (SELECT event_type AS test_id, count(*) AS n, avg(value) AS m FROM events WHERE event_type <> 'view' GROUP BY 1),
    tests AS (SELECT DISTINCT event_type AS test_id, event_type <> 'click' AS enabled FROM events)
    SELECT count(*) AS total_tests, count(*) FILTER (enabled) AS active_tests, coalesce(sum(n), 0)::BIGINT AS total_traffic,
      count(*) FILTER (m > 45) AS significant_tests, count(*) FILTER (m > 45 AND m <= 50) AS model_a_wins, count(*) FILTER (m > 50) AS model_b_wins
    FROM tests LEFT JOIN s USING (test_id)""",
)
def ab_portfolio(t):
    e = t.events.select(F.col("event_type").alias("test_id"), "value")
    traffic = e.filter(F.col("test_id") != "view")
    mean = F.col("m")
    latest = traffic.groupBy("test_id").agg(F.avg("value").alias("m")).select(
        "test_id", (mean > 45).alias("statistical_significance"), F.when(mean > 50, "B").when(mean > 45, "A").alias("winner")
    )
    tests = e.select("test_id").distinct().withColumn("enabled", F.col("test_id") != "click")
    return tidy(B.portfolio(tests, traffic, latest))


# ---- lifecycle: versions and deployments read from orders ----

VERSION_SQL = """versions AS (SELECT 'm' || (o_custkey % 40) AS model_id, 'v' || o_orderkey AS version, o_orderdate AS created_at FROM orders),
  deployments AS (SELECT 'd' || o_orderkey AS deployment_id, 'm' || (o_custkey % 40) AS model_id, 'v' || o_orderkey AS version,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'pending' END AS status,
    CASE WHEN o_orderpriority < '3' THEN 'production' ELSE 'staging' END AS environment, o_orderdate AS deployed_at FROM orders)"""


def versions(t):
    return t.orders.select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 40).cast("string")).alias("model_id"),
        F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"),
        F.col("o_orderdate").alias("created_at"),
    )


def deployments(t):
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("deployment_id"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 40).cast("string")).alias("model_id"),
        F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"),
        F.when(status == "F", "failed").when(status == "O", "success").otherwise("pending").alias("status"),
        F.when(F.col("o_orderpriority") < "3", "production").otherwise("staging").alias("environment"),
        F.col("o_orderdate").alias("deployed_at"),
    )


@query(
    "lifecycle_register",
    f"""WITH {VERSION_SQL}, c AS (SELECT 'm' || (l_suppkey % 40) AS model_id, 'v' || l_orderkey AS version FROM lineitem)
    SELECT DISTINCT model_id, version FROM c ANTI JOIN versions USING (model_id, version)""",
)
def lifecycle_register(t):
    candidates = t.lineitem.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 40).cast("string")).alias("model_id"),
        F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("version"),
    )
    return L.register(versions(t), candidates)[0]


@query(
    "lifecycle_register_refused",
    f"""WITH {VERSION_SQL}, c AS (SELECT 'm' || (l_suppkey % 40) AS model_id, 'v' || l_orderkey AS version FROM lineitem),
    k AS (SELECT model_id, version, count(*) AS n FROM c GROUP BY 1, 2),
    r AS (SELECT k.model_id, k.version, n - CASE WHEN v.model_id IS NULL THEN 1 ELSE 0 END AS refused
      FROM k LEFT JOIN (SELECT DISTINCT model_id, version FROM versions) v ON k.model_id = v.model_id AND k.version = v.version)
    SELECT model_id, version, refused FROM r WHERE refused > 0""",
)
def lifecycle_register_refused(t):
    candidates = t.lineitem.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 40).cast("string")).alias("model_id"),
        F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("version"),
    )
    return L.register(versions(t), candidates)[1].groupBy("model_id", "version").agg(F.count(F.lit(1)).alias("refused"))


@query(
    "lifecycle_lineage",
    f"""WITH {VERSION_SQL}, v AS (SELECT model_id, count(*) AS total_versions FROM versions GROUP BY 1),
    vl AS (SELECT model_id, version FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, version DESC) AS r FROM versions) WHERE r = 1),
    l AS (SELECT model_id, environment, version FROM (SELECT *, row_number() OVER (PARTITION BY model_id, environment ORDER BY deployed_at DESC, deployment_id DESC) AS r FROM deployments WHERE status = 'success') WHERE r = 1)
    SELECT v.model_id, total_versions, vl.version AS latest_version, (SELECT count(*) FROM deployments d WHERE d.model_id = v.model_id) AS total_deployments,
      p.version AS current_production, s.version AS current_staging
    FROM v JOIN vl USING (model_id) LEFT JOIN l p ON p.model_id = v.model_id AND p.environment = 'production' LEFT JOIN l s ON s.model_id = v.model_id AND s.environment = 'staging'""",
)
def lifecycle_lineage(t):
    return L.lineage(versions(t), deployments(t))


@query(
    "lifecycle_deployment_summary",
    f"""WITH {VERSION_SQL} SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM deployments
    UNION ALL SELECT 'status', status, count(*) FROM deployments GROUP BY 2 UNION ALL SELECT 'environment', environment, count(*) FROM deployments GROUP BY 2""",
)
def lifecycle_deployment_summary(t):
    return L.deployment_summary(deployments(t))


@query(
    "lifecycle_recent_deployments",
    f"WITH {VERSION_SQL} SELECT deployment_id, model_id, status FROM deployments ORDER BY deployed_at DESC, deployment_id DESC LIMIT 10",
)
def lifecycle_recent_deployments(t):
    return L.recent_deployments(deployments(t)).select("deployment_id", "model_id", "status")


NOW = "2001-08-01"


def triggers(t):
    """One trigger of each kind per model, with state taken from the deployments."""
    last = deployments(t).groupBy("model_id").agg(F.max(F.col("deployed_at").cast("timestamp")).alias("last"), F.count(F.lit(1)).alias("n"))
    kinds = F.array(*[
        F.struct(
            F.lit(kind).alias("trigger_type"),
            F.create_map(F.lit("accuracy"), F.lit(0.9), F.lit("recall"), F.lit(0.8)).alias("baseline"),
            F.lit(limit).cast("double").alias("threshold"),
        )
        for kind, limit in (("performance", 0.43), ("data_drift", 0.25), ("scheduled", None), ("unknown", 0.0))
    ])
    return last.select("model_id", "last", "n", F.inline(kinds)).select(
        F.concat_ws("_", "model_id", "trigger_type").alias("trigger_id"), "model_id", "trigger_type",
        (F.col("n") % 7 != 0).alias("enabled"), "baseline", "threshold", F.lit(10).alias("interval_days"),
        F.when(F.col("n") % 5 != 0, F.col("last")).alias("last_triggered"),
    )


@query(
    "lifecycle_fired_triggers",
    f"""WITH {VERSION_SQL}, l AS (SELECT model_id, max(deployed_at) AS last, count(*) AS n FROM deployments GROUP BY 1),
    m AS (SELECT 'm' || (l_suppkey % 40) AS model_id, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) + 0.06 AS acc, 0.9 AS rec, avg(l_tax) * 6 AS drift FROM lineitem GROUP BY 1),
    f AS (SELECT model_id, 'performance' AS trigger_type FROM l JOIN m USING (model_id) WHERE n % 7 <> 0 AND ((0.9 - acc) / 0.9 > 0.43 OR (0.8 - rec) / 0.8 > 0.43)
      UNION ALL SELECT model_id, 'data_drift' FROM l JOIN m USING (model_id) WHERE n % 7 <> 0 AND drift > 0.25
      UNION ALL SELECT model_id, 'scheduled' FROM l JOIN m USING (model_id) WHERE n % 7 <> 0 AND (n % 5 = 0 OR floor(epoch(TIMESTAMP '{NOW}' - last) / 86400) >= 10))
    SELECT model_id, model_id || '_' || trigger_type AS trigger_id, trigger_type, '{NOW} 00:00:00' AS last_triggered FROM f""",
)
def lifecycle_fired_triggers(t):
    metrics = t.lineitem.groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 40).cast("string")).alias("model_id")).agg(
        (F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)) + 0.06).alias("a"), (F.avg("l_tax") * 6).alias("d")
    )
    current = metrics.select(
        "model_id",
        F.create_map(F.lit("accuracy"), F.col("a"), F.lit("recall"), F.lit(0.9), F.lit("drift_score"), F.col("d")).alias("current"),
    )
    return L.fired_triggers(triggers(t), current, F.lit(NOW).cast("timestamp")).withColumn("last_triggered", stamp("last_triggered"))


@query(
    "lifecycle_rollback_plan",
    f"""WITH {VERSION_SQL}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, environment ORDER BY deployed_at DESC, deployment_id DESC) AS r FROM deployments) WHERE r = 1),
    e AS (SELECT c.model_id, c.environment, c.deployment_id, c.version AS from_version, d.version AS to_version,
      row_number() OVER (PARTITION BY c.model_id, c.environment ORDER BY d.deployed_at DESC, d.deployment_id DESC) AS r
      FROM c JOIN deployments d ON d.model_id = c.model_id AND d.environment = c.environment AND d.status = 'success' AND d.version <> c.version
        AND (d.deployed_at, d.deployment_id) < (c.deployed_at, c.deployment_id) WHERE c.status IN ('success', 'failed'))
    SELECT model_id, environment, deployment_id, from_version, to_version FROM e WHERE r = 1""",
)
def lifecycle_rollback_plan(t):
    return L.rollback_plan(deployments(t))


@query(
    "perf_monitor_all_models",
    f"""WITH {BATCH_SQL}, {SUMMARY_SQL},
    a AS (SELECT model_id, 'performance_threshold' AS type, 'accuracy' AS subject, avg_accuracy AS cv, 0.52::DOUBLE AS th, 'warning' AS severity FROM per_model WHERE avg_accuracy < 0.52
      UNION ALL SELECT model_id, 'performance_threshold', 'latency_ms', avg_latency_ms, 27.0, 'warning' FROM per_model WHERE avg_latency_ms > 27
      UNION ALL SELECT model_id, 'performance_threshold', 'f1_score', avg_f1_score, 0.5, 'warning' FROM per_model WHERE avg_f1_score < 0.5
      UNION ALL SELECT model_id, 'retraining_trigger', 'acc_drop', NULL, NULL, 'info' FROM per_model WHERE min_accuracy < 0.4)
    SELECT model_id, type, subject, round(cv, 6) AS current_value, th AS threshold, severity FROM a""",
)
def perf_monitor_all_models(t):
    m = M.batch_metrics(predictions(t))
    per_model = M.summary(m, since())
    fired = per_model.filter("min_accuracy < 0.4").select("model_id", F.lit("acc_drop").alias("trigger_id"))
    return tidy(M.monitor(per_model, thresholds(t, m), fired))


# every test has a model of its own and a shared one; a wide significance level, so that the data have significant tests


@query(
    "perf_monitor_with_ab_tests",
    f"""SELECT * FROM ({ORACLES["perf_monitor_all_models"]})
    UNION ALL SELECT unnest(['m' || test_id || 'a', 'shared']), 'ab_test_significant', test_id || ':' || winner, p_value, NULL, 'info'
    FROM ({ORACLES["ab_analysis"].replace("pv < 0.05", "pv < 0.9")}) WHERE statistical_significance""",
)
def perf_monitor_with_ab_tests(t):
    """The monitoring pass with the significant tests of each model next to thresholds and triggers."""
    m = M.batch_metrics(predictions(t))
    per_model = M.summary(m, since())
    fired = per_model.filter("min_accuracy < 0.4").select("model_id", F.lit("acc_drop").alias("trigger_id"))
    analysis = B.analyze(ab_traffic(t), "value", alpha=0.9)
    tests = ab_traffic(t).select("test_id").distinct().select(
        "test_id", F.concat(F.lit("m"), F.col("test_id").cast("string"), F.lit("a")).alias("model_a_id"), F.lit("shared").alias("model_b_id"),
        F.lit(100).alias("min_sample_size"), F.lit(True).alias("enabled"),
    )
    return tidy(M.monitor(per_model, thresholds(t, m), fired, B.per_model(tests, analysis)))


@query(
    "perf_run_summary",
    """SELECT o_orderpriority AS name, count(*) AS total_runs, count(*) FILTER (o_orderstatus = 'O') AS successful_runs,
      count(*) FILTER (o_orderstatus <> 'O') AS failed_runs, round(avg(o_totalprice), 4) AS avg_processing_time,
      strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_run, sum(o_custkey % 3)::BIGINT AS total_alerts FROM orders GROUP BY 1""",
)
def perf_run_summary(t):
    runs = t.orders.select(
        F.col("o_orderpriority").alias("name"), "o_orderdate", "o_totalprice", (F.col("o_orderstatus") == "O").alias("ok"),
        (F.col("o_custkey") % 3).alias("alerts"),
    )
    return tidy(M.run_summary(runs, "name", "o_orderdate", "o_totalprice", "ok", "alerts"), 4)
