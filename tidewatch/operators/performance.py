"""Model performance from a predictions table.

Predictions: ``(model_id, batch_id, ts, y_true, y_pred, latency_ms)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import attach, merge_by_keys, number, quoted, seconds, union_all
from tidewatch.functions.ordered import BLOCK_ROWS, framed_window, value_counts, with_prefix
from tidewatch.session import cut_lineage

SCORES = ("accuracy", "precision", "recall", "f1_score", "auc_score", "latency_ms", "throughput_rps")
# Metrics for which a larger value is worse.
HIGHER_IS_WORSE = ("latency_ms",)


def confusion(pred: DataFrame, keys: Sequence[str], score: str = "y_pred") -> DataFrame:
    """Confusion cells ``(keys, y_true, y_pred, n)``, combined before the shuffle.

    Classification scores and AUC both start from them, so Spark reuses the exchange.
    """
    return pred.groupBy(*keys, "y_true", quoted(score)).agg(F.count(F.lit(1)).alias("n"))


def classification(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 (0 where a class is never predicted)."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("y_pred").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    per_class = (
        confusion(pred, keys)
        .select(*[quoted(k) for k in keys], F.inline(sides))
        .groupBy(*keys, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    total = F.sum("support")
    return per_class.groupBy(*keys).agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(p * F.col("support")) / total).alias("precision"),
        (F.sum(r * F.col("support")) / total).alias("recall"),
        (F.sum(f1 * F.col("support")) / total).alias("f1_score"),
    )


def auc(pred: DataFrame, keys: Sequence[str], score: str = "y_pred") -> DataFrame:
    """Tie-aware ROC AUC with ``score`` as the score; 0 unless there are exactly two true classes."""
    cells = confusion(pred, keys, score)
    classes = cells.groupBy(*keys).agg(F.max("y_true").alias("__pos"), F.count_distinct("y_true").alias("__classes"))
    marked = attach(cells.withColumn("__x", number(quoted(score))), classes, keys).filter(F.col("__classes") == 2)
    is_pos = F.col("y_true") == F.col("__pos")
    counts = value_counts(
        marked, keys, "__x",
        {"pos": F.when(is_pos, F.col("n")).otherwise(0), "neg": F.when(is_pos, 0).otherwise(F.col("n"))},
    )
    ranked = with_prefix(counts, keys, "__x", ["pos", "neg"])
    area = ranked.groupBy(*keys).agg(
        F.expr(
            "(sum(pos * (before_pos + before_neg + (pos + neg + 1) / 2D)) - max(total_pos) * (max(total_pos) + 1) / 2D)"
            " / (CAST(max(total_pos) AS DOUBLE) * max(total_neg))"
        ).alias("auc_score")
    )
    base = classes.select(*[quoted(k) for k in keys], F.lit(0.0).alias("auc_score"))
    return union_all([base, area]).groupBy(*keys).agg(F.max("auc_score").alias("auc_score"))


def regression(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MSE, RMSE, MAE and their 0…1 forms against the value range (range 0 gives 1)."""
    err = number("y_true") - number("y_pred")
    span = F.greatest(F.max(number("y_true")), F.max(number("y_pred"))) - F.least(
        F.min(number("y_true")), F.min(number("y_pred"))
    )
    s = pred.groupBy(*keys).agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), span.alias("__span"))

    def scaled(e: Column) -> Column:
        return F.when(F.col("__span") == 0, F.lit(1.0)).otherwise(1 - e / F.col("__span"))

    rmse = F.sqrt("mse")
    return s.select(
        *[quoted(k) for k in keys], "mse", rmse.alias("rmse"), "mae",
        scaled(rmse).alias("accuracy"), scaled(F.col("mae")).alias("precision"),
        *[scaled(rmse).alias(c) for c in ("recall", "f1_score", "auc_score")],
    )


def throughput(latency: Column) -> Column:
    return F.when(latency > 0, F.lit(1000.0) / latency).otherwise(F.lit(0.0))


def batch_metrics(pred: DataFrame, model_type: str = "classification", keys: Sequence[str] = ("model_id", "batch_id")) -> DataFrame:
    """One metrics row per batch of predictions; other model types get the constant 0.5."""
    keys = list(keys)
    latency = pred.groupBy(*keys).agg(F.max("ts").alias("ts"), F.avg("latency_ms").alias("latency_ms"))
    if model_type == "classification":
        parts = [classification(pred, keys), auc(pred, keys)]
    elif model_type == "regression":
        parts = [regression(pred, keys)]
    else:
        half = [F.lit(0.5).alias(c) for c in SCORES[:5]]
        parts = [pred.select(*[quoted(k) for k in keys]).distinct().select("*", *half)]
    out = merge_by_keys([latency, *parts], keys)
    return out.withColumn("throughput_rps", throughput(F.col("latency_ms")))


def metrics_by_model_type(pred: DataFrame, models: DataFrame, keys: Sequence[str] = ("model_id", "batch_id")) -> DataFrame:
    """Metrics of all models, each by its registered ``model_type``."""
    typed = pred.join(models.select("model_id", "model_type"), "model_id")
    known = ("classification", "regression")
    wanted = [*keys, "ts", *SCORES]
    parts = [batch_metrics(typed.filter(F.col("model_type") == k), k, keys).select(*wanted) for k in known]
    parts.append(batch_metrics(typed.filter(~F.col("model_type").isin(*known)), "other", keys).select(*wanted))
    return union_all(parts)


def long_metrics(metrics: DataFrame, keys: Sequence[str], names: Sequence[str] = SCORES) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric_name"), quoted(n).cast("double").alias("current_value")) for n in names])
    return metrics.select(*[quoted(k) for k in keys], F.inline(pairs))


def threshold_alerts(metrics: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("model_id", "batch_id", "ts")) -> DataFrame:
    """Breaches of ``(model_id, metric_name, threshold_value)``: latency above, every other metric below."""
    long = long_metrics(metrics, keys)
    hit = long.join(thresholds, ["model_id", "metric_name"])
    worse = F.col("metric_name").isin(*HIGHER_IS_WORSE)
    cur, lim = F.col("current_value"), F.col("threshold_value")
    return hit.filter(F.when(worse, cur > lim).otherwise(cur < lim)).select(
        *keys, "metric_name", "current_value", "threshold_value",
        F.lit("threshold_breach").alias("alert_type"), F.lit("warning").alias("severity"),
        F.when(worse, F.concat(F.lit("Latency exceeded threshold: "), cur.cast("string"), F.lit("ms > "), lim.cast("string"), F.lit("ms")))
        .otherwise(F.concat("metric_name", F.lit(" below threshold: "), cur.cast("string"), F.lit(" < "), lim.cast("string")))
        .alias("message"),
    )


def degradation_alerts(
    metrics: DataFrame, tiebreak: Sequence[str] = ("batch_id",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Accuracy drop over 10 % or latency rise over 20 % against the mean of measurements −10…−2."""

    def build(spec: Window) -> dict[str, Column]:
        earlier = spec.rowsBetween(-10, -2)
        return {"__acc": F.avg("accuracy").over(earlier), "__lat": F.avg("latency_ms").over(earlier)}

    cols = ["model_id", *tiebreak, "ts", "accuracy", "latency_ms"]
    # the frame reads its input several times: keep the small metrics table, not the job over all predictions
    kept = cut_lineage(metrics.select(*cols))
    framed = framed_window(kept, ["model_id"], "ts", tiebreak, 10, build, block_rows).filter("__idx >= 10")
    a, l = F.col("__acc"), F.col("__lat")
    acc = F.when(a > 0, (a - F.col("accuracy")) / a).otherwise(0.0)
    lat = F.when(l > 0, (F.col("latency_ms") - l) / l).otherwise(0.0)

    def row(name: str, cur: Column, lim: Column, pct: Column, limit: float) -> Column:
        return F.when(pct > limit, F.struct(
            F.lit(name).alias("metric_name"), cur.alias("current_value"), lim.alias("threshold_value"), pct.alias("degradation_pct")
        ))

    found = F.array_compact(F.array(
        row("accuracy", F.col("accuracy"), a, acc, 0.1), row("latency", F.col("latency_ms"), l, lat, 0.2)
    ))
    return framed.select("model_id", *tiebreak, "ts", F.inline(found)).select(
        "*", F.lit("degradation").alias("alert_type"), F.lit("error").alias("severity"),
        F.format_string("Significant %s degradation detected: %.2f%%", "metric_name", F.col("degradation_pct") * 100).alias("message"),
    )


def summary(metrics: DataFrame, since: Column | None = None) -> DataFrame:
    """Per model: measurements, means of the seven metrics, extremes of accuracy and latency, last time."""
    rows = metrics if since is None else metrics.filter(F.col("ts") >= since)
    return rows.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        *[F.avg(c).alias(f"avg_{c}") for c in SCORES],
        *[fn(c).alias(f"{n}_{c}") for c in ("accuracy", "latency_ms") for n, fn in (("min", F.min), ("max", F.max))],
        F.max("ts").alias("last_updated"),
    )


def alert_counts(alerts: DataFrame, since: Column | None = None) -> DataFrame:
    """Per model: counts by severity, by type, by metric and in total, as ``(model_id, dimension, value, n)``."""
    rows = alerts if since is None else alerts.filter(F.col("ts") >= since)
    dims = ("severity", "alert_type", "metric_name")
    grouped = rows.groupingSets(
        [[F.col("model_id"), F.col(d)] for d in dims] + [[F.col("model_id")]], "model_id", *dims
    ).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select("model_id", name.alias("dimension"), value.alias("value"), "n")


def fleet_summary(models: DataFrame, per_model: DataFrame, alerts: DataFrame) -> DataFrame:
    """Whole fleet: mean of the models' means (all models count), totals of measurements and alerts."""
    counted = alerts.groupBy("model_id").agg(F.count(F.lit(1)).alias("__alerts"))
    joined = models.join(per_model, "model_id", "left").join(counted, "model_id", "left")

    def total(c: str) -> Column:
        return F.sum(F.coalesce(quoted(c), F.lit(0)))

    return joined.agg(
        F.count(F.lit(1)).alias("total_models"),
        F.count_if("enabled").alias("active_models"),
        F.try_divide(total("avg_accuracy"), F.count(F.lit(1))).alias("avg_accuracy"),
        F.try_divide(total("avg_latency_ms"), F.count(F.lit(1))).alias("avg_latency_ms"),
        total("total_predictions").cast("bigint").alias("total_predictions"),
        total("__alerts").cast("bigint").alias("total_alerts"),
    )


def trends(metrics: DataFrame, since: Column | None = None) -> DataFrame:
    """Slope of each metric over time per model; a rise is ``improving`` by name, ``is_better`` tells whether it is."""
    rows = metrics if since is None else metrics.filter(F.col("ts") >= since)
    names = ("accuracy", "precision", "recall", "f1_score", "latency_ms")
    t = seconds("ts")
    aggs = [F.regr_slope(number(quoted(c)), t).alias(c) for c in names]
    wide = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("__n"), *aggs).filter("__n > 1")
    slopes = long_metrics(wide, ["model_id"], names).withColumnRenamed("current_value", "slope")
    rising = F.col("slope") > 0
    worse = F.col("metric_name").isin(*HIGHER_IS_WORSE)
    return slopes.select(
        "model_id", "metric_name", "slope",
        F.when(rising, "improving").otherwise("degrading").alias("trend_direction"),
        F.when(worse, F.col("slope") < 0).otherwise(rising).alias("is_better"),
    )


def monitor(
    per_model: DataFrame, thresholds: DataFrame, fired_triggers: DataFrame | None = None, ab_results: DataFrame | None = None
) -> DataFrame:
    """Monitoring pass over all models: ``(model_id, type, subject, current_value, threshold, severity)``.

    ``fired_triggers``: ``(model_id, trigger_id)``; ``ab_results``:
    ``(model_id, test_id, winner, p_value, statistical_significance)``.
    """
    long = long_metrics(per_model, ["model_id"], [f"avg_{c}" for c in SCORES]).withColumn(
        "metric_name", F.expr("substring(metric_name, 5)")
    )
    hit = thresholds.join(long, ["model_id", "metric_name"], "left")
    cur, lim = F.coalesce("current_value", F.lit(0.0)), F.col("threshold_value")
    seen = thresholds.join(per_model.select("model_id"), "model_id", "left_semi").select("model_id").distinct()
    worse = F.col("metric_name").isin(*HIGHER_IS_WORSE)
    parts = [
        hit.join(seen, "model_id", "left_semi").filter(F.when(worse, cur > lim).otherwise(cur < lim)).select(
            "model_id", F.lit("performance_threshold").alias("type"), F.col("metric_name").alias("subject"),
            cur.alias("current_value"), lim.alias("threshold"), F.lit("warning").alias("severity"),
        )
    ]
    if fired_triggers is not None:
        parts.append(fired_triggers.select(
            "model_id", F.lit("retraining_trigger").alias("type"), F.col("trigger_id").alias("subject"), F.lit("info").alias("severity")
        ))
    if ab_results is not None:
        parts.append(ab_results.filter("statistical_significance").select(
            "model_id", F.lit("ab_test_significant").alias("type"), F.concat_ws(":", "test_id", "winner").alias("subject"),
            F.col("p_value").alias("current_value"), F.lit("info").alias("severity"),
        ))
    return union_all(parts)


def run_summary(runs: DataFrame, key: str, started: str, seconds_taken: str, success: str, alerts: str | None = None) -> DataFrame:
    """Runs per key: total, successes, failures, mean time, last run, alert total."""
    return runs.groupBy(quoted(key)).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(quoted(success)).alias("successful_runs"),
        F.count_if(~quoted(success)).alias("failed_runs"),
        F.avg(quoted(seconds_taken)).alias("avg_processing_time"),
        F.max(quoted(started)).alias("last_run"),
        *([F.sum(quoted(alerts)).alias("total_alerts")] if alerts else []),
    )
