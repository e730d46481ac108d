"""Root-cause analysis over metric series ``(source, metric, ts, value)``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.common import attach, merge_by_keys, micros, number, quoted, seconds, union_all
from tidewatch.operators.predicates import compare
from tidewatch.operators.windows import last_points_trend, newest, newest_z
from tidewatch.session import cut_lineage
from tidewatch.sources import folders

# Triggers a deployment starts with.
DEFAULT_TRIGGERS = (
    {"trigger_id": "critical_performance", "severity": "critical",
     "conditions": {"type": "threshold", "metric": "accuracy", "threshold": 0.75, "operator": "<"}},
    {"trigger_id": "sustained_latency", "severity": "high",
     "conditions": {"type": "trend", "metric": "latency_ms", "trend_direction": "increasing", "window_size": 10, "threshold": 0.1}},
    {"trigger_id": "multiple_alerts", "severity": "medium",
     "conditions": {"type": "compound", "logic": "AND", "conditions": [
         {"type": "threshold", "metric": "alerts_count", "threshold": 5, "operator": ">"},
         {"type": "threshold", "metric": "accuracy", "threshold": 0.8, "operator": "<"}]}},
)

# Score limits with level, business impact and recovery time.
IMPACT_LEVELS = (
    (0.8, "critical", "severe", "days"),
    (0.6, "high", "significant", "hours"),
    (0.4, "medium", "moderate", "hours"),
)
IMPACT_FLOOR = ("low", "minimal", "immediate")

# Advice per kind of cause; {0} and {1} are metric names.
ADVICE = {
    "anomaly": ("Investigate the anomaly in {0}", "Consider implementing anomaly detection alerts"),
    "correlation": (
        "Investigate the relationship between {0} and {1}",
        "Consider if this correlation indicates a causal relationship",
    ),
    "system": ("Monitor {0} more closely", "Consider scaling resources if usage remains high"),
    "deployment": (
        "Review recent deployment failures", "Implement deployment rollback procedures", "Add deployment health checks",
    ),
}
URGENT_ADVICE = (
    "Implement immediate monitoring and alerting", "Consider rolling back recent changes", "Schedule incident review meeting",
)
CALM_ADVICE = ("Continue monitoring the situation", "Review system logs for additional insights")

CAUSE_COLUMNS = ("type", "metrics", "description", "severity", "confidence")


def leaves(condition: Mapping) -> Iterator[Mapping]:
    """Simple conditions inside a (nested) compound one."""
    if condition.get("type", "threshold") == "compound":
        for sub in condition.get("conditions", ()):
            yield from leaves(sub)
    else:
        yield condition


def metric_row(series: DataFrame, conditions: Sequence[Mapping], ts: str = "ts", value: str = "value") -> DataFrame:
    """One row with the statistics the conditions need: last value, slopes, newest z."""
    wanted = [leaf for c in conditions for leaf in leaves(c)]
    names = sorted({leaf["metric"] for leaf in wanted})
    rows = series.filter(F.col("metric").isin(*names)) if names else series.limit(0)
    parts = [rows.groupBy("metric").agg(F.max_by(number(quoted(value)), quoted(ts)).alias("last"))]
    sizes = sorted({int(leaf.get("window_size", 10)) for leaf in wanted if leaf.get("type") == "trend"})
    for n in sizes:
        trend = last_points_trend(rows, ["metric"], ts, value, n)
        parts.append(trend.select("metric", F.col("slope").alias(f"slope{n}")))
    if any(leaf.get("type") == "anomaly" for leaf in wanted):
        parts.append(newest_z(rows, ["metric"], ts, value).select("metric", "z_score"))
    per_metric = merge_by_keys(parts, ["metric"])
    stats = [c for c in per_metric.columns if c != "metric"]
    cells = [F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{i}:{s}") for i, m in enumerate(names) for s in stats]
    return per_metric.agg(F.count(F.lit(1)).alias("__metrics"), *cells)


def holds(condition: Mapping, names: Sequence[str]) -> Column:
    """A condition tree as one boolean over the row of :func:`metric_row`."""
    kind = condition.get("type", "threshold")
    if kind == "compound":
        parts = [holds(c, names) for c in condition.get("conditions", ())]
        logic = condition.get("logic", "AND")
        if not parts or logic not in ("AND", "OR"):
            return F.lit(False)
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if logic == "AND" else (out | p)
        return out
    i = names.index(condition["metric"])
    if kind == "threshold":
        return compare(condition.get("operator", ">"), quoted(f"{i}:last"), F.lit(float(condition["threshold"])))
    if kind == "trend":
        slope, limit = quoted(f"{i}:slope{int(condition.get('window_size', 10))}"), float(condition.get("threshold", 0.1))
        test = {"decreasing": slope < -limit, "increasing": slope > limit}.get(
            condition.get("trend_direction", "decreasing"), F.abs(slope) > limit
        )
        return F.coalesce(test, F.lit(False))
    if kind == "anomaly":
        return F.coalesce(quoted(f"{i}:z_score") > float(condition.get("anomaly_threshold", 2.0)), F.lit(False))
    return F.lit(False)


def fired(series: DataFrame, triggers: Sequence[Mapping] = DEFAULT_TRIGGERS, ts: str = "ts", value: str = "value") -> DataFrame:
    """Triggers whose condition holds on the series: ``(trigger_id, severity)``."""
    conditions = [t["conditions"] for t in triggers if t.get("enabled", True)]
    names = sorted({leaf["metric"] for c in conditions for leaf in leaves(c)})
    row = metric_row(series, conditions, ts, value)
    results = F.array(*[
        F.struct(
            F.lit(t["trigger_id"]).alias("trigger_id"), F.lit(t.get("severity", "medium")).alias("severity"),
            holds(t["conditions"], names).alias("__fires"),
        )
        for t in triggers if t.get("enabled", True)
    ])
    return row.select(F.inline(results)).filter("__fires").drop("__fires")


def collect(sources: Sequence[tuple[str, DataFrame]], since: Column) -> DataFrame:
    """Series of all sources in one long table, from ``since`` on; metric names get the source in front."""
    return union_all([
        df.filter(F.col("ts") >= since).select(
            F.lit(name).alias("source"), F.concat_ws("_", F.lit(name), "metric").alias("metric"), "ts", "value"
        )
        for name, df in sources
    ])


def correlations(
    series: DataFrame, metrics: Sequence[str] | None = None, bucket: Column | None = None, min_points: int = 11,
    symmetric: bool = False,
) -> DataFrame:
    """Pearson correlation of all metric pairs, aligned on time: ``(metric1, metric2, n, correlation, strength)``.

    Values are averaged per moment and metric first; then the metrics of a moment meet and every pair is one group, combined
    inside each task before the shuffle.  Any number of metrics will do.  With ``metrics`` only those are compared, in that
    order; else the smaller name comes first.  ``strength`` is NULL up to 0.7.
    """
    at = bucket if bucket is not None else F.col("ts")
    place = F.col("metric")
    if metrics is not None:
        series = series.filter(F.col("metric").isin(*metrics))
        place = F.array_position(F.array(*[F.lit(m) for m in metrics]).cast("array<string>"), F.col("metric"))
    cells = series.groupBy(at.alias("__at"), "metric").agg(F.avg(number("value")).alias("x")).filter("x IS NOT NULL")
    one, two = (
        cells.select(F.col("__at").alias(f"__at{i}"), F.col("metric").alias(f"metric{i}"), F.col("x").alias(f"x{i}"), place.alias(f"__p{i}"))
        for i in (1, 2)
    )
    met = one.join(two, F.col("__at1").eqNullSafe(F.col("__at2")) & (F.col("__p1") < F.col("__p2")))
    out = met.groupBy("metric1", "metric2").agg(F.count(F.lit(1)).alias("n"), F.corr("x1", "x2").alias("correlation"))
    if symmetric:
        out = out.select(F.inline(F.array(*[
            F.struct(F.col(a).alias("metric1"), F.col(b).alias("metric2"), "n", "correlation")
            for a, b in (("metric1", "metric2"), ("metric2", "metric1"))
        ])))
    r = F.abs("correlation")
    return out.filter(F.col("n") >= min_points).withColumn("strength", F.when(r > 0.8, "strong").when(r > 0.7, "moderate"))


def anomalies(series: DataFrame, min_points: int = 11, limit: float = 2.5) -> DataFrame:
    """Per metric the point with the largest absolute z (population std), if above ``limit``; first one on a tie.

    It is the metric's largest or smallest value, so one aggregate finds it; a second pass counts what lies before it.
    """
    x, t = number("value"), micros("ts")
    stats = series.groupBy("metric").agg(
        F.count(x).alias("n_points"), F.avg(x).alias("mean_value"), F.stddev_pop(x).alias("std_value"),
        F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), (-t).alias("t"), "ts"))).alias("hi"), F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), t.alias("t"), "ts"))).alias("lo"),
    ).filter((F.col("n_points") >= min_points) & (F.col("std_value") > 0))
    z = lambda end: F.abs(F.col(f"{end}.x") - F.col("mean_value")) / F.col("std_value")
    high = (z("hi") > z("lo")) | ((z("hi") == z("lo")) & (F.col("hi.ts") <= F.col("lo.ts")))
    point = F.when(high, F.struct("hi.x", "hi.ts", z("hi").alias("z"))).otherwise(F.struct("lo.x", "lo.ts", z("lo").alias("z")))
    flat = stats.select("metric", point.alias("p"), "mean_value", "std_value").select(
        "metric", F.col("p.x").alias("anomaly_value"), F.col("p.ts").alias("anomaly_ts"), "mean_value", "std_value", F.col("p.z").alias("severity")
    ).filter(F.col("severity") > limit)
    names = [c for c in flat.columns if c != "metric"]
    found = attach(series.select("metric", "ts"), flat, ["metric"]).groupBy("metric").agg(
        *[F.first(c).alias(c) for c in names], F.count_if(F.col("ts") < F.col("anomaly_ts")).alias("position")
    )
    return found.select(
        "metric",
        F.when(F.col("anomaly_value") > F.col("mean_value"), "spike").otherwise("drop").alias("anomaly_type"),
        "severity", F.least(F.lit(0.95), F.col("severity") / 5).alias("confidence"),
        "anomaly_value", "mean_value", "std_value", "anomaly_ts", "position",
    )


def root_causes(
    found: DataFrame | None = None, pairs: DataFrame | None = None, system: DataFrame | None = None, deployments: DataFrame | None = None
) -> DataFrame:
    """Causes from anomalies (z > 3), strong correlations, busy system metrics (mean > 90) and failed deployments."""
    parts = []
    if found is not None:
        parts.append(found.filter("severity > 3").select(
            F.lit("anomaly").alias("type"), F.array("metric").alias("metrics"),
            F.format_string("Significant %s detected in %s", "anomaly_type", "metric").alias("description"),
            "severity", "confidence",
        ))
    if pairs is not None:
        parts.append(pairs.filter("strength = 'strong'").select(
            F.lit("correlation").alias("type"), F.array("metric1", "metric2").alias("metrics"),
            F.format_string("Strong correlation between %s and %s", "metric1", "metric2").alias("description"),
            F.abs("correlation").alias("severity"), F.lit(0.8).alias("confidence"),
        ))
    if system is not None:
        mean = system.groupBy("metric").agg(F.avg(number("value")).alias("m")).filter("m > 90")
        parts.append(mean.select(
            F.lit("system").alias("type"), F.array(F.concat(F.lit("system_"), "metric")).alias("metrics"),
            F.format_string("High %s usage detected", "metric").alias("description"),
            (F.col("m") / 100).alias("severity"), F.lit(0.7).alias("confidence"),
        ))
    if deployments is not None:
        s = deployments.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("f")).filter("f > 0")
        parts.append(s.select(
            F.lit("deployment").alias("type"), F.array().cast("array<string>").alias("metrics"),
            F.format_string("Recent failed deployments detected: %d", "f").alias("description"),
            (F.col("f") / F.col("n")).alias("severity"), F.lit(0.8).alias("confidence"),
        ))
    return union_all(parts)


def impact(causes: DataFrame) -> DataFrame:
    """Impact score (mean severity × mean confidence), level, business impact, recovery time, affected metrics."""
    scores = causes.agg(F.avg("severity").alias("s"), F.avg("confidence").alias("c"))
    # distinct names only: at most one per metric
    names = causes.select(F.explode("metrics").alias("m")).agg(F.sort_array(F.collect_set("m")).alias("affected_metrics"))
    s = merge_by_keys([scores, names], [])
    score = F.coalesce(F.col("s") * F.col("c"), F.lit(0.0))
    level, business, recovery = (F.lit(v) for v in IMPACT_FLOOR)
    for limit, a, b, c in reversed(IMPACT_LEVELS):
        hit = score > limit
        level, business, recovery = (F.when(hit, F.lit(v)).otherwise(o) for v, o in ((a, level), (b, business), (c, recovery)))
    return s.select(
        level.alias("overall_impact"), score.alias("impact_score"), business.alias("business_impact"),
        recovery.alias("recovery_time"), "affected_metrics",
    )


def recommendations(causes: DataFrame, assessed: DataFrame) -> DataFrame:
    """Advice rows for every cause and for the impact level; a default pair when there is nothing else."""
    texts = F.array().cast("array<string>")
    for kind, items in ADVICE.items():
        filled = []
        for item in items:
            c = F.lit(item)
            for k in (0, 1):
                if f"{{{k}}}" in item:
                    c = F.replace(c, F.lit(f"{{{k}}}"), F.coalesce(F.try_element_at("metrics", F.lit(k + 1)), F.lit("unknown metric")))
            filled.append(c)
        texts = F.when(F.col("type") == kind, F.array(*filled)).otherwise(texts)
    per_cause = causes.select(F.explode(texts).alias("recommendation"))
    urgent = assessed.filter(F.col("overall_impact").isin("high", "critical")).select(
        F.explode(F.array(*[F.lit(x) for x in URGENT_ADVICE])).alias("recommendation")
    )
    quiet = union_all([causes.select(F.lit(1).alias("x")), urgent.select(F.lit(1).alias("x"))]).agg(
        F.count("x").alias("n")).filter("n = 0").select(F.explode(F.array(*[F.lit(x) for x in CALM_ADVICE])).alias("recommendation"))
    return union_all([per_cause, urgent, quiet])


@dataclass(frozen=True)
class Investigation:
    """Results of one investigation, each a DataFrame."""

    series: DataFrame
    correlations: DataFrame
    anomalies: DataFrame
    causes: DataFrame
    impact: DataFrame
    recommendations: DataFrame


def investigate(
    sources: Sequence[tuple[str, DataFrame]], since: Column, metrics: Sequence[str] | None = None,
    system: DataFrame | None = None, deployments: DataFrame | None = None,
) -> Investigation:
    """Collect, correlate, find anomalies, name causes, assess the impact, recommend."""
    series = collect(sources, since)
    pairs = correlations(series, metrics, symmetric=True)
    found = anomalies(series)
    causes = root_causes(found, pairs, system, deployments)
    assessed = impact(causes)
    return Investigation(series, pairs, found, causes, assessed, recommendations(causes, assessed))


PARTS = ("series", "correlations", "anomalies", "causes", "impact", "recommendations")
LOG_SCHEMA = (
    "investigation_id string, trigger_id string, title string, severity string, status string, created_at timestamp, "
    "started_at timestamp, completed_at timestamp, error string"
)


def log_investigations(
    spark: SparkSession, path: str, triggers: DataFrame, sources: Sequence[tuple[str, DataFrame]], since: Column, now: datetime,
    system: DataFrame | None = None, deployments: DataFrame | None = None,
) -> DataFrame:
    """Investigate what ``triggers (trigger_id, severity)`` fired at ``now``; the rows of their investigations.

    The parts are written to ``path/{part}/run=…`` and then, last, one row per trigger with status and times to
    ``path/log/run=…``.  A run is named by its moment: what is in the log is not done again, a run that was broken off is
    done again over its own folders, and one that failed is logged as ``failed`` with its error and tried again when asked.
    """
    run = now.strftime("%Y%m%d_%H%M%S")
    log = f"{path}/log/run={run}"
    if folders.exists(spark, f"{log}/_SUCCESS"):
        known = spark.read.schema(LOG_SCHEMA).parquet(log)
        if known.where("status = 'failed'").isEmpty():
            return known
    started, error = datetime.now(timezone.utc), None
    fired_now = cut_lineage(triggers.select("trigger_id", "severity").distinct())
    if not fired_now.isEmpty():
        try:
            done = investigate(sources, since, system=system, deployments=deployments)
            for part in PARTS:
                getattr(done, part).write.mode("overwrite").parquet(f"{path}/{part}/run={run}")
        except PySparkException as exc:  # the investigation's own failure is a result, not the caller's
            error = str(exc).splitlines()[0][:500]
    moment = lambda x: F.lit(x).cast("timestamp")
    rows = fired_now.select(
        F.concat(F.lit("rca_"), "trigger_id", F.lit(f"_{run}")).alias("investigation_id"), "trigger_id", F.concat(F.lit("RCA: "), "trigger_id").alias("title"), "severity",
        F.lit("completed" if error is None else "failed").alias("status"), moment(now).alias("created_at"), moment(started).alias("started_at"),
        (moment(datetime.now(timezone.utc)) if error is None else F.lit(None).cast("timestamp")).alias("completed_at"), F.lit(error).cast("string").alias("error"),
    )
    rows.write.mode("overwrite").parquet(log)
    return spark.read.schema(LOG_SCHEMA).parquet(log)


def investigation_log(spark: SparkSession, path: str) -> DataFrame:
    """All investigations logged below ``path``."""
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/log")


def summary(investigations: DataFrame, since: Column | None = None) -> DataFrame:
    """Counts in all, by status and by severity, and the mean duration: ``(dimension, value, n, mean_seconds)``."""
    rows = investigations if since is None else investigations.filter(F.col("created_at") >= since)
    took = seconds("completed_at") - seconds("started_at")
    dims = ("status", "severity")
    grouped = rows.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(
        F.count(F.lit(1)).alias("n"), F.avg(took).alias("mean_seconds"), *[F.grouping(d).alias(f"g_{d}") for d in dims]
    )
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n", "mean_seconds")


def recent(investigations: DataFrame, limit: int = 10) -> DataFrame:
    return newest(investigations, "created_at", limit, tiebreak=["investigation_id"])
