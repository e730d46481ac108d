"""Model registry, deployments and retraining triggers as tables and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import micros, quoted
from tidewatch.operators.windows import newest


def register(registry: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (model, version) pairs to append, and those refused because they exist already or come again.

    Of a pair given several times the earliest ``created_at`` is taken, then the smallest row; the others are refused.
    """
    keys = ["model_id", "version"]
    order = [c for c in ("created_at",) if c in candidates.columns]
    fresh = candidates.join(registry.select(*keys), keys, "left_anti").select(*candidates.columns)
    first = F.min(F.struct(*order, *[quoted(c).alias(f"__{i}") for i, c in enumerate(candidates.columns)])).alias("__first")
    taken = fresh.groupBy(*keys).agg(first).select(*[F.col(f"__first.__{i}").alias(c) for i, c in enumerate(candidates.columns)])
    return taken, candidates.exceptAll(taken)


def lineage(versions: DataFrame, deployments: DataFrame) -> DataFrame:
    """Per model: versions, latest version, deployments, version in production and in staging (last success)."""

    def live(env: str) -> Column:
        ok = (F.col("environment") == env) & (F.col("status") == "success")
        return F.max_by(F.when(ok, F.col("version")), F.when(ok, F.struct("deployed_at", "deployment_id")))

    v = versions.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_versions"), F.max_by("version", F.struct("created_at", "version")).alias("latest_version")
    )
    d = deployments.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_deployments"),
        live("production").alias("current_production"), live("staging").alias("current_staging"),
    )
    return v.join(d, "model_id", "left").withColumn(
        "total_deployments", F.coalesce("total_deployments", F.lit(0).cast("bigint"))
    )


def deployment_summary(deployments: DataFrame) -> DataFrame:
    """Counts in all, by status and by environment: ``(dimension, value, n)``."""
    dims = ("status", "environment")
    grouped = deployments.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dims]
    )
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def recent_deployments(deployments: DataFrame, limit: int = 10) -> DataFrame:
    return newest(deployments, "deployed_at", limit, tiebreak=["deployment_id"])


def fired_triggers(triggers: DataFrame, metrics: DataFrame, now: Column) -> DataFrame:
    """Retraining triggers that fire: ``(model_id, trigger_id, trigger_type, last_triggered)``.

    ``triggers``: ``(trigger_id, model_id, trigger_type, enabled, baseline
    MAP<STRING,DOUBLE>, threshold, interval_days, last_triggered)``;
    ``metrics``: ``(model_id, current MAP<STRING,DOUBLE>)``.  A metric that is
    not there counts as 0.
    """
    joined = triggers.filter("enabled").join(metrics, "model_id")
    current = F.col("current")

    def dropped(entry: Column) -> Column:
        base = entry["value"]
        now_value = F.coalesce(F.try_element_at(current, entry["key"]), F.lit(0.0))
        return F.when(base > 0, (base - now_value) / base).otherwise(0.0) > F.coalesce("threshold", F.lit(0.1))

    performance = F.exists(F.map_entries("baseline"), dropped)
    drift = F.coalesce(F.try_element_at(current, F.lit("drift_score")), F.lit(0.0)) > F.coalesce("threshold", F.lit(0.05))
    age_days = F.floor((micros(now) - micros("last_triggered")) / F.lit(86_400_000_000))
    due = F.col("last_triggered").isNull() | (age_days >= F.coalesce("interval_days", F.lit(30)))
    kind = F.col("trigger_type")
    fires = (
        F.when(kind == "performance", performance).when(kind == "data_drift", drift).when(kind == "scheduled", due).otherwise(False)
    )
    return joined.filter(F.coalesce(fires, F.lit(False))).select(
        "model_id", "trigger_id", "trigger_type", now.cast("timestamp").alias("last_triggered")
    )


def rollback_plan(deployments: DataFrame) -> DataFrame:
    """For the last deployment of each (model, environment): the last earlier successful, different version.

    Rows without such a version are not there: nothing to roll back to.
    """
    keys = ["model_id", "environment"]
    order = F.struct("deployed_at", "deployment_id")
    last = deployments.groupBy(*keys).agg(
        F.max_by(F.struct("deployment_id", "version", "status"), order).alias("cur"), F.max(order).alias("at")
    )
    earlier = deployments.join(last, keys).filter(
        (order < F.col("at")) & (F.col("status") == "success") & (F.col("version") != F.col("cur.version"))
        & F.col("cur.status").isin("success", "failed")
    )
    return earlier.groupBy(*keys).agg(
        F.max("cur.deployment_id").alias("deployment_id"), F.max("cur.version").alias("from_version"),
        F.max_by("version", order).alias("to_version"),
    )

