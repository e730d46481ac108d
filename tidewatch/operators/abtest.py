"""A/B tests: stable assignment, attachment of results, significance analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import hash_bucket, number, quoted
from tidewatch.functions.stats import student_p
from tidewatch.operators.drift import pooled_t
from tidewatch.operators.performance import batch_metrics
from tidewatch.operators.windows import latest_per_key

MIN_PER_ARM = 100


def arm(test_id: str | Column, user_id: str | Column, split: float | Column = 0.5, enabled: bool | Column = True) -> Column:
    """``B`` for ``split`` of the users, by a stable hash of test and user; a disabled test gives ``A``."""
    test = F.lit(test_id) if isinstance(test_id, str) else test_id
    user = quoted(user_id) if isinstance(user_id, str) else user_id
    bucket = hash_bucket(F.concat_ws(":", test.cast("string"), user.cast("string")), 100)
    on = enabled if isinstance(enabled, Column) else F.lit(enabled)
    share = split if isinstance(split, Column) else F.lit(float(split))
    return F.when(on & (bucket < share * 100), F.lit("B")).otherwise(F.lit("A"))


def assign(users: DataFrame, test_id: str, user: str = "user_id", split: float = 0.5, enabled: bool = True) -> DataFrame:
    return users.withColumn("test_id", F.lit(test_id)).withColumn("assigned_model", arm(test_id, user, split, enabled))


def attach_results(predictions: DataFrame, traffic: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Join predictions to the newest assignment of their ``(test_id, user_id)``: (accepted, rejected)."""
    keys = ["test_id", "user_id"]
    newest = latest_per_key(traffic.select(*keys, "assigned_model", quoted(ts).alias("assigned_at")), keys, "assigned_at")
    return predictions.join(newest, keys), predictions.join(newest.select(*keys), keys, "left_anti")


def result_metrics(results: DataFrame, keys: Sequence[str] = ("test_id", "user_id", "batch_id", "assigned_model")) -> DataFrame:
    """Classification metrics and latency of every attached prediction batch."""
    return batch_metrics(results, "classification", keys)


def arm_means(metrics: DataFrame, names: Sequence[str] = ("accuracy", "precision", "recall", "f1_score", "latency_ms")) -> DataFrame:
    return metrics.groupBy("test_id", "assigned_model").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c)).alias(f"avg_{c}") for c in names]
    )


def analyze(
    results: DataFrame, metric: str, min_sample_size: int = 100, alpha: float = 0.05, higher_is_better: bool = True
) -> DataFrame:
    """Pooled t-test, Cohen's d, 95 % interval (population variances) and winner, per test with enough data."""
    x = number(quoted(metric))

    def of(name: str) -> Column:
        return F.when(F.col("assigned_model") == name, x)

    s = results.groupBy("test_id").agg(*[
        e.alias(f"{k}_{a.lower()}")
        for a in ("A", "B")
        for k, e in (
            ("n", F.count(of(a)).cast("double")), ("mean", F.avg(of(a))), ("vs", F.var_samp(of(a))), ("vp", F.var_pop(of(a))),
        )
    ])
    na, nb, ma, mb = (F.col(c) for c in ("n_a", "n_b", "mean_a", "mean_b"))
    enough = (na + nb >= min_sample_size) & (na >= MIN_PER_ARM) & (nb >= MIN_PER_ARM)
    pooled = F.sqrt(((na - 1) * F.col("vs_a") + (nb - 1) * F.col("vs_b")) / (na + nb - 2))
    se = F.sqrt(F.col("vp_a") / na + F.col("vp_b") / nb)
    t = pooled_t(na, ma, F.col("vs_a"), nb, mb, F.col("vs_b"))
    tested = s.filter(enough).select("*", t.alias("t_statistic"), student_p(t, na + nb - 2).alias("p_value"))
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    b_wins = mb > ma if higher_is_better else mb < ma
    return tested.select(
        "test_id", "mean_a", "mean_b",
        na.cast("bigint").alias("sample_size_a"), nb.cast("bigint").alias("sample_size_b"),
        "t_statistic", "p_value", significant.alias("statistical_significance"),
        F.when(pooled > 0, (mb - ma) / pooled).otherwise(0.0).alias("effect_size"),
        F.when(significant, F.when(b_wins, "B").otherwise("A")).alias("winner"),
        (mb - ma - 1.96 * se).alias("ci_lower"), (mb - ma + 1.96 * se).alias("ci_upper"),
    )


def per_model(tests: DataFrame, analysis: DataFrame) -> DataFrame:
    """Analyses of active tests for each of their two models, once there is enough traffic with results.

    ``tests``: ``(test_id, model_a_id, model_b_id, min_sample_size, enabled)``; a model may be in several tests.
    """
    active = tests.filter("enabled").select("test_id", "min_sample_size", F.explode(F.array_distinct(F.array("model_a_id", "model_b_id"))).alias("model_id"))
    # side by side by union and aggregate: if the optimizer knows the only test id, a join would be left without keys
    sides = analysis.select("test_id", F.struct(*[quoted(c) for c in analysis.columns]).alias("__analysis")).unionByName(
        active.select("test_id", F.struct("min_sample_size", "model_id").alias("__test")), allowMissingColumns=True
    )
    met = sides.filter("test_id IS NOT NULL").groupBy("test_id").agg(F.collect_list("__analysis").alias("__analysis"), F.collect_list("__test").alias("__test"))
    pairs = met.select(F.explode("__analysis").alias("a"), "__test").select("a", F.explode("__test").alias("t"))
    enough = F.col("a.sample_size_a") + F.col("a.sample_size_b") >= F.col("t.min_sample_size")
    return pairs.filter(enough).select("t.model_id", "a.*")


def traffic_summary(traffic: DataFrame, has_result: str = "has_result") -> DataFrame:
    """Per test: traffic in all, by arm, and with results."""
    return traffic.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("total_traffic"),
        F.count_if(F.col("assigned_model") == "A").alias("model_a_traffic"),
        F.count_if(F.col("assigned_model") == "B").alias("model_b_traffic"),
        F.count_if(quoted(has_result)).alias("traffic_with_results"),
    )


def portfolio(tests: DataFrame, traffic: DataFrame, latest: DataFrame) -> DataFrame:
    """All tests: number, active, traffic, significant results, wins of A and B."""
    sums = traffic.groupBy("test_id").agg(F.count(F.lit(1)).alias("__traffic"))
    joined = tests.join(sums, "test_id", "left").join(
        latest.select("test_id", "statistical_significance", "winner"), "test_id", "left"
    )
    return joined.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if("enabled").alias("active_tests"),
        F.coalesce(F.sum("__traffic"), F.lit(0)).alias("total_traffic"),
        F.count_if("statistical_significance").alias("significant_tests"),
        F.count_if(F.col("winner") == "A").alias("model_a_wins"),
        F.count_if(F.col("winner") == "B").alias("model_b_wins"),
    )
