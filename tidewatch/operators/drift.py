"""Drift between a baseline and a current sample, for any number of features at once.

Input is long: ``(feature, side, value)`` with side ``baseline`` or
``current``.  All features run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import merge_by_keys, number, quoted, unpivot
from tidewatch.functions.ordered import value_counts, with_prefix
from tidewatch.functions.stats import kolmogorov_p, normal_p, student_p
from tidewatch.operators.aggregates import column_statistics

BASELINE, CURRENT = "baseline", "current"


def to_sides(df: DataFrame, features: Sequence[str], is_baseline: Column) -> DataFrame:
    """Numeric columns to ``(feature, side, value)``."""
    marked = df.withColumn("side", F.when(is_baseline, BASELINE).otherwise(CURRENT))
    return unpivot(marked, ["side"], features, "feature", "value").filter("value is not null")


def baseline_snapshot(df: DataFrame, value: str = "value", keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Statistics row of a baseline, to be stored next to it."""
    return column_statistics(df, value, keys)


def rank_tests(sides: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Kolmogorov–Smirnov D and Mann–Whitney U of both sides, from one running count over distinct values."""
    is_base = F.col("side") == BASELINE
    counts = value_counts(
        sides, keys, "value", {"nb": F.when(is_base, 1).otherwise(0), "nc": F.when(is_base, 0).otherwise(1)}
    )
    ranked = with_prefix(counts, keys, "value", ["nb", "nc"])
    stats = ranked.groupBy(*keys).agg(
        F.max("total_nb").alias("n_baseline"),
        F.max("total_nc").alias("n_current"),
        F.expr("max(abs((before_nb + nb) / total_nb - (before_nc + nc) / total_nc))").alias("ks_statistic"),
        F.expr("sum(nb * (before_nb + before_nc + (nb + nc + 1) / 2D))").alias("__ranks"),
        F.expr("sum(pow(CAST(nb + nc AS DOUBLE), 3) - (nb + nc))").alias("__ties"),
    )
    n1, n2 = F.col("n_baseline").cast("double"), F.col("n_current").cast("double")
    n = n1 + n2
    u = F.col("__ranks") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("__ties") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    return stats.select(
        *keys, "n_baseline", "n_current", "ks_statistic", u.alias("mw_statistic"), z.alias("mw_z")
    )


def pooled_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Student's t with pooled sample variance."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return F.try_divide(m1 - m2, F.sqrt(pooled * (1 / n1 + 1 / n2)))


def t_test(sides: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Two-sample t statistic (equal variances) and degrees of freedom."""
    x = number("value")

    def side(name: str) -> Column:
        return F.when(F.col("side") == name, x)

    s = sides.groupBy(*keys).agg(*[
        e.alias(f"{k}{i}")
        for i, name in ((1, BASELINE), (2, CURRENT))
        for k, e in (("n", F.count(side(name)).cast("double")), ("m", F.avg(side(name))), ("v", F.var_samp(side(name))))
    ])
    cols = [F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]
    return s.select(*keys, pooled_t(*cols).alias("t_statistic"), (F.col("n1") + F.col("n2") - 2).alias("t_df"))


def statistical(
    sides: DataFrame, threshold: float = 0.05, min_samples: int = 100, keys: Sequence[str] = ("feature",), alpha: float = 0.05
) -> DataFrame:
    """Three tests combined: score ``1 - mean(p)``, drift if above ``threshold``, confidence ``1 - std(p)``.

    The score flags equal distributions as well (mean p near 0.5), so
    ``p_flag`` (smallest p below ``alpha``) is added.  Fewer than
    ``min_samples`` current rows: not detected, score 0.
    """
    tests = merge_by_keys([rank_tests(sides, keys), t_test(sides, keys)], keys)
    n1, n2 = F.col("n_baseline").cast("double"), F.col("n_current").cast("double")
    with_p = tests.select(
        "*",
        kolmogorov_p(F.col("ks_statistic"), n1, n2).alias("ks_pvalue"),
        normal_p(F.col("mw_z")).alias("mw_pvalue"),
        student_p(F.col("t_statistic"), F.col("t_df")).alias("t_pvalue"),
    )
    ps = [F.col("ks_pvalue"), F.col("mw_pvalue"), F.col("t_pvalue")]
    mean = (ps[0] + ps[1] + ps[2]) / 3
    std = F.sqrt(sum([(p - mean) * (p - mean) for p in ps], F.lit(0.0)) / 3)
    enough = (F.col("n_current") >= min_samples) & (F.col("n_baseline") >= min_samples)
    score = F.when(enough, 1 - mean).otherwise(0.0)
    return with_p.select(
        *keys,
        (enough & (score > threshold)).alias("drift_detected"),
        score.alias("drift_score"),
        F.when(enough, 1 - std).otherwise(0.0).alias("confidence"),
        F.lit("statistical").alias("method"),
        "n_baseline", "n_current", "ks_statistic", "ks_pvalue", "mw_statistic", "mw_pvalue", "t_statistic", "t_pvalue",
        (enough & (F.least(*ps) < alpha)).alias("p_flag"),
    )


KINDS = {"n": F.count, "mean": F.avg, "std": F.stddev_pop, "skew": F.skewness, "kurtosis": F.kurtosis}


def side_moments(values: DataFrame, side: str, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Moments of ``value`` per key, in columns named after the side."""
    return values.groupBy(*keys).agg(*[fn(number("value")).alias(f"{side}_{k}") for k, fn in KINDS.items()])


def distribution(
    sides: DataFrame, threshold: float = 0.05, min_samples: int = 100, keys: Sequence[str] = ("feature",)
) -> DataFrame:
    """Drift by moments: relative change of mean and std, absolute change of skewness and kurtosis."""
    x = number("value")

    def side(name: str) -> Column:
        return F.when(F.col("side") == name, x)

    s = sides.groupBy(*keys).agg(*[fn(side(name)).alias(f"{name}_{k}") for name in (BASELINE, CURRENT) for k, fn in KINDS.items()])
    return score_moments(s, threshold, min_samples, keys)


def score_moments(s: DataFrame, threshold: float, min_samples: int, keys: Sequence[str]) -> DataFrame:
    """Drift of rows that hold the moments of both sides."""

    def change(k: str) -> Column:
        return F.abs(F.col(f"{CURRENT}_{k}") - F.col(f"{BASELINE}_{k}"))

    base = F.col("baseline_std") + 1e-8
    diffs = {"mean_diff": change("mean") / base, "std_diff": change("std") / base, "skew_diff": change("skew"), "kurt_diff": change("kurtosis")}
    out = s.select("*", *[d.alias(k) for k, d in diffs.items()])
    enough = (F.col("current_n") >= min_samples) & (F.col("baseline_n") >= min_samples)
    # a constant sample has no skewness: the score is NULL then, and nothing is detected
    mean_diff = sum([F.col(k) for k in diffs], F.lit(0.0)) / 4
    score = F.when(enough, F.when(mean_diff > 1, 1.0).otherwise(mean_diff)).otherwise(0.0)
    return out.select(
        *keys,
        F.coalesce(enough & (score > threshold), F.lit(False)).alias("drift_detected"),
        score.alias("drift_score"),
        F.when(enough, F.least(F.col("current_n") / F.col("baseline_n"), F.lit(1.0))).otherwise(0.0).alias("confidence"),
        F.lit("distribution").alias("method"),
        F.col("baseline_n").alias("n_baseline"),
        F.col("current_n").alias("n_current"),
        *diffs,
    )


def summary(results: DataFrame, feature: str = "feature", ts: str = "ts") -> DataFrame:
    """Per feature: checks, drift events, rate, last check; the NULL row is the total with the share of drifting features."""
    per = results.groupBy(quoted(feature)).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("drift_detected").alias("drift_events"),
        F.max(quoted(ts)).alias("last_check"),
    )
    rows = per.withColumn("drift_rate", F.col("drift_events") / F.col("total_checks")).withColumn(
        "features_with_drift", F.when(F.col("drift_events") > 0, 1).otherwise(0).cast("bigint")
    )
    total = per.agg(
        F.sum("total_checks").alias("total_checks"),
        F.sum("drift_events").alias("drift_events"),
        F.max("last_check").alias("last_check"),
        F.avg(F.when(F.col("drift_events") > 0, 1.0).otherwise(0.0)).alias("drift_rate"),
        F.count_if(F.col("drift_events") > 0).alias("features_with_drift"),
    ).withColumn(feature, F.lit(None).cast("string"))
    return rows.unionByName(total)
