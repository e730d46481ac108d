"""One dataset through drift, quality and features; results are separate tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import union_all
from tidewatch.operators import drift, features, iforest, quality


@dataclass(frozen=True)
class DatasetResult:
    """Drift, quality and feature-quality rows of one dataset."""

    drift: DataFrame | None
    quality: DataFrame | None
    features: DataFrame | None


def detect_drift(
    df: DataFrame, columns: Sequence[str], is_baseline: Column, method: str = "statistical", threshold: float = 0.05,
    min_samples: int = 100, key_columns: Sequence[str] = (),
) -> DataFrame:
    """Drift of several columns by ``statistical``, ``distribution`` or ``ml`` (isolation forest).

    The first two run for all columns in one job; a forest is fitted per column
    and needs ``key_columns`` that name a row.
    """
    if method == "ml":
        return union_all([iforest.drift(df, c, key_columns, is_baseline, threshold) for c in columns])
    tests = {"statistical": drift.statistical, "distribution": drift.distribution}
    if method not in tests:
        raise ValueError(f"unknown drift method {method}")
    return tests[method](drift.to_sides(df, columns, is_baseline), threshold, min_samples)


def process_dataset(df: DataFrame, config: Mapping) -> DatasetResult:
    """``config``: ``drift {columns, is_baseline, method?, threshold?}``, ``rules``, ``schema``, ``payload``, ``features``.

    The parts are independent: a stage that is not configured is ``None``, and
    none of them reads more columns than it needs.
    """
    d, rules, built = config.get("drift"), config.get("rules"), config.get("features")
    drifted = detect_drift(df, **d) if d else None
    checked = quality.check(df, rules, config.get("schema"), config.get("payload")) if rules else None
    scored = None
    if built:
        scored = union_all([
            features.quality_score(features.engineer(df, f), [f["feature_name"]]).withColumn(
                "feature_type", F.lit(f["feature_type"])
            )
            for f in built
        ])
    return DatasetResult(drifted, checked, scored)
