"""Isolation forest on one numeric column.

The forest is small whatever the data size: ``trees`` trees of at most 256
rows, drawn by a seeded hash so that every run draws the same rows.  On one
column a tree is a step function (sorted cut points, leaf depths), so the whole
forest is one sorted list of cut points with mean path lengths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import attach, number, quoted
from tidewatch.functions.ordered import exact_quantiles

TREES, SAMPLE = 100, 256
HASH_RANGE = 1 << 40


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list[float], list[float]]:
    """Random splits of sorted ``values``: cut points in order and the path length left of each (and of the last leaf)."""
    cuts: list[float] = []
    depths: list[float] = []

    def walk(part: np.ndarray, depth: int) -> None:
        if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            depths.append(depth + average_path(len(part)))
            return
        cut = rng.uniform(part[0], part[-1])
        at = int(np.searchsorted(part, cut, side="right"))
        walk(part[:at], depth + 1)
        cuts.append(float(cut))
        walk(part[at:], depth + 1)

    walk(np.sort(values), 0)
    return cuts, depths


def draw(df: DataFrame, value: str, keys: Sequence[str], trees: int = TREES, seed: int = 42) -> DataFrame:
    """``(tree, x)``: up to ``SAMPLE`` rows of the whole table for every tree.

    A row's seeded hash is a point on a circle, and every tree takes the rows on an arc of its own.  The arcs are so long that
    about four times the wanted rows lie on one; in a small table they overlap, up to all rows for all trees.  Of the rows on
    its arc a tree keeps those with the smallest hashes of its own.  ``keys`` must tell the rows apart.
    """
    if not keys:
        raise ValueError("the forest needs key columns that tell the rows apart")
    rows = df.select(number(quoted(value)).alias("x"), F.pmod(
        F.xxhash64(F.lit(seed), *[quoted(k) for k in keys]), F.lit(HASH_RANGE)
    ).alias("h")).filter("x is not null")
    size = rows.agg(F.count(F.lit(1)).alias("__n"))
    # both ends in trees: the arc of tree t starts at t
    here = F.col("h") / F.lit(HASH_RANGE / trees)
    reach = F.lit(4.0 * SAMPLE * trees) / F.col("__n")
    last = F.floor(here)
    first = F.greatest(F.ceil(here - reach), last - (trees - 1))
    arcs = attach(rows, size, []).withColumns({"__a": first, "__b": last}).filter("__a <= __b")
    placed = arcs.select("x", "h", F.explode(F.sequence("__a", "__b")).alias("t")).select("x", "h", F.pmod("t", F.lit(trees)).cast("int").alias("tree"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "h"), "x")
    return placed.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= SAMPLE).select("tree", "x")


def fit(df: DataFrame, value: str, keys: Sequence[str], trees: int = TREES, seed: int = 42) -> DataFrame:
    """Trees as rows ``(tree, size, cuts ARRAY, depths ARRAY)``."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        xs = part["x"].to_numpy()
        limit = int(math.ceil(math.log2(max(len(xs), 2))))
        cuts, depths = _grow(xs, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame({"tree": [tree], "size": [len(xs)], "cuts": [cuts], "depths": [depths]})

    return draw(df, value, keys, trees, seed).groupBy("tree").applyInPandas(
        build, "tree int, size int, cuts array<double>, depths array<double>"
    )


def scorer(forest: DataFrame):
    """Pandas UDF for the anomaly score ``-2^(-E[h]/c)`` of a value (lower is stranger).

    Collecting is safe: the forest has at most ``TREES × SAMPLE`` cut points.
    """
    trees = forest.collect()
    edges = np.unique(np.concatenate([np.asarray(t["cuts"], dtype=float) for t in trees] or [np.zeros(0)]))
    # one probe point per interval between neighbouring cut points
    probes = np.concatenate([edges, [np.inf]])
    total = np.zeros(len(probes))
    for t in trees:
        total += np.asarray(t["depths"])[np.searchsorted(np.asarray(t["cuts"]), probes, side="left")]
    size = max((t["size"] for t in trees), default=2)
    scores = -np.power(2.0, -(total / max(len(trees), 1)) / max(average_path(size), 1e-9))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        # a value equal to a cut point belongs to its left side
        return pd.Series(scores[np.searchsorted(edges, x.to_numpy(), side="left")])

    return score


def decision(df: DataFrame, value: str, forest: DataFrame, training: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Add ``decision``: score minus the ``contamination`` percentile of the training scores (negative = outlier)."""
    score = scorer(forest)
    trained = training.select(score(number(quoted(value))).alias("s"))
    offset = exact_quantiles(trained, [], {"__offset": ("s", contamination)})
    scored = df.withColumn("__score", score(number(quoted(value))))
    return attach(scored, offset, []).withColumn("decision", F.col("__score") - F.col("__offset")).drop(
        "__score", "__offset"
    )


def outlier_flags(df: DataFrame, value: str, keys: Sequence[str], contamination: float = 0.1) -> DataFrame:
    """Fit on the column and flag its own outliers: adds ``decision`` and ``is_outlier``."""
    rows = df.filter(number(quoted(value)).isNotNull())
    out = decision(rows, value, fit(rows, value, keys), rows, contamination)
    return out.withColumn("is_outlier", F.col("decision") < 0)


def drift(df: DataFrame, value: str, keys: Sequence[str], is_baseline: Column, threshold: float = 0.05) -> DataFrame:
    """Forest fitted on the baseline, both sides scored; drift from the change of mean and std of the scores."""
    rows = df.filter(number(quoted(value)).isNotNull()).withColumn("__base", is_baseline)
    baseline = rows.filter("__base")
    scored = decision(rows, value, fit(baseline, value, keys), baseline)
    d = F.col("decision")
    base, cur = F.when(F.col("__base"), d), F.when(~F.col("__base"), d)
    s = scored.agg(
        F.avg(base).alias("baseline_mean_score"), F.stddev_pop(base).alias("baseline_std_score"),
        F.avg(cur).alias("current_mean_score"), F.stddev_pop(cur).alias("current_std_score"),
    )
    unit = F.col("baseline_std_score") + 1e-8
    out = s.withColumn(
        "mean_diff", F.abs(F.col("current_mean_score") - F.col("baseline_mean_score")) / unit
    ).withColumn("std_diff", F.abs(F.col("current_std_score") - F.col("baseline_std_score")) / unit)
    out = out.withColumn("drift_score", F.least((F.col("mean_diff") + F.col("std_diff")) / 4, F.lit(1.0)))
    return out.select(
        F.lit(value).alias("feature"),
        (F.col("drift_score") > threshold).alias("drift_detected"),
        "drift_score",
        (1 - F.col("current_std_score")).alias("confidence"),
        F.lit("ml").alias("method"),
        *s.columns, "mean_diff", "std_diff",
    )
