"""Row-frame windows and time-series measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import attach, number, quoted, seconds
from tidewatch.functions.ordered import BLOCK_ROWS, framed_window, newest_rows

ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
TRAILING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def rolling(
    df: DataFrame,
    column: str,
    order_by: str,
    window: int = 5,
    functions: Sequence[str] = ("mean", "std"),
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rolling mean, sample std, min, max; NULL until the frame holds ``window`` non-null values."""

    def build(spec: Window) -> Mapping[str, Column]:
        frame = spec.rowsBetween(-(window - 1), 0)
        x = number(quoted(column))
        full = F.count(x).over(frame) == window
        return {
            f"{column}_rolling_{name}_{window}": F.when(full, ROLLING[name](x).over(frame))
            for name in functions
            if name in ROLLING
        }

    return framed_window(df, keys, order_by, tiebreak, window - 1, build, block_rows).drop("__idx")


def trailing(
    df: DataFrame,
    column: str,
    order_by: str,
    agg_type: str = "mean",
    window: int = 10,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    output: str = "aggregated",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Trailing aggregate with partial leading frames; a series shorter than the window stays as it is."""

    def build(spec: Window) -> Mapping[str, Column]:
        frame = spec.rowsBetween(-(window - 1), 0)
        x = number(quoted(column))
        rolled = TRAILING[agg_type](x).over(frame) if agg_type in TRAILING else x
        return {output: F.when(F.col("__total") < window, x).otherwise(rolled)}

    out = framed_window(df, keys, order_by, tiebreak, window - 1, build, block_rows, total="__total")
    return out.drop("__idx", "__total")


def newest(df: DataFrame, ts: str, limit: int = 10, keys: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest ``limit`` rows, overall or per key."""
    if keys:
        return newest_rows(df, keys, ts, limit, tiebreak)
    return df.orderBy(F.desc(quoted(ts)), *[F.desc(quoted(t)) for t in tiebreak]).limit(limit)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Latest row of each key by partial aggregation: no sort."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(quoted(ts), *[quoted(t) for t in tiebreak])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[quoted(c) for c in rest]), order).alias("__row"))
    return best.select(*[quoted(k) for k in keys], *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def last_points_trend(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, window: int = 10, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Least-squares slope and intercept of the last ``window`` points on positions 0…window-1.

    Only series with at least ``window`` points give a row.
    """
    order = [F.desc(quoted(ts)), *[F.desc(quoted(t)) for t in tiebreak]]
    # at most ``window`` rows per series are left before they are numbered
    tail = newest(df, ts, window, keys, tiebreak)
    recent = tail.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    x = (F.lit(window) - F.col("__rn")).cast("double")
    y = number(quoted(value))
    return (
        recent.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
        )
        .filter(F.col("n_points") >= window)
    )


def time_trend(df: DataFrame, keys: Sequence[str], ts: str, value: str, since=None) -> DataFrame:
    """Slope of a value against real time in seconds; ``improving`` when it rises."""
    rows = df if since is None else df.filter(quoted(ts) >= since)
    y = number(quoted(value))
    stats = rows.groupBy(*keys).agg(
        F.count(y).alias("n_points"), F.regr_slope(y, seconds(quoted(ts))).alias("slope")
    )
    return stats.filter("n_points > 1").withColumn(
        "trend_direction", F.when(F.col("slope") > 0, "improving").otherwise("degrading")
    )


def newest_z(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, tiebreak: Sequence[str] = (), min_points: int = 10
) -> DataFrame:
    """Absolute z of the newest point against all earlier ones (population std); NULL when std is 0."""
    order = F.struct(quoted(ts), *[quoted(t) for t in tiebreak])
    y = number(quoted(value))
    head = df.groupBy(*keys).agg(
        F.max(order).alias("__newest"), F.max_by(y, order).alias("newest_value"), F.count(F.lit(1)).alias("n_points")
    )
    earlier = attach(df, head, keys).filter(order < F.col("__newest"))
    stats = earlier.groupBy(*keys, "newest_value", "n_points").agg(
        F.avg(y).alias("earlier_mean"), F.stddev_pop(y).alias("earlier_std")
    )
    return stats.filter(F.col("n_points") >= min_points).withColumn(
        "z_score", F.abs(F.col("newest_value") - F.col("earlier_mean")) / F.nullif(F.col("earlier_std"), F.lit(0.0))
    )


def mean_duration(df: DataFrame, started: str, completed: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of ``completed - started`` in seconds over finished rows."""
    done = df.filter(quoted(completed).isNotNull())
    return done.groupBy(*keys).agg(F.avg(seconds(quoted(completed)) - seconds(quoted(started))).alias("mean_seconds"))
