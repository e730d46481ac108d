"""Rule-driven aggregation: whole table, by group, by time window."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.common import merge_by_keys, number, numeric_columns, parse_window, quoted, union_all
from tidewatch.functions.ordered import exact_quantiles, most_common, newest_rows

ORDERED = ("median", "quantile")


def clean(df: DataFrame, column: str) -> Column:
    """Column with NaN as NULL (other types unchanged)."""
    c = quoted(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def _simple(df: DataFrame, rule: Mapping) -> Column | None:
    kind, c = rule["type"], clean(df, rule["column"])
    exact = rule.get("exact", True)
    table: dict[str, Callable[[], Column]] = {
        "count": lambda: F.count(F.lit(1)),
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "mean": lambda: F.avg(c),
        "std": lambda: F.stddev_samp(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "unique_count": lambda: F.count_distinct(c) if exact else F.approx_count_distinct(c),
        "custom": lambda: rule["function"](c),
    }
    if kind in ORDERED and not exact:
        q = 0.5 if kind == "median" else float(rule.get("quantile", 0.5))
        return F.percentile_approx(c.cast("double"), F.lit(q), F.lit(int(rule.get("accuracy", 10000))))
    return table[kind]() if kind in table else None


def aggregate(df: DataFrame, rules: Sequence[Mapping], keys: Sequence[str] = ()) -> DataFrame:
    """Run all rules in as few passes as their kinds need; one row per key (one row without keys).

    A rule is ``{type, column, output_key?, quantile?, function?, exact?}``.
    Rules on absent columns are skipped.  Plain aggregates share one pass;
    exact percentiles and most-common values are counted per value first.
    """
    plain: list[Column] = []
    quantiles: dict[str, tuple[str, float]] = {}
    modes: dict[str, str] = {}
    names: list[str] = []
    for rule in rules:
        kind, column = rule["type"], rule["column"]
        if column not in df.columns:
            continue
        out = rule.get("output_key", f"{column}_{kind}")
        expr = _simple(df, rule)
        if expr is not None:
            plain.append(expr.alias(out))
        elif kind in ORDERED:
            quantiles[out] = (column, 0.5 if kind == "median" else float(rule.get("quantile", 0.5)))
        elif kind == "most_common":
            modes[out] = column
        else:
            continue
        names.append(out)
    marker = [] if plain else [F.count(F.lit(1)).alias("__rows")]
    parts = [df.groupBy(*keys).agg(*(plain or marker))]
    if quantiles:
        parts.append(exact_quantiles(df, keys, quantiles))
    if modes:
        parts.append(most_common(df, keys, modes))
    return merge_by_keys(parts, keys).select(*[quoted(k) for k in keys], *[quoted(n) for n in names])


def aggregate_by_time(
    df: DataFrame,
    rules: Sequence[Mapping],
    ts: str = "timestamp",
    window_size: str = "1H",
    keys: Sequence[str] = (),
    slide: str | None = None,
) -> DataFrame:
    """The same rules per tumbling (or sliding) time window: adds ``window_start``."""
    length = f"{parse_window(window_size)} seconds"
    step = f"{parse_window(slide)} seconds" if slide else None
    windowed = df.withColumn("window_start", F.window(quoted(ts), length, step)["start"])
    return aggregate(windowed, rules, [*keys, "window_start"])


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Wide numeric results to ``(keys, metric, value)``; NULL values are kept."""
    columns = columns or [c for c in numeric_columns(df) if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("m"), number(quoted(c)).alias("v")) for c in columns])
    return df.select(*[quoted(k) for k in keys], F.explode(pairs).alias("__p")).select(
        *[quoted(k) for k in keys], F.col("__p.m").alias("metric"), F.col("__p.v").alias("value")
    )


def trends(history: DataFrame, keys: Sequence[str] = ("metric",), ts: str = "ts", value: str = "value") -> DataFrame:
    """First against last stored value: direction, change %, volatility (population std)."""
    v = number(quoted(value))
    stats = (
        history.filter(v.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_values"),
            F.min_by(v, quoted(ts)).alias("first_value"),
            F.max_by(v, quoted(ts)).alias("last_value"),
            F.stddev_pop(v).alias("volatility"),
        )
        .filter("n_values > 1")
    )
    change = (F.col("last_value") - F.col("first_value")) / F.nullif(F.col("first_value"), F.lit(0.0)) * 100
    return stats.select(
        *[quoted(k) for k in keys],
        F.when(F.col("last_value") > F.col("first_value"), "increasing").otherwise("decreasing").alias("trend"),
        F.coalesce(change, F.lit(0.0)).alias("change_percent"),
        "volatility",
    )


def result_quality(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quality of aggregate rows: share of non-null fields, share of numeric fields, timeliness 100."""
    fields = [c for c in df.columns if c not in keys]
    numeric = set(numeric_columns(df)) | {f.name for f in df.schema.fields if f.dataType == T.BooleanType()}

    def percent(columns: Sequence[str]) -> Column:
        hits = sum([F.when(quoted(c).isNotNull(), 1).otherwise(0) for c in columns], F.lit(0))
        return hits * F.lit(100.0) / F.lit(len(fields)) if fields else F.lit(0.0)

    return df.select(
        *[quoted(k) for k in keys],
        percent(fields).alias("completeness"),
        percent([c for c in fields if c in numeric]).alias("consistency"),
        F.lit(100.0).alias("timeliness"),
    )


def summary(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current metrics, trends of the stored ones, and quality, as ``(section, metric, value, note)``."""
    now = to_long(current, []).select(
        F.lit("current").alias("section"), "metric", "value", F.lit(None).cast("string").alias("note")
    )
    moved = trends(history).select(
        F.lit("trend").alias("section"), "metric", F.col("change_percent").alias("value"), F.col("trend").alias("note")
    )
    quality = to_long(result_quality(current), []).select(
        F.lit("quality").alias("section"), "metric", "value", F.lit(None).cast("string").alias("note")
    )
    return union_all([now, moved, quality])


def column_statistics(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population std, median, min, max, skewness, excess kurtosis and quartiles of castable values."""
    rows = df.select(*[quoted(k) for k in keys], number(quoted(value)).alias("__x")).filter("__x is not null")
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__x").alias("mean"),
        F.stddev_pop("__x").alias("std"),
        F.min("__x").alias("min"),
        F.max("__x").alias("max"),
        F.skewness("__x").alias("skew"),
        F.kurtosis("__x").alias("kurtosis"),
    )
    quartiles = exact_quantiles(rows, keys, {"median": ("__x", 0.5), "q25": ("__x", 0.25), "q75": ("__x", 0.75)})
    return merge_by_keys([moments, quartiles], keys)


def top_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """Most frequent values with their counts, smallest value first on a tie."""
    return (
        df.filter(quoted(column).isNotNull())
        .groupBy(quoted(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(limit)
    )


LAST_N = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}


def last_rows_aggregate(
    df: DataFrame,
    ts: str,
    size: int,
    wanted: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Aggregate the last ``size`` rows (per key): ``{output: (function, column)}``.

    A missing field counts as 0 and an unknown function gives 0.  Keys with
    fewer than ``size`` rows give no row here; ``short_rows`` has theirs.  The row limit is applied inside each
    task before the shuffle.
    """
    if keys:
        recent = newest_rows(df, keys, ts, size, tiebreak)
    else:
        recent = df.orderBy(F.desc(quoted(ts)), *[F.desc(quoted(t)) for t in tiebreak]).limit(size)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for out, (kind, column) in wanted.items():
        if kind == "count":
            expr = F.count(F.lit(1))
        elif kind in LAST_N:
            expr = LAST_N[kind](F.coalesce(number(quoted(column)), F.lit(0.0)))
        else:
            expr = F.max(F.lit(0.0))
        aggs.append(expr.alias(out))
    return recent.groupBy(*keys).agg(*aggs).filter(F.col("__n") >= size).drop("__n")


def short_rows(df: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """Rows of keys with fewer than ``size`` rows, unchanged: ``last_rows_aggregate`` has no window for them."""
    short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < size)
    short = short.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [quoted(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return df.join(short, same, "left_semi")


def last_rows_or_all(
    df: DataFrame, ts: str, size: int, wanted: Mapping[str, tuple[str, str]], keys: Sequence[str], tiebreak: Sequence[str] = ()
) -> DataFrame:
    """``last_rows_aggregate`` and, in the same result, the rows of keys with fewer than ``size`` rows unchanged.

    ``is_aggregate`` tells them apart; columns of the other kind are null.
    """
    made = last_rows_aggregate(df, ts, size, wanted, keys, tiebreak).withColumn("is_aggregate", F.lit(True))
    return made.unionByName(short_rows(df, size, keys).withColumn("is_aggregate", F.lit(False)), allowMissingColumns=True)
