"""Feature building: datetime parts, bins, scaling, encodings, interactions, derived fields."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import attach, join_on, merge_by_keys, number, quoted, seconds, share, union_all
from tidewatch.functions.ordered import dense_codes, exact_quantiles
from tidewatch.operators import windows
from tidewatch.operators.aggregates import column_statistics
from tidewatch.operators.quality import outside_iqr, parsed_time



def datetime_parts(df: DataFrame, column: str) -> DataFrame:
    """Year, month, day, hour, day of week (Monday = 0) and weekend flag."""
    if column not in df.columns:
        return df
    t = quoted(column).cast("timestamp")
    return df.select(
        "*",
        F.year(t).alias(f"{column}_year"),
        F.month(t).alias(f"{column}_month"),
        F.day(t).alias(f"{column}_day"),
        F.hour(t).alias(f"{column}_hour"),
        F.weekday(t).alias(f"{column}_dayofweek"),
        (F.weekday(t) >= 5).alias(f"{column}_is_weekend"),
    )


def bin_equal_width(df: DataFrame, column: str, bins: int = 10, labels: Sequence | None = None, output: str | None = None) -> DataFrame:
    """Equal-width bins over the observed range, closed on the right; the lowest value falls into bin 0.

    A constant column is widened by 0.1 % on both sides, so its value lands in the middle bin.
    """
    if column not in df.columns:
        return df
    out = output or f"{column}_binned"
    x = number(quoted(column))
    limits = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    pad = F.when(lo != 0, F.abs(lo) * 0.001).otherwise(0.001)
    flat = lo == hi
    left = F.when(flat, lo - pad).otherwise(lo)
    width = (F.when(flat, hi + pad).otherwise(hi) - left) / bins
    code = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((x - left) / width))).cast("int") - 1
    result = F.element_at(F.array(*[F.lit(v) for v in labels]), code + 1) if labels else code
    return attach(df, limits, []).withColumn(out, F.when(x.isNotNull(), result)).drop("__lo", "__hi")


def bin_by_edges(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence | None = None, output: str | None = None) -> DataFrame:
    """Bins ``(a, b]`` from explicit edges; outside, and equal to the lowest edge, is NULL."""
    if column not in df.columns:
        return df
    x = number(quoted(column))
    names = list(labels) if labels else list(range(len(edges) - 1))
    code = F.lit(None)
    for a, b, name in reversed(list(zip(edges, edges[1:], names))):
        code = F.when((x > float(a)) & (x <= float(b)), F.lit(name)).otherwise(code)
    return df.withColumn(output or f"{column}_binned", code)


def _centre_and_spread(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """One statistics row: ``c<i>`` and ``s<i>`` per column."""
    xs = {i: number(quoted(c)) for i, c in enumerate(columns)}
    if method == "robust":
        wanted = {
            f"q{j}.{i}": (c, q) for i, c in enumerate(columns) for j, q in (("1", 0.25), ("2", 0.5), ("3", 0.75))
        }
        q = exact_quantiles(df, [], wanted)
        return q.select(*[
            e for i in xs
            for e in (quoted(f"q2.{i}").alias(f"c{i}"), (quoted(f"q3.{i}") - quoted(f"q1.{i}")).alias(f"s{i}"))
        ])
    centre = {"z_score": F.avg, "standard": F.avg, "min_max": F.min, "minmax": F.min}[method]
    spread: Callable[[Column], Column] = {
        "z_score": F.stddev_samp, "standard": F.stddev_pop,
        "min_max": lambda x: F.max(x) - F.min(x), "minmax": lambda x: F.max(x) - F.min(x),
    }[method]
    return df.agg(*[e for i, x in xs.items() for e in (centre(x).alias(f"c{i}"), spread(x).alias(f"s{i}"))])


def normalize(df: DataFrame, columns: Sequence[str], method: str = "z_score", suffix: str = "_normalized") -> DataFrame:
    """``z_score`` (sample std), ``min_max`` or ``robust`` (median, IQR); a zero spread gives NULL."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    stats = _centre_and_spread(df, present, method)
    out = attach(df, stats, [])
    return out.select(*[quoted(c) for c in df.columns], *[
        F.try_divide(number(quoted(c)) - F.col(f"c{i}"), F.col(f"s{i}")).alias(f"{c}{suffix}")
        for i, c in enumerate(present)
    ])


def scale(df: DataFrame, column: str, scaler: str = "standard", output: str | None = None) -> DataFrame:
    """``standard`` (population std) or ``minmax`` scaling; a constant column becomes 0."""
    x = number(quoted(column))
    stats = _centre_and_spread(df, [column], scaler)
    scaled = F.when(F.col("s0") == 0, F.lit(0.0)).otherwise((x - F.col("c0")) / F.col("s0"))
    return attach(df, stats, []).withColumn(output or f"{column}_scaled", F.when(x.isNotNull(), scaled)).drop("c0", "s0")


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """Boolean column ``{column}_{value}`` per value in sorted order; NULL is false everywhere.

    The values become the schema: without ``values`` a job finds them first.
    """
    if values is None:
        found = df.select(quoted(column).alias("v")).filter("v is not null").distinct().collect()
        values = sorted(r["v"] for r in found)
    return df.select(
        "*", *[F.coalesce(quoted(column) == F.lit(v), F.lit(False)).alias(f"{column}_{v}") for v in values]
    )


def label_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """0-based code of the value in sorted order; NULL is -1."""
    codes = dense_codes(df, column).withColumnRenamed(column, "__v")
    joined = df.join(codes, quoted(column) == F.col("__v"), "left").drop("__v")
    return joined.withColumn(output or f"{column}_encoded", F.coalesce("code", F.lit(-1))).drop("code")


def frequency_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Value → number of rows that have it; NULL stays NULL."""
    freq = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    joined = df.join(freq, quoted(column) == F.col("__v"), "left").drop("__v")
    return joined.withColumnRenamed("__n", output or f"{column}_freq")


def interaction(df: DataFrame, columns: Sequence[str], kind: str = "multiply", output: str | None = None) -> DataFrame:
    """Product, quotient (÷0 is NULL), sum or difference of two columns."""
    if len(columns) < 2 or any(c not in df.columns for c in columns[:2]):
        return df
    a, b = quoted(columns[0]), quoted(columns[1])
    table = {"multiply": lambda: a * b, "divide": lambda: F.try_divide(a, b), "add": lambda: a + b, "subtract": lambda: a - b}
    if kind not in table:
        return df
    return df.withColumn(output or f"{columns[0]}_{columns[1]}_interaction", table[kind]())


def apply_steps(df: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Feature steps in order; unknown steps are ignored, absent columns skipped."""
    for s in steps:
        kind = s.get("type")
        if kind == "extract_datetime":
            df = datetime_parts(df, s["column"])
        elif kind == "create_categorical":
            bins = s.get("bins", 10)
            make = bin_equal_width if isinstance(bins, int) else bin_by_edges
            df = make(df, s["column"], bins, s.get("labels"), s.get("new_column"))
        elif kind == "calculate_rolling" and s["column"] in df.columns:
            df = windows.rolling(
                df, s["column"], s["order_by"], s.get("window", 5), s.get("functions", ("mean", "std")),
                s.get("keys", ()), s.get("tiebreak", ()),
            )
        elif kind == "normalize":
            df = normalize(df, s.get("columns", ()), s.get("method", "z_score"))
        elif kind == "encode_categorical":
            encode = {"one_hot": one_hot, "label": label_encode, "frequency": frequency_encode}.get(s.get("method", "one_hot"))
            for c in s.get("columns", ()):
                if c in df.columns and encode:
                    df = encode(df, c)
        elif kind == "create_interaction":
            df = interaction(df, s.get("columns", ()), s.get("interaction_type", "multiply"), s.get("new_column"))
        elif kind == "custom_function" and s.get("function"):
            df = df.transform(s["function"])
    return df


def numeric_feature(df: DataFrame, fields: Sequence[str], output: str = "feature") -> DataFrame:
    """First present source field as a number; rows that cannot be cast are dropped."""
    return df.withColumn(output, number(F.coalesce(*[quoted(f) for f in fields]))).filter(quoted(output).isNotNull())


def datetime_feature(df: DataFrame, column: str, kind: str = "timestamp", output: str = "feature") -> DataFrame:
    """Epoch seconds, hour, day of week (Monday = 0) or month; unparsable rows are dropped."""
    t = parsed_time(quoted(column)) if dict(df.dtypes)[column] == "string" else quoted(column).cast("timestamp")
    table = {"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t)}
    return df.withColumn(output, table.get(kind, seconds(t)).cast("double")).filter(t.isNotNull())


def date_range(df: DataFrame, column: str) -> DataFrame:
    t = quoted(column).cast("timestamp")
    return df.agg(F.min(t).alias("min_ts"), F.max(t).alias("max_ts"), F.count(t).alias("source_count"))


def text_length(df: DataFrame, column: str, output: str = "feature") -> DataFrame:
    return df.filter(quoted(column).isNotNull()).withColumn(output, F.length(quoted(column)))


def text_metadata(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    n = F.length(quoted(column))
    return df.groupBy(*keys).agg(
        F.count(n).alias("source_count"), F.avg(n).alias("avg_length"), F.max(n).alias("max_length")
    )


def derive_concat(columns: Sequence[str]) -> Column:
    """Non-null values joined with ``_``."""
    return F.concat_ws("_", *[quoted(c).cast("string") for c in columns])


def derive_sum(columns: Sequence[str]) -> Column:
    """Sum of castable values; others count 0."""
    return sum([F.coalesce(number(quoted(c)), F.lit(0.0)) for c in columns], F.lit(0.0))


def quality_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Completeness × (1 − IQR-outlier share) per feature, within 0…1: ``(feature, quality_score)``."""
    from tidewatch.operators.quality import outlier_bounds

    bounded = attach(df, outlier_bounds(df, columns), [])
    aggs = []
    for i, c in enumerate(columns):
        x = number(quoted(c))
        out = outside_iqr(x, quoted(f"{c}.q1"), quoted(f"{c}.q3"))
        aggs += [
            share(quoted(c).isNotNull()).alias(f"f{i}"),
            F.coalesce(F.try_divide(F.count_if(out).cast("double"), F.count(x)), F.lit(0.0)).alias(f"o{i}"),
        ]
    score = [
        F.struct(
            F.lit(c).alias("feature"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(f"f{i}"), F.lit(0.0)) * (1 - F.col(f"o{i}")))).alias("quality_score"),
        )
        for i, c in enumerate(columns)
    ]
    return bounded.agg(*aggs).select(F.inline(F.array(*score)))


def statistics(df: DataFrame, column: str) -> DataFrame:
    """Mean, population std, min, max and median of castable values."""
    return column_statistics(df, column).select("mean", "std", "min", "max", "median")


def summary(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Per feature mean quality and last run; ``(section, name, value)`` rows with counts by type and the overall mean.

    ``results``: ``(feature, quality_score, ts)``; ``registry``: ``(feature, feature_type, enabled)``.
    """
    per = results.groupBy("feature").agg(F.avg("quality_score").alias("avg_quality_score"), F.max("ts").alias("last_engineered"))
    detail = join_on(registry, per, ["feature"])

    def rows(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))

    counts = registry.agg(F.count(F.lit(1)).alias("t"), F.count_if("enabled").alias("a"))
    types = registry.groupBy("feature_type").agg(F.count(F.lit(1)).alias("n"))
    overall = merge_by_keys([detail.agg(F.avg("avg_quality_score").alias("q"))], [])
    return union_all([
        rows(counts, "summary", F.lit("total_features"), F.col("t")),
        rows(counts, "summary", F.lit("active_features"), F.col("a")),
        rows(overall, "summary", F.lit("overall_quality_score"), F.coalesce("q", F.lit(0.0))),
        rows(types, "feature_types", F.col("feature_type"), F.col("n")),
        rows(detail, "feature_quality", F.col("feature"), F.col("avg_quality_score")),
    ])


def engineer(df: DataFrame, config: Mapping) -> DataFrame:
    """One configured feature as column ``feature_name``.

    ``config``: ``{feature_name, feature_type, source_fields, transformation,
    parameters}`` with type numeric, categorical, text, datetime or derived.
    Rows without a usable value are dropped, except for derived features.
    """
    name, kind = config["feature_name"], config["feature_type"]
    fields, how, params = config["source_fields"], config.get("transformation", "none"), config.get("parameters", {})
    if kind == "derived":
        if how == "custom" and params.get("function"):
            return df.transform(params["function"])
        make = {"concat": derive_concat, "sum": derive_sum}.get(params.get("operation", "concat"))
        return df.withColumn(name, make(fields)) if make else df
    if kind == "numeric":
        rows = numeric_feature(df, fields, name)
        if how == "scale" and params.get("scaler_type", "standard") in ("standard", "minmax"):
            return scale(rows, name, params.get("scaler_type", "standard"), name)
        if how == "aggregate":
            rolled = windows.trailing(
                rows, name, params["order_by"], params.get("agg_type", "mean"), params.get("window_size", 10),
                params.get("keys", ()), params.get("tiebreak", ()), output="__rolled",
            )
            return rolled.withColumn(name, F.col("__rolled")).drop("__rolled")
        return rows
    first = F.coalesce(*[quoted(f) for f in fields])
    if kind == "datetime":
        rows = df.withColumn("__t", first)
        if how == "extract":
            return datetime_feature(rows, "__t", params.get("extraction_type", "timestamp"), name).drop("__t")
        t = parsed_time(F.col("__t")) if dict(rows.dtypes)["__t"] == "string" else F.col("__t").cast("timestamp")
        return rows.withColumn(name, t).filter(quoted(name).isNotNull()).drop("__t")
    rows = df.withColumn(name, first.cast("string")).filter(quoted(name).isNotNull())
    if kind == "categorical" and how == "encode":
        return label_encode(rows, name, "__code").withColumn(name, F.col("__code")).drop("__code")
    if kind == "text" and how == "extract":
        if params.get("extraction_type", "tfidf") == "tfidf":
            from tidewatch.operators.text import first_term_weight

            weights = first_term_weight(rows, params["doc_id"], name, params.get("max_terms", 100))
            return rows.drop(name).join(weights.withColumnRenamed("feature", name), params["doc_id"])
        return rows.withColumn(name, F.length(quoted(name)))
    return rows
