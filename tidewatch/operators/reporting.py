"""Report tables over metric series ``(source, metric, ts, value)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import number, quoted, union_all
from tidewatch.functions.ordered import exact_quantiles
from tidewatch.operators.windows import last_points_trend, newest

AGGREGATIONS = ("mean", "median", "std", "min", "max")
RESULT = ("query_id", "query_type", "metric", "metric2", "name", "value", "note")


def report_data(series: DataFrame, sources: Sequence[str], since: Column, until: Column | None = None) -> DataFrame:
    """Series of the wanted sources within the time range."""
    rows = series.filter(F.col("source").isin(*sources) & (F.col("ts") >= since))
    return rows if until is None else rows.filter(F.col("ts") <= until)


def _result(query: Mapping, **columns: Column) -> list[Column]:
    empty = F.lit(None).cast("string")
    base = {
        "query_id": F.lit(query["query_id"]), "query_type": F.lit(query["query_type"]), "metric": F.lit(query.get("metric")).cast("string"),
        "metric2": empty, "name": empty, "value": F.lit(None).cast("double"), "note": empty,
    }
    return [{**base, **columns}[c].alias(c) for c in RESULT]


def _results(stats: DataFrame, wanted: Sequence[tuple[Column, list[Column]]]) -> DataFrame:
    """Rows of the queries whose condition holds on a row of ``stats``."""
    return stats.select(F.inline(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(*cells)) for cond, cells in wanted]))))


def _of(series: DataFrame, queries: Sequence[Mapping]) -> DataFrame:
    return series.filter(F.col("metric").isin(*sorted({q["metric"] for q in queries})))


def _aggregation(query: Mapping) -> str:
    kind = query.get("aggregation", "mean")
    return kind if kind in AGGREGATIONS else "mean"


def aggregation_queries(series: DataFrame, queries: Sequence[Mapping]) -> DataFrame:
    """Mean, median, population std, min or max of one metric each; an unknown name gives the mean.

    All metrics and measures come from one aggregate by metric, all medians from a second one.
    """
    plain = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    parts = []
    for medians in (False, True):
        own = [q for q in queries if (_aggregation(q) == "median") == medians]
        if not own:
            continue
        if medians:
            stats = exact_quantiles(_of(series, own), ["metric"], {"median": ("value", 0.5)})
        else:
            x = number("value")
            stats = _of(series, own).groupBy("metric").agg(*[plain[k](x).alias(k) for k in sorted({_aggregation(q) for q in own})])
        parts.append(_results(stats, [
            ((F.col("metric") == q["metric"]) & F.col(_aggregation(q)).isNotNull(),
             _result(q, name=F.lit(q.get("aggregation", "mean")), value=F.col(_aggregation(q)).cast("double")))
            for q in own
        ]))
    return union_all(parts)


def trend_queries(series: DataFrame, queries: Sequence[Mapping]) -> DataFrame:
    """Slope of the last ``window_size`` points: direction and strength.  One pass per window size."""
    windows: dict[int, list[Mapping]] = {}
    for q in queries:
        windows.setdefault(int(q.get("window_size", 10)), []).append(q)
    note = F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return union_all([
        _results(last_points_trend(_of(series, own), ["metric"], "ts", "value", n),
                 [(F.col("metric") == q["metric"], _result(q, name=F.lit("slope"), value=F.col("slope"), note=note)) for q in own])
        for n, own in windows.items()
    ])


def correlation_queries(series: DataFrame, queries: Sequence[Mapping]) -> DataFrame:
    """Correlation of two metrics aligned on time: strong above 0.7, moderate above 0.3, else weak.

    The metrics of all queries become columns of one table by time, all pairs come from one aggregate over it.
    """
    metrics = sorted({q[m] for q in queries for m in ("metric1", "metric2")})
    at = {m: f"m{i}" for i, m in enumerate(metrics)}
    wide = series.filter(F.col("metric").isin(*metrics)).groupBy("ts").agg(
        *[F.avg(F.when(F.col("metric") == m, number("value"))).alias(c) for m, c in at.items()]
    )
    # a time that lacks one of the two metrics is no pair
    pairs = wide.agg(*[F.corr(at[q["metric1"]], at[q["metric2"]]).alias(f"r{i}") for i, q in enumerate(queries)])

    def cells(i: int, q: Mapping) -> tuple[Column, list[Column]]:
        r, size = F.col(f"r{i}"), F.abs(f"r{i}")
        return r.isNotNull(), _result(
            q, metric=F.lit(q["metric1"]), metric2=F.lit(q["metric2"]), name=F.lit("correlation"), value=r,
            note=F.when(size > 0.7, "strong").when(size > 0.3, "moderate").otherwise("weak"),
        )

    return _results(pairs, [cells(i, q) for i, q in enumerate(queries)])


def custom_queries(series: DataFrame, queries: Sequence[Mapping]) -> DataFrame:
    """SQL texts over ``{series}`` that yield ``name, value`` rows."""
    return union_all([
        series.sparkSession.sql(q["sql"], series=series).select(*_result(q, name=F.col("name").cast("string"), value=F.col("value").cast("double")))
        for q in queries
    ])


QUERIES = {
    "aggregation": aggregation_queries, "trend": trend_queries, "correlation": correlation_queries, "custom": custom_queries,
}


def run_queries(series: DataFrame, queries: Sequence[Mapping]) -> DataFrame:
    """Results of all enabled queries in one table; unknown kinds are skipped, no query gives an empty table.

    Queries are compiled by kind: the series is read once per kind (medians and every window size of trends are kinds of
    their own, custom SQL reads it for itself), not once per query.
    """
    kinds: dict[str, list[Mapping]] = {}
    for q in queries:
        if q.get("enabled", True) and q["query_type"] in QUERIES:
            kinds.setdefault(q["query_type"], []).append(q)
    if not kinds:
        return series.sparkSession.createDataFrame([], ", ".join(f"{c} {'double' if c == 'value' else 'string'}" for c in RESULT))
    return union_all([QUERIES[kind](series, own) for kind, own in kinds.items()])


def insights(series: DataFrame, alerts: DataFrame | None = None, accuracy: str = "accuracy", drift: str = "drift_score") -> DataFrame:
    """Key insights and recommendations: ``(kind, text)``."""
    s = series.agg(
        F.avg(F.when(F.col("metric") == accuracy, number("value"))).alias("acc"),
        F.max(F.when(F.col("metric") == drift, number("value"))).alias("drift"),
    )
    # Texts of the report summary.
    lines = [
        ("key_insight", F.col("acc").isNotNull(), F.format_string("Average accuracy: %.3f", "acc")),
        ("recommendation", F.col("acc") < 0.9, F.lit("Consider model retraining due to low accuracy")),
        ("key_insight", F.col("drift").isNotNull(), F.format_string("Maximum drift score: %.3f", "drift")),
        ("recommendation", F.col("drift") > 0.1, F.lit("High data drift detected - investigate data quality")),
    ]

    def rows(df: DataFrame, items: Sequence[tuple[str, Column, Column]]) -> DataFrame:
        made = F.array_compact(F.array(*[
            F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(k).alias("kind"), text.alias("text"))) for k, cond, text in items
        ]))
        return df.select(F.inline(made))

    parts = [rows(s, lines)]
    if alerts is not None:
        active = alerts.agg(F.count_if(F.col("status") == "active").alias("n"))
        parts.append(rows(active, [
            ("key_insight", F.lit(True), F.format_string("Active alerts: %d", "n")),
            ("recommendation", F.col("n") > 5, F.lit("High number of active alerts - review system health")),
        ]))
    return union_all(parts)


def chart_series(series: DataFrame, metrics: Sequence[str], bucket: str = "1 hour") -> DataFrame:
    """Time-bucketed points per metric for line charts."""
    rows = series.filter(F.col("metric").isin(*metrics))
    return rows.groupBy("metric", F.window("ts", bucket)["start"].alias("bucket")).agg(F.avg(number("value")).alias("value"))


def chart_counts(alerts: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts and percents per value of each dimension, for pies and bars."""
    grouped = alerts.groupingSets([[F.col(d)] for d in dimensions] + [[]], *dimensions).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dimensions]
    )
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in dimensions:
        name = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"g_{d}") == 0, quoted(d).cast("string")).otherwise(value)
    rows = grouped.select(name.alias("dimension"), value.alias("value"), "n")
    total = alerts.agg(F.count(F.lit(1)).alias("t")).select("t").scalar()
    return rows.withColumn("percent", F.col("n") * 100.0 / F.nullif(total, F.lit(0)))


def due(configs: DataFrame, now: Column, tolerance_seconds: int = 300) -> DataFrame:
    """Enabled reports due at ``now`` (±5 minutes): daily, weekly on Monday, monthly on day 1.

    ``configs``: ``(report_id, frequency, at 'HH:mm', enabled)``.
    """
    t = now.cast("timestamp")
    minute_of_day = F.split_part("at", F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part("at", F.lit(":"), F.lit(2)).cast("int")
    since_midnight = F.unix_timestamp(t) - F.unix_timestamp(F.date_trunc("day", t))
    near = F.abs(since_midnight - minute_of_day * 60) < tolerance_seconds
    kind = F.coalesce("frequency", F.lit("daily"))
    right_day = F.when(kind == "daily", True).when(kind == "weekly", F.weekday(t) == 0).otherwise(F.day(t) == 1)
    return configs.filter(F.col("enabled") & F.col("at").isNotNull() & near & right_day)


def summary(configs: DataFrame, generated: DataFrame) -> DataFrame:
    """Configurations in all, active, by type, and reports generated: ``(dimension, value, n)``."""
    c = configs.agg(F.count(F.lit(1)).alias("a"), F.count_if("enabled").alias("b"))
    none = F.lit(None).cast("string")
    return union_all([
        c.select(F.lit("total_configs").alias("dimension"), none.alias("value"), F.col("a").alias("n")),
        c.select(F.lit("active_configs").alias("dimension"), none.alias("value"), F.col("b").alias("n")),
        configs.groupBy("report_type").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("report_type").alias("dimension"), F.col("report_type").alias("value"), "n"),
        generated.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_generated").alias("dimension"), none.alias("value"), "n"),
    ])


def recent(generated: DataFrame, limit: int = 10) -> DataFrame:
    return newest(generated, "generated_at", limit, tiebreak=["report_id"])
