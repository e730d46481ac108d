"""Result history: append every result, read the newest, read a time range; report export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import parse_window, quoted
from tidewatch.operators.windows import newest


def append(results: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    results.write.mode("append").partitionBy(*partition_by).parquet(path)


def kept(results: DataFrame, keys: Sequence[str], ts: str = "ts", limit: int | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest ``limit`` results per key (the limit is applied inside each task first); without a limit all of them."""
    return results if limit is None else newest(results, ts, limit, keys, tiebreak)


def history(results: DataFrame, key: str, value: str, limit: int = 100, ts: str = "ts", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest results of one key."""
    return newest(results.filter(quoted(key) == value), ts, limit, tiebreak=tiebreak)


def in_window(df: DataFrame, window: str, now: Column, ts: str = "ts") -> DataFrame:
    """Stored rows of the last ``24H``, ``7D``, ``1W``, ``1M`` before ``now`` (given, so that runs repeat)."""
    kind = df.schema[ts].dataType
    start = (now.cast("timestamp") - F.make_dt_interval(secs=F.lit(parse_window(window)))).cast(kind)
    return df.filter((quoted(ts) >= start) & (quoted(ts) <= now.cast(kind)))


def export_report(series: DataFrame, path: str, data_format: str = "csv") -> None:
    """Report rows ``(source, metric, timestamp, value)`` as CSV with a header, or as JSON lines."""
    rows = series.select("source", "metric", F.col("ts").alias("timestamp"), "value")
    if data_format == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    elif data_format == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown report format {data_format}")
