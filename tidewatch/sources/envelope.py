"""Ingest envelope and reads of what a source delivered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import quoted
from tidewatch.operators.windows import newest


def wrap(df: DataFrame, source_id: str, now: Column | None = None) -> DataFrame:
    """``{data, metadata{source_id, timestamp, batch_id}}`` around every record."""
    at = (now if now is not None else F.current_timestamp()).cast("timestamp")
    batch = F.concat_ws("_", F.lit(source_id), F.unix_timestamp(at).cast("string"))
    return df.select(
        F.struct(*[quoted(c) for c in df.columns]).alias("data"),
        F.struct(F.lit(source_id).alias("source_id"), at.alias("timestamp"), batch.alias("batch_id")).alias("metadata"),
    )


def unwrap(enveloped: DataFrame) -> DataFrame:
    """The records themselves, so that rules and features find their fields."""
    return enveloped.select("data.*")


def recent_records(
    df: DataFrame, source_id: str, limit: int = 100, source: str = "source_id", ts: str = "ts", tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Most recent records of one source; ``tiebreak`` columns decide, largest first, between records of one time."""
    return newest(df.filter(quoted(source) == source_id), ts, limit, tiebreak)


def pending_counts(df: DataFrame, source: str = "source_id") -> DataFrame:
    """Records waiting per source."""
    return df.groupBy(quoted(source)).agg(F.count(F.lit(1)).alias("queue_size"))
