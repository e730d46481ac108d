"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Seconds per unit of a window length such as "24H" or "1M".
WINDOW_UNITS = {"H": 3600, "D": 86400, "W": 604800, "M": 2592000}


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """Column reference that survives dots and spaces in ``name``."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(c: str | Column) -> Column:
    """Value as DOUBLE; what cannot be cast, and NaN, become NULL."""
    d = col_of(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def truth(cond: Column) -> Column:
    """Three-valued condition as a plain boolean (NULL counts as false)."""
    return F.coalesce(cond, F.lit(False))


def share(cond: Column) -> Column:
    """Aggregate: fraction of rows for which ``cond`` is true."""
    return F.avg(F.when(truth(cond), 1.0).otherwise(0.0))


def micros(ts: str | Column) -> Column:
    """Timestamp (with or without zone) as microseconds since the epoch."""
    return F.unix_micros(col_of(ts).cast("timestamp"))


def seconds(ts: str | Column) -> Column:
    return micros(ts) / F.lit(1_000_000.0)


def same_type_literal(df: DataFrame, column: str, value) -> Column:
    """Literal cast to the type of ``column``, so that the comparison reaches the scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def parse_window(text: str | int) -> int:
    """Window length in seconds: ``24H``, ``7D``, ``1W``, ``1M`` (30 days) or plain seconds."""
    text = str(text)
    unit = text[-1:]
    if unit in WINDOW_UNITS:
        return int(text[:-1]) * WINDOW_UNITS[unit]
    return int(text)


def hash_bucket(c: str | Column, buckets: int) -> Column:
    """Stable bucket of a value: the first 32 bits of its MD5, modulo ``buckets``."""
    head = F.substring(F.md5(col_of(c).cast("string")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(buckets).cast("bigint"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_by_keys(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Put partial results side by side: one row per key, each column from the part that has it.

    A union and one small aggregate, so NULL keys match and no join is needed.
    """
    if len(parts) == 1:
        return parts[0]
    stacked = union_all(parts)
    outputs = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(quoted(c)).alias(c) for c in outputs])


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the right copies of the keys are dropped."""
    renamed = right.select(
        *[quoted(k).alias(f"__r{i}") for i, k in enumerate(keys)],
        *[quoted(c) for c in right.columns if c not in keys],
    )
    cond = reduce(
        lambda a, b: a & b,
        [quoted(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)],
    )
    return left.join(renamed, cond, how).drop(*[f"__r{i}" for i in range(len(keys))])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-key statistics to every row.

    Without keys the statistics are one row and come in as a scalar subquery;
    with keys it is an equi-join that AQE turns into a broadcast when the
    statistics turn out small and splits when a key is hot.
    """
    if keys:
        return join_on(df, stats, keys)
    row = stats.select(F.struct(*[quoted(c) for c in stats.columns])).scalar()
    return df.withColumn("__s", row).select(
        *[quoted(c) for c in df.columns], *[F.col(f"__s.`{c}`").alias(c) for c in stats.columns]
    )


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Numeric columns to long form ``(keys, name, value DOUBLE)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("n"), number(quoted(c)).alias("v")) for c in columns])
    return df.select(*[quoted(k) for k in keys], F.inline(pairs).alias(name, value))
