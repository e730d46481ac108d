"""Tiered storage as partitioned folders: ``base/tier/data_type=…/partition_key=…``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.common import hash_bucket, quoted, same_type_literal, union_all

TIERS = ("hot", "warm", "cold")
# Data types that go to the structured side of the warm tier.
STRUCTURED_TYPES = ("metrics", "logs", "traces")
KEYS = ("data_type", "partition_key")  # the folders of a tier


def check_tier(tier: str) -> str:
    if tier not in TIERS:
        raise ValueError(f"unknown storage tier {tier}")
    return tier


def partition_key(strategy: Mapping | None, ts: Column) -> Column:
    """Partition value by ``date`` (default), ``hour``, ``field`` or ``hash`` bucket of a field."""
    strategy = strategy or {}
    kind, t = strategy.get("type", "date"), ts.cast("timestamp")
    if kind == "hour":
        return F.date_format(t, "yyyy-MM-dd-HH")
    if kind == "field":
        return F.coalesce(quoted(strategy["field"]).cast("string"), F.lit("unknown"))
    if kind == "hash":
        value = F.coalesce(quoted(strategy["field"]).cast("string"), F.lit(""))
        return hash_bucket(value, int(strategy.get("num_partitions", 10))).cast("string")
    return F.date_format(t, "yyyy-MM-dd")


def warm_kind(data_type: Column) -> Column:
    return F.when(data_type.isin(*STRUCTURED_TYPES), "structured").otherwise("document")


def prepare(df: DataFrame, data_type: str, tier: str, ts: str, strategy: Mapping | None = None) -> DataFrame:
    """Add ``data_type``, ``storage_tier`` and ``partition_key``."""
    return df.withColumns({
        "data_type": F.lit(data_type), "storage_tier": F.lit(check_tier(tier)), "partition_key": partition_key(strategy, quoted(ts)),
    })


def store(df: DataFrame, base: str, data_type: str, tier: str, ts: str, strategy: Mapping | None = None) -> None:
    """Append to a tier.

    Rows are rebalanced by partition value before the write: few files per
    partition, and AQE splits a partition that holds most of the rows.
    """
    rows = prepare(df, data_type, tier, ts, strategy).drop("storage_tier")
    if tier == "warm" and data_type not in STRUCTURED_TYPES:
        body = F.to_json(F.struct(*[quoted(c) for c in df.columns]))
        rows = rows.select(quoted(ts).alias("ts"), body.alias("document"), "data_type", "partition_key")
    rows.hint("rebalance", F.col("partition_key")).write.mode("append").partitionBy("data_type", "partition_key").parquet(
        f"{base}/{tier}"
    )


def store_by_tier(df: DataFrame, base: str, data_type: str, tier_column: str, ts: str, strategy: Mapping | None = None) -> DataFrame:
    """Route rows to the tier named in a column; returns the refused rows (unknown or missing tier)."""
    for tier in TIERS:
        store(df.filter(quoted(tier_column) == tier).drop(tier_column), base, data_type, tier, ts, strategy)
    return df.filter(~F.coalesce(quoted(tier_column).isin(*TIERS), F.lit(False)))


INFER = "spark.sql.sources.partitionColumnTypeInference.enabled"


def read_text_keys(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A Parquet table partitioned by ``keys``, which are read as the text in the folder names: ``007`` stays apart from ``7``.

    The folders are listed once; types are not guessed from their names.
    """
    before = spark.conf.get(INFER)
    spark.conf.set(INFER, "false")
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.set(INFER, before)
    other = [f.name for f in df.schema if f.name in keys and not isinstance(f.dataType, T.StringType)]
    if other:
        raise ValueError(f"{other} are no partition columns of {path}")
    return df


def retrieve(
    spark: SparkSession, base: str, tier: str, data_type: str, ts: str, start=None, end=None, key: str | None = None, limit: int | None = None,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Rows of a type, newest first: type and key prune folders, the time range reaches the file scan."""
    df = read_text_keys(spark, f"{base}/{check_tier(tier)}", KEYS).filter(F.col("data_type") == data_type)
    if key is not None:
        df = df.filter(F.col("partition_key") == key)
    if start is not None:
        df = df.filter(quoted(ts) >= same_type_literal(df, ts, start))
    if end is not None:
        df = df.filter(quoted(ts) <= same_type_literal(df, ts, end))
    return df.orderBy(F.desc(quoted(ts)), *[F.desc(quoted(c)) for c in tiebreak]).limit(limit) if limit else df


def statistics(spark: SparkSession, base: str, tiers: Sequence[str] = TIERS) -> DataFrame:
    """Rows, files and bytes per tier, type and partition; a folder that is not there gives no rows."""
    parts = []
    for tier in tiers:
        try:
            df = read_text_keys(spark, f"{base}/{check_tier(tier)}", KEYS)
        except Exception as exc:  # the tier has not been written yet
            if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
                continue
            raise
        files = df.groupBy("data_type", "partition_key", F.col("_metadata.file_path").alias("f")).agg(
            F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("b")
        )
        parts.append(files.groupBy("data_type", "partition_key").agg(
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes")
        ).withColumn("tier", F.lit(tier)))
    if not parts:
        return spark.createDataFrame([], "data_type string, partition_key string, rows bigint, files bigint, bytes bigint, tier string")
    return union_all(parts)


def store_batch(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def retrieve_batch(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.limit(limit) if limit else df
