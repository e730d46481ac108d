"""Retention: selection for archiving, cold layout, purge, age distribution.

Policies: ``(policy_id, source_id, hot_days, warm_days, cold_days, archival_enabled, cleanup_enabled)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.common import micros, quoted, same_type_literal

POLICY_SCHEMA = (
    "policy_id string, source_id string, hot_days int, warm_days int, cold_days int, archival_enabled boolean, cleanup_enabled boolean"
)
# Lifetimes in days when a policy names none.
DEFAULT_DAYS = {"hot_days": 7, "warm_days": 30, "cold_days": 365}
DAY_MICROS = 86_400_000_000


def policies_table(spark: SparkSession, policies: Sequence[Mapping]) -> DataFrame:
    """Policy configuration as a table (as many rows as the caller wrote down)."""
    base = {**DEFAULT_DAYS, "archival_enabled": True, "cleanup_enabled": True}
    names = [c.split()[0] for c in POLICY_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**base, **p}[n] for n in names) for p in policies], POLICY_SCHEMA)


def age_days(ts: Column, now: Column) -> Column:
    """Whole days between ``ts`` and ``now``."""
    return F.floor((micros(now) - micros(ts)) / F.lit(DAY_MICROS))


def with_policy(records: DataFrame, policies: Sequence[Mapping], source: str = "source_id") -> DataFrame:
    """Attach the policy of the source; the policy list is configuration, hence the broadcast."""
    table = F.broadcast(policies_table(records.sparkSession, policies).withColumnRenamed("source_id", "__src"))
    return records.join(table, quoted(source) == F.col("__src")).drop("__src")


def split_hot(records: DataFrame, policies: Sequence[Mapping], now: Column, ts: str = "ts", source: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(rows to archive, rows that stay hot).  Rows of sources without a policy stay.

    One pass with a flag; nothing is shuffled.
    """
    table = F.broadcast(policies_table(records.sparkSession, policies).select(F.col("source_id").alias("__src"), "hot_days", "archival_enabled"))
    flagged = records.join(table, quoted(source) == F.col("__src"), "left").withColumn(
        "__old", F.coalesce(quoted(ts).cast("timestamp") < now - F.make_dt_interval(days=F.col("hot_days")), F.lit(False))
    )
    columns = [quoted(c) for c in records.columns]
    return flagged.filter("__old").select(*columns, "archival_enabled"), flagged.filter("NOT __old").select(*columns)


def write_cold(records: DataFrame, path: str, now: Column, source: str = "source_id", compress: bool = True) -> None:
    """Archive as JSON in ``source_id=…/year=…/month=…`` folders, gzip by default."""
    rows = records.withColumns({"source_id": quoted(source), "year": F.date_format(now, "yyyy"), "month": F.date_format(now, "MM")})
    writer = rows.hint("rebalance", F.col("source_id")).write.mode("append").partitionBy("source_id", "year", "month")
    writer.option("compression", "gzip" if compress else "none").json(path)


def expired(records: DataFrame, policies: Sequence[Mapping], now: Column, tier: str, ts: str = "ts", source: str = "source_id") -> DataFrame:
    """Rows of a warm or cold tier that outlived their policy (only policies with cleanup enabled)."""
    days = F.col({"warm": "warm_days", "cold": "cold_days"}[tier])
    joined = with_policy(records, policies, source)
    old = quoted(ts).cast("timestamp") < now - F.make_dt_interval(days=days)
    return joined.filter(F.col("cleanup_enabled") & old).select(*[quoted(c) for c in records.columns])


def age_distribution(records: DataFrame, policies: Sequence[Mapping], now: Column, ts: str = "ts", source: str = "source_id") -> DataFrame:
    """Rows per policy and age class, all policies in one job: ``(policy_id, queue_size, hot, warm, cold)``."""
    aged = with_policy(records, policies, source).withColumn("__age", age_days(quoted(ts), now))
    hot, warm = F.col("__age") <= F.col("hot_days"), F.col("__age") <= F.col("warm_days")
    return aged.groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("queue_size"), F.count_if(hot).alias("hot"),
        F.count_if(~hot & warm).alias("warm"), F.count_if(~hot & ~warm).alias("cold"),
    )


def report(records: DataFrame, policies: Sequence[Mapping], now: Column, ts: str = "ts", source: str = "source_id") -> DataFrame:
    """Age distribution next to the policy settings; a policy without records has zeros."""
    ages = age_distribution(records, policies, now, ts, source)
    table = policies_table(records.sparkSession, policies)
    zero = ("queue_size", "hot", "warm", "cold")
    return table.join(ages, "policy_id", "left").withColumns({c: F.coalesce(quoted(c), F.lit(0).cast("bigint")) for c in zero})


def purge_older(df: DataFrame, ts: str, now, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row with the number deleted) for data older than ``days`` before ``now``.

    ``now`` is a date text or datetime, so the cut-off is a literal that
    reaches the file scan.
    """
    import pandas as pd

    cutoff = same_type_literal(df, ts, str(pd.Timestamp(now) - pd.Timedelta(days=days)))
    old = quoted(ts) < cutoff
    return df.filter(~F.coalesce(old, F.lit(False))), df.filter(old).agg(F.count(F.lit(1)).alias("deleted_count"))


def purge_partitions(spark: SparkSession, path: str, ts: str, now, days: int, partition_by: Sequence[str]) -> int:
    """Delete expired rows of a stored table by rewriting only the partitions that hold some; returns the count.

    Partition values are the text in the folder names, so a null and ``007`` are partitions like others.  The kept rows of
    the partitions are staged in the checkpoint folder first, because a table cannot be overwritten while it is read.
    Folders without a kept row go last; a run that ends in between leaves expired rows only, and the next one takes them.
    """
    import pandas as pd

    from tidewatch.session import cut_lineage
    from tidewatch.sources import folders
    from tidewatch.sources.storage import read_text_keys

    df = read_text_keys(spark, path, partition_by)
    old = F.coalesce(quoted(ts) < same_type_literal(df, ts, str(pd.Timestamp(now) - pd.Timedelta(days=days))), F.lit(False))
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("__folder")
    hit = cut_lineage(df.filter(old).select(folder).groupBy("__folder").agg(F.count(F.lit(1)).alias("__n")))
    count = hit.agg(F.sum("__n").alias("n")).head()["n"]
    if not count:
        return 0
    staged = cut_lineage(df.filter(~old).select("*", folder).join(hit.select("__folder"), "__folder", "left_semi"))
    empty = hit.join(staged.select("__folder").distinct(), "__folder", "left_anti").select("__folder")
    staged.drop("__folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    folders.drop(spark, (r["__folder"] for r in empty.toLocalIterator()), encoded=True)
    return count
