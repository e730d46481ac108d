"""Batch and stream readers (files, object store, Kafka, Event Hubs, JDBC)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("json", "csv", "avro", "parquet", "orc", "text")


class Tables:
    """Tables of one folder, read on access: ``Tables(spark, path).events``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Source:
    """Declaration of a source; ``options`` go to the reader unchanged."""

    source_id: str
    path: str | None = None
    data_format: str = "parquet"
    schema: T.StructType | str | None = None
    batch_size: int = 1000
    options: Mapping[str, str] = field(default_factory=dict)


def read_files(spark: SparkSession, source: Source) -> DataFrame:
    """Read a path or an object-store prefix (``s3a://…/*``) in the declared format.

    Listing is done by Spark's file index, so there is no page limit.  ``avro``
    needs the external avro package on the cluster.
    """
    if source.data_format not in FORMATS:
        raise ValueError(f"unknown format {source.data_format}")
    reader = spark.read.format(source.data_format).options(**dict(source.options))
    if source.schema is not None:
        reader = reader.schema(source.schema)
    return reader.load(source.path)


def stream_files(spark: SparkSession, source: Source, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(source.data_format).options(**dict(source.options)).schema(source.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(source.path)


def kafka_options(source: Source, topic: str, servers: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": str(source.batch_size),
        **dict(source.options),
    }


def stream_kafka(spark: SparkSession, source: Source, topic: str, servers: str) -> DataFrame:
    """JSON topic as ``(id, payload STRING)``; needs the Kafka connector on the cluster."""
    raw = spark.readStream.format("kafka").options(**kafka_options(source, topic, servers)).load()
    return raw.select(
        F.concat_ws("-", "topic", "partition", "offset").alias("event_id"),
        F.col("value").cast("string").alias("payload"),
        F.col("timestamp").alias("ts"),
    )


def stream_event_hub(spark: SparkSession, source: Source, hub: str, namespace: str, connection: str) -> DataFrame:
    """Event Hubs through its Kafka-compatible endpoint: options only."""
    login = (
        "org.apache.kafka.common.security.plain.PlainLoginModule required "
        f'username="$ConnectionString" password="{connection}";'
    )
    secured = Source(
        source.source_id,
        data_format=source.data_format,
        batch_size=source.batch_size,
        options={
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": "PLAIN",
            "kafka.sasl.jaas.config": login,
            **dict(source.options),
        },
    )
    return stream_kafka(spark, secured, hub, f"{namespace}.servicebus.windows.net:9093")


def read_database(
    spark: SparkSession, url: str, table: str, split_column: str, low: int, high: int, partitions: int, **options: str
) -> DataFrame:
    """Parallel JDBC read: ``partitions`` range queries on ``split_column``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=split_column,
            lowerBound=str(low),
            upperBound=str(high),
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )
