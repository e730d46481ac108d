"""Dataset catalogue: registration, versions, search, checksums, lineage edges, export and purge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.common import quoted, union_all
from tidewatch.operators.windows import latest_per_key, newest

EDGE_DAYS = 30


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the row as JSON with its keys in sorted order."""
    names = sorted(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*[quoted(c) for c in names]), {"ignoreNullFields": "false"}), 256)


def checksum(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free checksum of a dataset: ``(row_count, checksum)``.

    Four 60-bit slices of the row hashes are summed as decimals (a sum, unlike
    an exclusive-or, does not cancel duplicate rows) and hashed once more with
    the row count.  One pass, no shuffle beyond the final partial sums.
    """
    h = row_hash(df, columns)
    parts = [
        F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(4)
    ]
    sums = df.select(quoted_all(df)).agg(F.count(F.lit(1)).alias("row_count"), *parts)
    text = F.concat_ws("|", F.col("row_count").cast("string"), *[F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(4)])
    return sums.select("row_count", F.sha2(text, 256).alias("checksum"))


def quoted_all(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def integrity(df: DataFrame, stored: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Compare the stored ``(row_count, checksum)`` row with the data: ``(is_intact, …)``."""
    now = checksum(df, columns)
    both = union_all([
        now.select("row_count", "checksum", F.lit("now").alias("side")),
        stored.select("row_count", "checksum", F.lit("stored").alias("side")),
    ])
    s = both.agg(*[
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}") for side in ("now", "stored") for c in ("row_count", "checksum")
    ])
    return s.select(
        F.coalesce(F.col("now_checksum") == F.col("stored_checksum"), F.lit(False)).alias("is_intact"),
        "now_row_count", "stored_row_count",
    )


def describe(
    df: DataFrame, dataset_id: str, now: Column, name: str | None = None, version: str = "1.0", owner: str | None = None,
    source: str | None = None, tags: Sequence[str] = (), quality: float | None = None, size_bytes: int | None = None,
) -> DataFrame:
    """Catalogue row of a dataset: counts, schema, checksum, tags, times."""
    schema = F.create_map(*[F.lit(x) for n, t in df.dtypes for x in (n, t)])
    return checksum(df).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(name or dataset_id).alias("name"), F.lit(version).alias("version"),
        now.cast("timestamp").alias("created_at"), now.cast("timestamp").alias("updated_at"), schema.alias("schema"),
        F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"), F.lit(owner).cast("string").alias("owner"),
        F.lit(source).cast("string").alias("data_source"), F.lit(quality).cast("double").alias("data_quality_score"),
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(size_bytes).cast("bigint").alias("file_size_bytes"), "checksum",
    )


def version_entry(datasets: DataFrame, changes: Mapping | None = None) -> DataFrame:
    """Version rows of catalogue rows: the first one, or one with the changes as JSON."""
    import json

    note = F.lit(json.dumps(changes, sort_keys=True) if changes else None).cast("string")
    return datasets.select("dataset_id", "version", F.col("updated_at").alias("ts"), note.alias("changes"))


def update(datasets: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply changed fields and return (rows to append to the catalogue, version entries).

    ``changes``: ``dataset_id`` and any catalogue columns; a NULL leaves the
    current value.  Unknown dataset ids are left out.
    """
    current = latest_per_key(datasets, ["dataset_id"], "updated_at", ["version"])
    fields = [c for c in changes.columns if c != "dataset_id"]
    renamed = changes.select("dataset_id", *[quoted(c).alias(f"__new_{c}") for c in fields])
    joined = current.join(renamed, "dataset_id")
    rows = joined.select(*[
        now.cast("timestamp").alias(c) if c == "updated_at"
        else F.coalesce(F.col(f"__new_{c}"), quoted(c)).alias(c) if c in fields else quoted(c)
        for c in current.columns
    ])
    changed = F.to_json(F.struct(*[F.col(f"__new_{c}").alias(c) for c in sorted(fields)]))
    entries = joined.select(
        "dataset_id", F.coalesce(F.col("__new_version"), F.col("version")).alias("version") if "version" in fields else F.col("version"),
        now.cast("timestamp").alias("ts"), changed.alias("changes"),
    )
    return rows, entries


def search(datasets: DataFrame, query: Mapping) -> DataFrame:
    """Datasets that meet all conditions: tags, owner, source, quality, rows, creation time."""
    tests = {
        "tags": lambda v: F.size(F.array_except(F.array(*[F.lit(x) for x in v]).cast("array<string>"), "tags")) == 0,
        "owner": lambda v: F.col("owner") == v,
        "data_source": lambda v: F.col("data_source") == v,
        "min_quality_score": lambda v: F.col("data_quality_score") >= v,
        "max_quality_score": lambda v: F.col("data_quality_score") <= v,
        "min_row_count": lambda v: F.col("row_count") >= v,
        "max_row_count": lambda v: F.col("row_count") <= v,
        "created_after": lambda v: F.col("created_at") >= v,
        "created_before": lambda v: F.col("created_at") <= v,
    }
    conds = [tests[k](v) for k, v in query.items() if k in tests]
    return datasets.filter(reduce(lambda a, b: a & b, conds)) if conds else datasets


def version_history(versions: DataFrame, dataset_id: str, limit: int = 10) -> DataFrame:
    return newest(versions.filter(F.col("dataset_id") == dataset_id), "ts", limit, tiebreak=["version"])


def live_edges(edges: DataFrame, now: Column, days: int = EDGE_DAYS) -> DataFrame:
    """Lineage edges not older than ``days``, the newest per (source, target)."""
    recent = edges.filter(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))
    return latest_per_key(recent, ["source_id", "target_id"], "ts")


def direct_lineage(edges: DataFrame, dataset_id: str, direction: str, now: Column, days: int = EDGE_DAYS) -> DataFrame:
    """Direct edges of a dataset: ``upstream``, ``downstream`` or ``both``."""
    up, down = F.col("target_id") == dataset_id, F.col("source_id") == dataset_id
    cond = {"upstream": up, "downstream": down}.get(direction, up | down)
    return live_edges(edges.filter(cond), now, days)


def statistics(datasets: DataFrame, edges: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Catalogue rows with edge counts, version count and latest version."""
    alive = live_edges(edges, now)
    ends = F.array(
        F.struct(F.col("target_id").alias("dataset_id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("source_id").alias("dataset_id"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )
    e = alive.select(F.inline(ends)).groupBy("dataset_id").agg(
        F.sum("up").alias("upstream_datasets"), F.sum("down").alias("downstream_datasets")
    )
    v = versions.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_versions"), F.max_by("version", F.struct("ts", "version")).alias("latest_version"),
        F.max("ts").alias("last_updated"),
    )
    zero = ("upstream_datasets", "downstream_datasets", "total_versions")
    out = datasets.join(e, "dataset_id", "left").join(v, "dataset_id", "left")
    return out.withColumns({c: F.coalesce(quoted(c), F.lit(0).cast("bigint")) for c in zero})


def export_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write catalogue tables as JSON folders (partition counts are left to Spark)."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_tables(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def purge(datasets: DataFrame, versions: DataFrame, edges: DataFrame, now: Column, days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the datasets that were not updated for ``days``, their versions and edges."""
    last = datasets.groupBy("dataset_id").agg(F.max("updated_at").alias("__last"))
    gone = last.filter(F.col("__last") < now - F.make_dt_interval(days=F.lit(days))).select("dataset_id")
    kept_edges = edges.join(gone.withColumnRenamed("dataset_id", "source_id"), "source_id", "left_anti").join(
        gone.withColumnRenamed("dataset_id", "target_id"), "target_id", "left_anti"
    )
    return (
        datasets.join(gone, "dataset_id", "left_anti"),
        versions.join(gone, "dataset_id", "left_anti"),
        kept_edges.select(*[quoted(c) for c in edges.columns]),
    )
