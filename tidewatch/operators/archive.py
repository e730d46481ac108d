"""Moves between stored tiers by retention policy, in two phases that a second run can finish.

The tiers are tables below one folder: ``hot`` as the caller partitioned it, ``warm`` as Parquet in
``source_id=…/move_id=…``, ``cold`` as gzip JSON in ``source_id=…/year=…/month=…/move_id=…``.

*Stage*: the rows to move, and the rows that stay in the hot partitions that lose some, are written aside; last comes the
manifest, with which the move is decided.  *Complete*: warm and cold are written from the staged rows into folders of the
move's own, the hot partitions are replaced by their staged rest, and the manifest goes.  Every step overwrites exactly what
it would have written before, so a run that was broken off anywhere is finished by the next one, and one broken off
before the manifest leaves nothing but a folder that the next one clears.  No row is lost or doubled either way.  As for any
overwrite of plain files, nobody else may write the touched hot partitions while a move runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.common import micros, quoted
from tidewatch.operators.retention import policies_table
from tidewatch.session import cut_lineage
from tidewatch.sources import folders
from tidewatch.sources.storage import read_text_keys

MOVES = "_moves"
WARM_KEYS = ("source_id", "move_id")
COLD_KEYS = ("source_id", "year", "month", "move_id")


def pending(spark: SparkSession, base: str) -> list[str]:
    """Ids of moves that were decided but not completed."""
    return [m for m in folders.children(spark, f"{base}/{MOVES}") if folders.exists(spark, f"{base}/{MOVES}/{m}/manifest/_SUCCESS")]


def stage(
    spark: SparkSession, base: str, policies: Sequence[Mapping], now: Column, keys: Sequence[str], ts: str = "ts", source: str = "source_id"
) -> str | None:
    """Decide a move: rows older than their policy's ``hot_days``.  The move's id, or ``None`` if no row is old enough.

    Rows of sources without a policy, and rows without source or time, stay.
    """
    hot = read_text_keys(spark, f"{base}/hot", keys)
    table = F.broadcast(policies_table(spark, policies).select(F.col("source_id").alias("__src"), "hot_days", "archival_enabled"))
    old = F.coalesce(quoted(ts).cast("timestamp") < now - F.make_dt_interval(days=F.col("hot_days")), F.lit(False))
    flagged = hot.join(table, quoted(source) == F.col("__src"), "left").select(
        *[quoted(c) for c in hot.columns], F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("__folder"),
        old.alias("__moves"), F.coalesce("archival_enabled", F.lit(False)).alias("__cold"),
    )
    move = uuid.uuid4().hex
    at = f"{base}/{MOVES}/{move}"
    flagged.groupBy("__folder").agg(F.count_if("__moves").alias("moved"), F.count_if(~F.col("__moves")).alias("stay")).where("moved > 0").write.parquet(f"{at}/folders")
    hit = spark.read.parquet(f"{at}/folders")
    total = hit.agg(F.sum("moved").alias("n")).head()["n"]
    if not total:
        folders.drop(spark, [at])
        return None
    flagged.join(hit.select("__folder"), "__folder", "left_semi").drop("__folder").write.partitionBy("__moves").parquet(f"{at}/rows")
    spark.range(1).select(F.lit(move).alias("move_id"), F.lit(source).alias("source"), now.alias("archived_at"), F.lit(total).alias("moved")).write.parquet(f"{at}/manifest")
    return move


def _staged(spark: SparkSession, base: str, move: str, moves: bool) -> DataFrame:
    """Staged rows; partition values of the hot table were plain columns there, so their types are kept."""
    rows = spark.read.parquet(f"{base}/{MOVES}/{move}/rows")
    return rows.where(F.col("__moves") == moves).drop("__moves")


def publish(spark: SparkSession, base: str, move: str) -> None:
    """Write the moved rows to warm, and those of policies with archival to cold, into folders of this move."""
    manifest = spark.read.parquet(f"{base}/{MOVES}/{move}/manifest").head()
    rows = _staged(spark, base, move, True)
    body = [c for c in rows.columns if c not in ("__cold", manifest["source"])]
    at = F.lit(manifest["archived_at"])
    out = rows.select(*[quoted(c) for c in body], quoted(manifest["source"]).alias("source_id"), at.alias("archived_at"), F.lit(move).alias("move_id"), "__cold")
    once = {"partitionOverwriteMode": "dynamic"}
    spread = lambda df: df.drop("__cold").hint("rebalance", F.col("source_id"))
    spread(out).write.mode("overwrite").options(**once).partitionBy(*WARM_KEYS).parquet(f"{base}/warm")
    cold = out.where("__cold").withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM")})
    spread(cold).write.mode("overwrite").options(**once, compression="gzip").partitionBy(*COLD_KEYS).json(f"{base}/cold")


def switch(spark: SparkSession, base: str, move: str, keys: Sequence[str]) -> None:
    """Replace the touched hot partitions by what stays of them; a mark keeps a second run from doing it again."""
    at = f"{base}/{MOVES}/{move}"
    if folders.exists(spark, f"{at}/switched"):
        return
    rest = _staged(spark, base, move, False).drop("__cold")
    rest.hint("rebalance", *[quoted(k) for k in keys]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{base}/hot")
    empty = spark.read.parquet(f"{at}/folders").where("stay = 0").select("__folder")
    folders.drop(spark, (r["__folder"] for r in empty.toLocalIterator()), encoded=True)
    folders.touch(spark, f"{at}/switched")


def complete(spark: SparkSession, base: str, move: str, keys: Sequence[str]) -> int:
    """Second phase of a decided move; the number of rows moved."""
    at = f"{base}/{MOVES}/{move}"
    moved = spark.read.parquet(f"{at}/manifest").head()["moved"]
    publish(spark, base, move)
    switch(spark, base, move, keys)
    folders.drop(spark, [f"{at}/manifest", at])
    return moved


def archive(
    spark: SparkSession, base: str, policies: Sequence[Mapping], now: Column, keys: Sequence[str], ts: str = "ts", source: str = "source_id"
) -> int:
    """Finish what was decided before, then move what is old now; the number of rows moved."""
    decided = pending(spark, base)
    moved = sum(complete(spark, base, m, keys) for m in decided)
    folders.drop(spark, [f"{base}/{MOVES}/{m}" for m in folders.children(spark, f"{base}/{MOVES}")])
    move = stage(spark, base, policies, now, keys, ts, source)
    return moved + (complete(spark, base, move, keys) if move else 0)


def read_tier(spark: SparkSession, base: str, tier: str, keys: Sequence[str] = ()) -> DataFrame:
    """A tier as a table.  Cold rows take their types from warm, which has had every row that cold has."""
    if tier == "hot":
        return read_text_keys(spark, f"{base}/hot", keys)
    warm = read_text_keys(spark, f"{base}/warm", WARM_KEYS)
    if tier == "warm":
        return warm
    body = [f for f in warm.schema if f.name not in WARM_KEYS]
    return spark.read.schema(T.StructType([*body, *[T.StructField(k, T.StringType()) for k in COLD_KEYS]])).json(f"{base}/cold")


def purge_by_policy(spark: SparkSession, base: str, tier: str, policies: Sequence[Mapping], now: Column) -> int:
    """Remove what has been in ``warm`` or ``cold`` for longer than its policy allows; the number of rows removed.

    Only policies with cleanup enabled count.  A folder of one source and move was archived at one time, so folders go
    as a whole and no row is rewritten; a run that is broken off leaves folders that the next one takes.
    """
    if not folders.exists(spark, f"{base}/{tier}"):
        return 0
    days = F.col({"warm": "warm_days", "cold": "cold_days"}[tier])
    table = F.broadcast(policies_table(spark, policies).where("cleanup_enabled").select(F.col("source_id").alias("__src"), days.alias("__days")))
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
    held = read_tier(spark, base, tier).select("source_id", "archived_at", folder).groupBy("source_id", "folder").agg(F.max("archived_at").alias("at"), F.count(F.lit(1)).alias("n"))
    old = held.join(table, F.col("source_id") == F.col("__src")).where(micros("at") < micros(now - F.make_dt_interval(days=F.col("__days"))))
    gone = cut_lineage(old.groupBy("folder").agg(F.first("n").alias("n")))
    removed = gone.agg(F.sum("n").alias("n")).head()["n"] or 0
    folders.drop(spark, (r["folder"] for r in gone.select("folder").toLocalIterator()), encoded=True)
    return removed
