"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions.common import micros, quoted
from tidewatch.operators import aggregates, alerting, drift, quality
from tidewatch.operators.predicates import apply_processing


@dataclass(frozen=True)
class StreamConfig:
    """What a stream does with its events and where it keeps its progress."""

    stream_id: str
    checkpoint: str
    processing: Mapping = field(default_factory=dict)
    trigger: Mapping = field(default_factory=lambda: {"availableNow": True})
    output_mode: str = "append"


def writer(df: DataFrame, config: StreamConfig) -> DataStreamWriter:
    """Processed stream as a configured writer; the caller adds the sink and starts it."""
    processed = apply_processing(df, config.processing)
    return (
        processed.writeStream.queryName(config.stream_id).outputMode(config.output_mode)
        .option("checkpointLocation", config.checkpoint).trigger(**config.trigger)
    )


def parse_json(raw: DataFrame, schema: T.StructType | str, payload: str = "payload") -> DataFrame:
    """Payload text to ``data`` with ``is_bad`` for text that is not JSON."""
    ok = F.try_parse_json(quoted(payload)).isNotNull()
    return raw.withColumn("data", F.from_json(quoted(payload), schema)).withColumn("is_bad", ~ok)


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter("NOT is_bad").drop("is_bad")


def bad_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter("is_bad").drop("data", "is_bad")


def window_aggregate(
    df: DataFrame, ts: str, window: str, keys: Sequence[str], aggs: Sequence[Column], watermark: str | None = None, slide: str | None = None
) -> DataFrame:
    """Event-time window aggregate; late rows beyond the watermark are dropped and counted by Spark."""
    rows = df.withWatermark(ts, watermark) if watermark else df
    grouped = rows.groupBy(F.window(quoted(ts), window, slide).alias("w"), *[quoted(k) for k in keys]).agg(*aggs)
    return grouped.withColumn("window_start", F.col("w.start")).drop("w")


def stream_rates(df: DataFrame, ts: str, stream: str, duration_seconds: int, watermark: str | None = None) -> DataFrame:
    """Events and events per second per stream and window."""
    n = F.count(F.lit(1))
    out = window_aggregate(df, ts, f"{duration_seconds} seconds", [stream], [
        n.alias("total_events"), (n / F.lit(float(duration_seconds))).alias("events_per_second")], watermark)
    return out.select("window_start", quoted(stream), "total_events", "events_per_second")


def newest_windows(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last state of every window from what an update-mode stream wrote per micro-batch."""
    own = ["window_start", *keys]
    rest = [c for c in results.columns if c not in (*own, "batch_id")]
    last = results.groupBy(*own).agg(F.max_by(F.struct(*[quoted(c) for c in rest]), "batch_id").alias("__last"))
    return last.select(*own, *[F.col(f"__last.`{c}`").alias(c) for c in rest])


def deduplicate(df: DataFrame, ts: str, event_id: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """First event of each id within the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([event_id])


def cooldown(
    hits: DataFrame, key: str, ts: str, cooldown_seconds: int, id_column: str = "event_id", watermark: str = "10 minutes"
) -> DataFrame:
    """Alerts that fire, with the last firing time of each key as state.

    State is one number per key and is dropped once the watermark has passed
    the end of the silence.  A micro-batch is ordered by event time; its size
    per key is bounded by the trigger limits of the source.
    """
    id_type = hits.schema[id_column].dataType.simpleString()
    silence = int(cooldown_seconds) * 1_000_000

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        out = []
        for t, ident in zip(rows["t"], rows["id"]):
            if last is None or t >= last + silence:
                out.append((group[0], int(t), ident))
                last = int(t)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + silence) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["k", "t", "id"])

    source = hits.select(
        quoted(key).cast("string").alias("k"), quoted(ts).cast("timestamp").alias("at"), micros(quoted(ts)).alias("t"), quoted(id_column).alias("id")
    ).withWatermark("at", watermark)
    fired = source.groupBy("k").applyInPandasWithState(
        step, f"k string, t bigint, id {id_type}", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return fired.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), F.col("id").alias(id_column))


def escalations(
    events: DataFrame, alert_id: str, ts: str, kind: str, delay_seconds: int, watermark: str = "1 minute", buckets: int = 1024
) -> DataFrame:
    """Alerts nobody acted on in time: ``(alert_id, escalated_at)``.

    ``kind`` is ``raised``, ``acknowledge`` or ``resolve``.  An alert is held
    as state until an action comes or event time passes its deadline.  Alerts
    share state by the hash of their id, so that Python is called once per
    bucket and not once per alert; a checkpoint keeps its number of ``buckets``.
    Rows without a time take no part.
    """
    delay = int(delay_seconds) * 1_000_000
    own = ["held", "raised", "acted"]

    def earliest(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("a", dropna=False, sort=False, as_index=False).agg({**dict.fromkeys(own, "min"), "new": "max"})

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        none = pd.Series(pd.NA, index=range(len(held[0])), dtype="Int64")
        alerts = pd.DataFrame({"a": pd.Series(held[0], dtype=object), "held": pd.Series(held[1], dtype="Int64"), "raised": none, "acted": none, "new": False})
        for frame in () if state.hasTimedOut else frames:
            first, t = frame["kind"] == "raised", frame["t"].astype("Int64")
            rows = pd.DataFrame({"a": frame["a"], "held": pd.Series(pd.NA, index=frame.index, dtype="Int64"), "raised": t.where(first), "acted": t.where(~first), "new": True})
            alerts = earliest(pd.concat([alerts, earliest(rows)]))
        alerts["since"] = alerts[["held", "raised"]].min(axis=1).astype("Int64")
        alerts = alerts[alerts["since"].notna()]
        deadline, acted, new = alerts["since"].astype("int64") + delay, alerts["acted"], alerts["new"].astype(bool)
        closed = state.getCurrentWatermarkMs()
        answered = (acted <= deadline).fillna(False).astype(bool)
        due = ~answered & ((new & (acted.notna() | (deadline // 1000 <= closed))) | (~new & (deadline // 1000 + 1 < closed)))
        names = alerts["a"].where(alerts["a"].notna(), None)
        open_ = ~answered & ~due
        if open_.any():
            state.update((names[open_].tolist(), alerts["since"][open_].astype("int64").tolist()))
            state.setTimeoutTimestamp(int(deadline[open_].min()) // 1000 + 1)
        elif state.exists:
            state.remove()
        if due.any():
            yield pd.DataFrame({"a": names[due], "t": deadline[due]})

    source = events.select(
        quoted(alert_id).cast("string").alias("a"), quoted(ts).cast("timestamp").alias("at"), micros(quoted(ts)).alias("t"), quoted(kind).alias("kind")
    ).withWatermark("at", watermark)
    late = source.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(int(buckets)))).groupBy("bucket").applyInPandasWithState(
        step, "a string, t bigint", "a array<string>, raised array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return late.select(F.col("a").alias(alert_id), F.timestamp_micros("t").alias("escalated_at"))


BatchFunction = Callable[[DataFrame, int], None]


def last_rows_per_batch(path: str, ts: str, size: int, wanted: Mapping[str, tuple[str, str]], keys: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> BatchFunction:
    """Count-based aggregate of the last ``size`` rows of every micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        out = aggregates.last_rows_aggregate(batch, ts, size, wanted, keys, tiebreak)
        write_batch(out, path, batch_id)

    return run


def drift_per_batch(path: str, baseline: DataFrame, threshold: float = 0.05, min_samples: int = 100) -> BatchFunction:
    """Drift of every micro-batch ``(feature, value)`` against a baseline table of the same shape."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sides = baseline.select("feature", F.lit("baseline").alias("side"), "value").unionByName(
            batch.select("feature", F.lit("current").alias("side"), "value")
        )
        write_batch(drift.distribution(sides, threshold, min_samples), path, batch_id)

    return run


def quality_per_batch(path: str, rules: Sequence[Mapping]) -> BatchFunction:
    """Quality rules over every micro-batch, all rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(quality.check(batch, rules), path, batch_id)

    return run


def cooldown_per_batch(
    path: str, state_path: str, keys: Sequence[str], ts: str, cooldown_seconds: int, id_column: str = "event_id"
) -> BatchFunction:
    """Cooldown with its state in a small table instead of the state store.

    One key may hold most of the hits: each micro-batch runs the parallel batch
    form and writes the last firing time per key for the next one.  A retried
    batch starts from the same state and overwrites its own output.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{state_path}/batch_id={batch_id - 1}") if batch_id > 0 else None
        hits = batch.withColumn("__cool", F.lit(int(cooldown_seconds)))
        write_batch(alerting.cooldown(hits, keys, ts, id_column, "__cool", last_fired=before).drop("__cool"), path, batch_id)
        fired = spark.read.parquet(f"{path}/batch_id={batch_id}").select(*keys, ts)
        known = fired if before is None else fired.unionByName(before)
        write_batch(known.groupBy(*keys).agg(F.max(quoted(ts)).alias(ts)), state_path, batch_id)

    return run


def features_per_batch(path: str, build: Callable[[DataFrame], DataFrame]) -> BatchFunction:
    """A feature function over every micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(build(batch), path, batch_id)

    return run


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, overwritten on a retry: each batch is there exactly once."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def each_batch(df: DataFrame, config: StreamConfig, fn: BatchFunction) -> DataStreamWriter:
    return writer(df, config).foreachBatch(fn)


def store_events(df: DataFrame, config: StreamConfig, path: str, partition_by: Sequence[str] = ()) -> DataStreamWriter:
    """Processed events to Parquet, exactly once through the sink's own log."""
    return writer(df, config).format("parquet").option("path", path).partitionBy(*partition_by)
