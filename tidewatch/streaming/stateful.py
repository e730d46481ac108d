"""Streaming state of its own kind: the newest values of every key, and a log of what each micro-batch did.

The rings need the RocksDB state store, which ``use_rocksdb`` switches on for streams that start later.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from tidewatch.functions.common import micros, number, quoted, truth
from tidewatch.functions.ordered import newest_rows
from tidewatch.operators import drift
from tidewatch.streaming.streams import BatchFunction, write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Ring(StatefulProcessor):
    """The newest ``size`` values of every key of a bucket, by time and id, across micro-batches.

    Each micro-batch of a key gives one row with the whole ring once it holds ``gate`` values; before that its new rows
    pass through.  Frames are cut to the rings' size one by one, so a key with very many new rows takes no more memory.
    """

    def __init__(self, size: int, gate: int, id_type: str):
        if gate > size:
            raise ValueError(f"a ring of {size} never holds {gate} values")
        self.size, self.gate, self.id_type = size, gate, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", f"k string, t bigint, id {self.id_type}, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = ["k", "t", "id", "value"]
        codes: dict = {}
        held = pd.DataFrame([tuple(r) for r in self.ring.get()], columns=own)
        held["g"] = [codes.setdefault(k, len(codes)) for k in held["k"]]
        known, touched, fresh = np.bincount(held["g"].astype("int64"), minlength=len(codes)), np.zeros(len(codes), dtype=bool), None
        for frame in rows:
            new = frame[own].copy()
            new["g"] = [codes.setdefault(k, len(codes)) for k in new["k"]]
            more = np.bincount(new["g"].astype("int64"), minlength=len(codes))
            known, touched = (np.pad(x, (0, len(codes) - len(x))) for x in (known, touched))
            known, touched = known + more, touched | (more > 0)
            fresh = new if fresh is None else pd.concat([fresh, new])
            fresh = fresh[known[fresh["g"]] < self.gate]  # few enough to pass, unless the gate is reached
            held = (pd.concat([held, new]) if len(held) else new).sort_values(["g", "t", "id"]).groupby("g", sort=False).tail(self.size)
        self.ring.put(list(held[own].astype(object).itertuples(index=False, name=None)))
        full = held[(touched & (known >= self.gate))[held["g"]]]
        if len(full):
            last = full.groupby("g", sort=False).tail(1)
            values = full.assign(value=full["value"].astype(float)).groupby("g", sort=False)["value"].agg(list)
            yield pd.DataFrame({"k": last["k"].to_numpy(), "t": last["t"].to_numpy(), "id": last["id"].to_numpy(), "value": None, "ring": values.reindex(last["g"]).to_numpy()})
        if fresh is not None and len(fresh):
            yield pd.DataFrame({"k": fresh["k"], "t": fresh["t"], "id": fresh["id"], "value": fresh["value"].astype(float), "ring": None})

    def close(self) -> None:
        pass


def last_values(
    df: DataFrame, key: str, ts: str, value: str, size: int, gate: int | None = None, id_column: str = "event_id", missing: float | None = None, buckets: int = 1024
) -> DataFrame:
    """Per micro-batch and key: ``(key, ts, id, values)`` with the newest ``size`` values, or the new rows ``(key, ts, id, value)``.

    ``values`` is null in rows that pass because the key has had fewer than ``gate`` (by default ``size``) values so far.
    Values that are no numbers become ``missing``; if that is null they take no part.  Keys share state by their hash, so that
    Python is called once per bucket and not once per key; a checkpoint keeps its number of ``buckets``.
    """
    v = F.coalesce(number(quoted(value)), F.lit(missing)) if missing is not None else number(quoted(value))
    id_type = df.schema[id_column].dataType.simpleString()
    source = df.select(quoted(key).cast("string").alias("k"), micros(quoted(ts)).alias("t"), quoted(id_column).alias("id"), v.alias("value")).where("value is not null")
    out = source.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(int(buckets)))).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Ring(size, size if gate is None else gate, id_type),
        outputStructType=f"k string, t bigint, id {id_type}, value double, ring array<double>", outputMode="append", timeMode="None",
    )
    return out.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), F.col("id").alias(id_column), F.col("value").alias(value), F.col("ring").alias("values"))


#: Aggregates of a window of values, by name; an unknown name gives 0.
OVER_VALUES: dict[str, Callable[[Column], Column]] = {
    "count": lambda a: F.size(a).cast("double"),
    "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x),
    "average": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a),
    "min": F.array_min,
    "max": F.array_max,
}


def last_values_aggregate(df: DataFrame, key: str, ts: str, value: str, size: int, kind: str, id_column: str = "event_id") -> DataFrame:
    """Count-based aggregate over the last ``size`` values of a key: one row per micro-batch, or the rows as they come while there are fewer.

    ``is_aggregate`` tells them apart; the aggregate is in the column ``{value}_{kind}``.  A missing value counts as 0.
    """
    rows = last_values(df, key, ts, value, size, id_column=id_column, missing=0.0)
    made = OVER_VALUES.get(kind, lambda a: F.lit(0.0))(F.col("values"))
    return rows.withColumns({f"{value}_{kind}": F.when(F.col("values").isNotNull(), made), "is_aggregate": F.col("values").isNotNull()}).drop("values")


def _moments(a: Column, side: str) -> dict[str, Column]:
    """Count, mean, standard deviation, skewness and kurtosis of an array of values."""
    n = F.size(a).cast("double")
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    central = lambda p: F.aggregate(F.transform(a, lambda x: F.pow(x - mean, F.lit(float(p)))), F.lit(0.0), lambda s, x: s + x)
    m2 = F.nullif(central(2), F.lit(0.0))
    return {
        f"{side}_n": F.size(a).cast("bigint"), f"{side}_mean": mean, f"{side}_std": F.sqrt(central(2) / n),
        f"{side}_skew": F.sqrt(n) * central(3) / F.pow(m2, F.lit(1.5)), f"{side}_kurtosis": n * central(4) / (m2 * m2) - 3.0,
    }


def window_drift(df: DataFrame, baseline: DataFrame, ts: str, window_size: int = 1000, threshold: float = 0.05, min_samples: int = 100, id_column: str = "event_id") -> DataFrame:
    """Drift of the last ``window_size`` values of every feature, over micro-batches of any size.

    ``df`` is a stream ``(feature, ts, id, value)``, ``baseline`` a table ``(feature, value)``.  A row comes with every
    micro-batch that has values of a feature, once ``min_samples`` were seen; features without a baseline give none.
    """
    rows = last_values(df, "feature", ts, "value", window_size, min_samples, id_column).where("values is not null")
    base = drift.side_moments(baseline, drift.BASELINE, ("feature",))
    return drift.score_moments(rows.withColumns(_moments(F.col("values"), drift.CURRENT)).join(base, "feature"), threshold, min_samples, ("feature", ts))


def last_rows_state(path: str, state_path: str, keys: Sequence[str], ts: str, size: int, then: Callable[[DataFrame], DataFrame], tiebreak: Sequence[str] = ()) -> BatchFunction:
    """The newest ``size`` rows per key as a small table instead of keyed state, and ``then`` of it for every micro-batch.

    One key may hold most of the rows: the newest rows are chosen in parallel.  A retried micro-batch starts from the same
    state and overwrites its own output.  Older states can be removed once their stream has gone on.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = batch if batch_id == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{state_path}/batch_id={batch_id - 1}"))
        write_batch(newest_rows(known, keys, ts, size, tiebreak), state_path, batch_id)
        write_batch(then(spark.read.schema(batch.schema).parquet(f"{state_path}/batch_id={batch_id}")), path, batch_id)

    return run


def observed(df: DataFrame, name: str, ts: str, is_bad: Column | None = None) -> DataFrame:
    """The stream with counts on the side: events, bad events, newest event time; ``MetricsLog`` collects them."""
    bad = truth(is_bad) if is_bad is not None else F.lit(False)
    return df.observe(name, F.count(F.lit(1)).alias("total_events"), F.count_if(bad).alias("error_count"), F.max(micros(quoted(ts))).alias("newest"))


class MetricsLog(StreamingQueryListener):
    """Writes one row of metrics per micro-batch of every observed stream to a table.

    ``(stream_id, batch_id, run_id, total_events, error_count, newest_event, events_per_second, latency_ms, late_rows,
    written_at)``: ``latency_ms`` is the time the micro-batch took, ``late_rows`` those that the watermark dropped.
    Micro-batches without input leave no row.  A batch that is run again after a failure has one row per run.
    """

    SCHEMA = (
        "stream_id string, batch_id bigint, run_id string, total_events bigint, error_count bigint, newest_event timestamp, "
        "events_per_second double, latency_ms bigint, late_rows bigint, written_at timestamp"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = next(iter(p.observedMetrics.values()), None)
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if seen is None or not (seen["total_events"] or late):
            return
        newest = pd.Timestamp(seen["newest"], unit="us").to_pydatetime() if seen["newest"] is not None else None
        row = (
            p.name, p.batchId, str(p.runId), seen["total_events"], seen["error_count"], newest, float(p.processedRowsPerSecond),
            int(p.durationMs.get("triggerExecution", 0)), int(late), pd.Timestamp(p.timestamp).tz_localize(None).to_pydatetime(),
        )
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def __enter__(self) -> MetricsLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *args) -> None:
        """Progress comes in order and before the end, so after the end the table is whole."""
        self.ended.wait(60)
        self.spark.streams.removeListener(self)


def stream_metrics(log: DataFrame) -> DataFrame:
    """Per stream: micro-batches, events, errors and their share, late rows, mean and longest time of a micro-batch."""
    return log.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("total_events").alias("total_events"), F.sum("error_count").alias("error_count"),
        F.try_divide(F.sum("error_count"), F.sum("total_events")).alias("error_rate"), F.sum("late_rows").alias("late_rows"),
        F.avg("latency_ms").alias("processing_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.max("newest_event").alias("newest_event"),
    )
