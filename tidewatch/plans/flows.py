"""Queries that run as streams over the event file and read back what the sink holds."""

from pyspark.sql import functions as F

from tidewatch.operators import drift, features
from tidewatch.plans.registry import ORACLES, query, stamp, tidy
from tidewatch.plans.tables import scratch
from tidewatch.sources.readers import Source, stream_files
from tidewatch.streaming import stateful as Z
from tidewatch.streaming import streams as X


def event_stream(t):
    """File stream over the events of the data folder."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.path)


WEEK = "least(day(ts) {div} 8, 3)"  # the events lie in one month


FILE_ROWS = 250_000


def batch_stream(t, rows, batch, n):
    """``rows`` as a stream of ``n`` micro-batches, by the number in the column expression ``batch``."""
    path = scratch(t.spark)
    numbered = rows.withColumn("__batch", F.expr(batch))
    sizes = {r["__batch"]: r["count"] for r in numbered.where(F.col("__batch").between(0, n - 1)).groupBy("__batch").count().collect()}
    files = max(1, min(sizes.get(i, 0) for i in range(n)) // FILE_ROWS)  # as many rows per file leave none of them out
    for i in range(n):  # the stream takes files in the order they were written
        numbered.where(F.col("__batch") == i).drop("__batch").repartition(files).write.mode("append").parquet(f"{path}/{i}")
    return stream_files(t.spark, Source("events", f"{path}/*", "parquet", rows.schema), files_per_trigger=files)


def finish(writer) -> None:
    run = writer.start()
    run.awaitTermination()


def timed_stream(t):
    """The events with a time that can carry a watermark."""
    return event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))


def config(t, name, **options):
    base = scratch(t.spark)
    return X.StreamConfig(f"{name}_{base[-8:]}", f"{base}/progress", **options), f"{base}/out"


@query(
    "stream_filter_and_store",
    "SELECT event_id AS id, value AS amount FROM events WHERE event_type = 'purchase' AND value > 20",
)
def stream_filter_and_store(t):
    processing = {
        "filters": [
            {"field": "event_type", "operator": "equals", "value": "purchase"},
            {"field": "value", "operator": "greater_than", "value": 20.0},
        ],
        "transformations": [{"type": "field_mapping", "mapping": {"event_id": "id", "value": "amount"}}],
    }
    cfg, path = config(t, "store", processing=processing)
    finish(X.store_events(event_stream(t), cfg, path))
    return t.spark.read.parquet(path)


BAD = "CASE WHEN event_id % 17 = 0 THEN '{broken' ELSE props END"


@query(
    "stream_parse_json",
    f"WITH p AS (SELECT event_id, {BAD} AS p FROM events) SELECT event_id, (p->>'$.k')::BIGINT AS k FROM p WHERE json_valid(p)",
)
def stream_parse_json(t):
    cfg, path = config(t, "parse")
    raw = event_stream(t).select("event_id", F.expr(BAD).alias("payload"))
    good = X.good_events(X.parse_json(raw, "k bigint")).select("event_id", "data.k")
    finish(X.store_events(good, cfg, path))
    return t.spark.read.parquet(path)


@query("stream_bad_json", "SELECT event_id, '{broken' AS payload FROM events WHERE event_id % 17 = 0")
def stream_bad_json(t):
    cfg, path = config(t, "bad")
    raw = event_stream(t).select("event_id", F.expr(BAD).alias("payload"))
    finish(X.store_events(X.bad_events(X.parse_json(raw, "k bigint")), cfg, path))
    return t.spark.read.parquet(path)


@query(
    "stream_window_aggregate",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY 1, 2""",
)
def stream_window_aggregate(t):
    cfg, path = config(t, "window", output_mode="update")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    out = X.window_aggregate(timed_stream(t), "ts", "1 hour", ["event_type"], aggs, watermark="1 day")
    finish(X.each_batch(out, cfg, lambda df, batch: X.write_batch(df, path, batch)))
    back = X.newest_windows(t.spark.read.parquet(path), ["event_type"])
    return back.select(stamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_rates",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS total_events, round(count(*) / 86400.0, 9) AS events_per_second
    FROM events GROUP BY 1, 2""",
)
def stream_rates(t):
    cfg, path = config(t, "rates", output_mode="update")
    out = X.stream_rates(timed_stream(t), "ts", "event_type", 86400, "1 day")
    finish(X.each_batch(out, cfg, lambda df, batch: X.write_batch(df, path, batch)))
    return tidy(X.newest_windows(t.spark.read.parquet(path), ["event_type"]), 9)


@query("stream_deduplicate", "SELECT DISTINCT user_id FROM events")
def stream_deduplicate(t):
    cfg, path = config(t, "dedup")
    rows = event_stream(t).select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    finish(X.store_events(X.deduplicate(rows, "ts", "user_id", "400 days").select("user_id"), cfg, path))
    return t.spark.read.parquet(path)


@query(
    "stream_cooldown",
    """WITH RECURSIVE h AS (SELECT event_type, ts, event_id FROM events WHERE value > 60), walk AS (SELECT event_type, min(ts) AS ts FROM h GROUP BY 1
      UNION ALL SELECT * FROM (SELECT w.event_type, (SELECT min(h.ts) FROM h WHERE h.event_type = w.event_type AND h.ts >= w.ts + INTERVAL 6 HOUR) AS ts FROM walk w) WHERE ts IS NOT NULL)
    SELECT event_type, min(event_id) AS event_id FROM h JOIN walk USING (event_type, ts) GROUP BY event_type, ts""",
)
def stream_cooldown(t):
    cfg, path = config(t, "cooldown")
    fired = X.cooldown(event_stream(t).filter("value > 60"), "event_type", "ts", 6 * 3600)
    finish(X.store_events(fired, cfg, path))
    return t.spark.read.parquet(path).select("event_type", "event_id")


@query("stream_cooldown_hot_keys", ORACLES["stream_cooldown"])
def stream_cooldown_hot_keys(t):
    cfg, path = config(t, "hotkeys")
    hits = event_stream(t).filter("value > 60").select("event_type", "ts", "event_id")
    fn = X.cooldown_per_batch(path, f"{path}_state", ["event_type"], "ts", 6 * 3600)
    finish(X.each_batch(hits, cfg, fn))
    return t.spark.read.parquet(path).select("event_type", "event_id")


@query(
    "stream_last_rows",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, round(avg(value), 6) AS mean_value, count(*) AS n FROM r WHERE rn <= 20 GROUP BY 1 HAVING count(*) >= 20""",
)
def stream_last_rows(t):
    cfg, path = config(t, "last")
    wanted = {"mean_value": ("average", "value"), "n": ("count", "value")}
    finish(X.each_batch(event_stream(t), cfg, X.last_rows_per_batch(path, "ts", 20, wanted, ["user_id"], ["event_id"])))
    return tidy(t.spark.read.parquet(path).drop("batch_id"))


@query(
    "stream_quality",
    """SELECT 'range' AS rule_id, count(*) FILTER (value > 150) AS issue_count, round(count(*) FILTER (value > 150) * 1.0 / count(*), 6) AS issue_pct FROM events
    UNION ALL SELECT 'missing', count(*) - count(props), round((count(*) - count(props)) * 1.0 / count(*), 6) FROM events""",
)
def stream_quality(t):
    rules = [
        {"rule_id": "range", "rule_type": "range", "field_name": "value", "parameters": {"max_value": 150}},
        {"rule_id": "missing", "rule_type": "missing", "field_name": "props"},
    ]
    cfg, path = config(t, "quality")
    finish(X.each_batch(event_stream(t), cfg, X.quality_per_batch(path, rules)))
    return tidy(t.spark.read.parquet(path).select("rule_id", "issue_count", "issue_pct"))


@query(
    "stream_drift",
    """WITH b AS (SELECT event_type AS f, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1),
    c AS (SELECT event_type AS f, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
    SELECT f AS feature, b.n AS n_baseline, c.n AS n_current, round(abs(c.m - b.m) / (b.s + 1e-8), 6) AS mean_diff, round(abs(c.s - b.s) / (b.s + 1e-8), 6) AS std_diff FROM b JOIN c USING (f)""",
)
def stream_drift(t):
    baseline = t.events.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).select(F.col("event_type").alias("feature"), "value")
    cfg, path = config(t, "drift")
    current = event_stream(t).select(F.col("event_type").alias("feature"), "value")
    finish(X.each_batch(current, cfg, X.drift_per_batch(path, baseline)))
    return tidy(t.spark.read.parquet(path).select("feature", "n_baseline", "n_current", "mean_diff", "std_diff"))


@query(
    "stream_features",
    "SELECT event_id, hour(ts) AS ts_hour, round(value * user_id, 4) + 0.0 AS value_user_id_interaction FROM events",
)
def stream_features(t):
    steps = [{"type": "extract_datetime", "column": "ts"}, {"type": "create_interaction", "columns": ["value", "user_id"]}]
    cfg, path = config(t, "features")
    finish(X.each_batch(event_stream(t), cfg, X.features_per_batch(path, lambda df: features.apply_steps(df, steps))))
    return tidy(t.spark.read.parquet(path).select("event_id", "ts_hour", "value_user_id_interaction"), 4)


LATE_SQL = """WITH b AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 3 WHEN ts < TIMESTAMP '2024-01-20' THEN 0 WHEN event_id % 50 = 1 THEN 2 ELSE 1 END AS batch FROM events),
  w AS (SELECT batch, date_trunc('hour', ts) AS w, event_type FROM b), m AS (SELECT max(ts) - INTERVAL 2 DAY AS closed FROM b WHERE batch < 2)"""


@query(
    "stream_late_rows",
    f"""{LATE_SQL}, kept AS (SELECT w, event_type FROM w, m WHERE batch < 3 OR w + INTERVAL 1 HOUR > closed)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM kept
    WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2""",
)
def stream_late_rows(t):
    """Windows that the watermark has closed; rows that come two days late are dropped, those inside the two days count.

    A row in fifty comes last.  Lateness is judged by the watermark of the micro-batch before, hence the third one.
    """
    cfg, path = config(t, "late")
    batch = "CASE WHEN event_id % 50 = 0 THEN 3 WHEN ts < TIMESTAMP_NTZ '2024-01-20' THEN 0 WHEN event_id % 50 = 1 THEN 2 ELSE 1 END"
    rows = batch_stream(t, t.events, batch, 4).withColumn("ts", F.col("ts").cast("timestamp"))
    out = X.window_aggregate(rows, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")], watermark="2 days")
    finish(X.store_events(out, cfg, path))
    return tidy(t.spark.read.parquet(path).select("window_start", "event_type", "n"))


@query(
    "stream_late_count",
    f"""{LATE_SQL} SELECT batch::BIGINT AS batch_id, count(*) AS total_events, 0::BIGINT AS error_count FROM b GROUP BY 1""",
)
def stream_late_count(t):
    """What each micro-batch of the stream with late rows read, from the log of its listener."""
    cfg, path = config(t, "latecount")
    batch = "CASE WHEN event_id % 50 = 0 THEN 3 WHEN ts < TIMESTAMP_NTZ '2024-01-20' THEN 0 WHEN event_id % 50 = 1 THEN 2 ELSE 1 END"
    rows = batch_stream(t, t.events, batch, 4).withColumn("ts", F.col("ts").cast("timestamp"))
    seen = Z.observed(rows, "events", "ts")
    out = X.window_aggregate(seen, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")], watermark="2 days")
    with Z.MetricsLog(t.spark, f"{path}_log"):
        finish(X.store_events(out, cfg, path))
    return t.spark.read.parquet(f"{path}_log").select("batch_id", "total_events", "error_count")


@query(
    "stream_metrics",
    f"""WITH p AS (SELECT (event_id % 4)::BIGINT AS batch_id, ts, {BAD} AS p FROM events),
    b AS (SELECT batch_id, count(*) AS total_events, count(*) FILTER (NOT json_valid(p)) AS error_count, max(ts) AS newest FROM p WHERE p IS NOT NULL GROUP BY 1)
    SELECT batch_id, total_events, error_count, strftime(newest, '%Y-%m-%d %H:%M:%S') AS newest_event, true AS timed FROM b""",
)
def stream_metrics(t):
    """Events, bad events and newest time of every micro-batch, written by the listener."""
    cfg, path = config(t, "metrics")
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(BAD).alias("payload")).where("payload is not null")
    parsed = X.parse_json(batch_stream(t, rows, "event_id % 4", 4), "k bigint")
    seen = Z.observed(parsed, "metrics", "ts", F.col("is_bad"))
    with Z.MetricsLog(t.spark, f"{path}_log"):
        finish(X.store_events(X.good_events(seen).select("event_id", "data.k"), cfg, path))
    log = t.spark.read.parquet(f"{path}_log")
    return tidy(log.select("batch_id", "total_events", "error_count", "newest_event", (F.col("latency_ms") > 0).alias("timed")))


@query(
    "stream_last_values",
    """WITH r AS (SELECT user_id, event_id, value, ts, least(day(ts) // 8, 3) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error'),
    e AS (SELECT user_id, b, max(rn) AS upto FROM r GROUP BY 1, 2)
    SELECT user_id::VARCHAR AS user_id, true AS is_aggregate, NULL::BIGINT AS event_id, NULL::DOUBLE AS value,
           round((SELECT avg(value) FROM r WHERE r.user_id = e.user_id AND r.rn > e.upto - 8 AND r.rn <= e.upto), 6) AS value_average FROM e WHERE upto >= 8
    UNION ALL SELECT user_id::VARCHAR, false, event_id, round(value, 6), NULL FROM r JOIN e USING (user_id, b) WHERE upto < 8""",
)
def stream_last_values(t):
    """Mean of each user's last eight errors after every week; until there are eight the rows pass."""
    Z.use_rocksdb(t.spark)
    cfg, path = config(t, "ring")
    rows = t.events.where("event_type = 'error'").select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    out = Z.last_values_aggregate(batch_stream(t, rows, WEEK.format(div="div"), 4), "user_id", "ts", "value", 8, "average")
    finish(X.store_events(out, cfg, path))
    back = t.spark.read.parquet(path).withColumn("event_id", F.expr("CASE WHEN NOT is_aggregate THEN event_id END"))
    return tidy(back.select("user_id", "is_aggregate", "event_id", "value", "value_average"))


@query(
    "stream_drift_window",
    f"""WITH base AS (SELECT event_type AS f, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1),
    r AS (SELECT event_type AS f, value, {WEEK.format(div="//")} AS b, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
    e AS (SELECT f, b, max(rn) AS upto FROM r GROUP BY 1, 2),
    w AS (SELECT f, e.b, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM e JOIN r USING (f) WHERE e.upto >= 120 AND r.rn > e.upto - 150 AND r.rn <= e.upto GROUP BY f, e.b)
    SELECT f AS feature, base.n AS n_baseline, w.n AS n_current, round(abs(w.m - base.m) / (base.s + 1e-8), 6) AS mean_diff, round(abs(w.s - base.s) / (base.s + 1e-8), 6) AS std_diff FROM w JOIN base USING (f)""",
)
def stream_drift_window(t):
    """Drift of each type's last 150 values after every week; together the weeks reach the gate of 120 values."""
    Z.use_rocksdb(t.spark)
    baseline = t.events.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).select(F.col("event_type").alias("feature"), "value")
    cfg, path = config(t, "driftwindow")
    rows = t.events.select(F.col("event_type").alias("feature"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    out = Z.window_drift(batch_stream(t, rows, WEEK.format(div="div"), 4), baseline, "ts", 150, min_samples=120)
    finish(X.store_events(out, cfg, path))
    return tidy(t.spark.read.parquet(path).select("feature", "n_baseline", "n_current", "mean_diff", "std_diff"))


@query(
    "stream_drift_hot_keys",
    """WITH base AS (SELECT event_type AS f, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1),
    r AS (SELECT event_type AS f, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    w AS (SELECT f, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM r WHERE rn <= 150 GROUP BY 1)
    SELECT f AS feature, base.n AS n_baseline, w.n AS n_current, round(abs(w.m - base.m) / (base.s + 1e-8), 6) AS mean_diff, round(abs(w.s - base.s) / (base.s + 1e-8), 6) AS std_diff FROM w JOIN base USING (f)""",
)
def stream_drift_hot_keys(t):
    """The same windows as a table between micro-batches, for types with most of the rows; the result of the last one."""
    baseline = t.events.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).select(F.col("event_type").alias("feature"), F.lit("baseline").alias("side"), "value")
    cfg, path = config(t, "drifttable")
    rows = t.events.select(F.col("event_type").alias("feature"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    then = lambda held: drift.distribution(baseline.unionByName(held.select("feature", F.lit("current").alias("side"), "value")))
    fn = Z.last_rows_state(path, f"{path}_state", ["feature"], "ts", 150, then, ["event_id"])
    finish(X.each_batch(batch_stream(t, rows, WEEK.format(div="div"), 4), cfg, fn))
    last = t.spark.read.parquet(f"{path}/batch_id=3")
    return tidy(last.select("feature", "n_baseline", "n_current", "mean_diff", "std_diff"))


ACTED_SQL = """WITH raised AS (SELECT event_id, ts FROM events WHERE event_type = 'error'),
  acted AS (SELECT event_id, ts + CASE event_id % 3 WHEN 0 THEN INTERVAL 10 MINUTE ELSE INTERVAL 90 MINUTE END AS ts FROM raised WHERE event_id % 3 < 2),
  seen AS (SELECT max(ts) - INTERVAL 1 MINUTE AS upto FROM (SELECT ts FROM raised UNION ALL SELECT ts FROM acted))"""


@query(
    "stream_escalations",
    f"""{ACTED_SQL} SELECT event_id::VARCHAR AS alert_id, strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS escalated_at
    FROM raised, seen WHERE event_id % 3 = 1 OR (event_id % 3 = 2 AND ts + INTERVAL 30 MINUTE < upto)""",
)
def stream_escalations(t):
    """Alerts answered in time, answered late, and never answered, over four micro-batches; the last two kinds escalate."""
    raised = t.events.where("event_type = 'error'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("raised").alias("kind"))
    late = F.when(F.col("event_id") % 3 == 0, F.make_dt_interval(mins=F.lit(10))).otherwise(F.make_dt_interval(mins=F.lit(90)))
    acted = raised.where("event_id % 3 < 2").select("event_id", (F.col("ts") + late).alias("ts"), F.lit("acknowledge").alias("kind"))
    cfg, path = config(t, "escalate")
    rows = batch_stream(t, raised.unionByName(acted), "CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-24' THEN 2 ELSE 3 END", 4)
    out = X.escalations(rows.withColumnRenamed("event_id", "alert_id"), "alert_id", "ts", "kind", 30 * 60)
    finish(X.store_events(out, cfg, path))
    return tidy(t.spark.read.parquet(path).select("alert_id", "escalated_at"))
