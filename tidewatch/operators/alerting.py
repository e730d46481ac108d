"""Alert rules, cooldown, escalation, state, routing and message payloads.

Metrics are long: ``(metric, ts, value, …)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.common import join_on, micros, quoted, union_all
from tidewatch.operators.predicates import compare_by
from tidewatch.operators.windows import newest

RULE_SCHEMA = (
    "rule_id string, name string, description string, metric string, threshold double, operator string, severity string,"
    " channels array<string>, delay_minutes int, cooldown_minutes int, enabled boolean"
)
CHANNEL_SCHEMA = "channel_id string, channel_type string, name string, enabled boolean"

# Colour per severity in chat messages.
SEVERITY_COLOURS = {"info": "#36a64f", "warning": "#ffa500", "error": "#ff0000", "critical": "#8b0000"}
OTHER_COLOUR = "#808080"

# The rules and channels a deployment starts with.
DEFAULT_RULES = (
    {
        "rule_id": "performance_degradation", "name": "Performance Degradation",
        "description": "Alert when model performance drops below threshold",
        "metric": "accuracy", "threshold": 0.85, "operator": "<", "severity": "warning",
        "channels": ["email", "slack"], "delay_minutes": 30, "cooldown_minutes": 10,
    },
    {
        "rule_id": "high_latency", "name": "High Latency",
        "description": "Alert when model latency exceeds threshold",
        "metric": "latency_ms", "threshold": 200.0, "operator": ">", "severity": "error",
        "channels": ["email", "slack", "webhook"], "delay_minutes": 15, "cooldown_minutes": 5,
    },
    {
        "rule_id": "data_drift", "name": "Data Drift Detected",
        "description": "Alert when significant data drift is detected",
        "metric": "drift_score", "threshold": 0.1, "operator": ">", "severity": "warning",
        "channels": ["email", "slack"], "delay_minutes": 60, "cooldown_minutes": 30,
    },
)
DEFAULT_CHANNELS = (
    {"channel_id": "email_alerts", "channel_type": "email", "name": "Email Alerts"},
    {"channel_id": "slack_alerts", "channel_type": "slack", "name": "Slack Alerts"},
    {"channel_id": "webhook_alerts", "channel_type": "webhook", "name": "Webhook Alerts"},
)


def rules_table(spark: SparkSession, rules: Sequence[Mapping]) -> DataFrame:
    """Rule configuration as a table (as many rows as the caller wrote down)."""
    fields = T.StructType.fromDDL(RULE_SCHEMA).names
    base = {"operator": ">", "severity": "warning", "channels": [], "delay_minutes": None, "cooldown_minutes": 5, "enabled": True}
    rows = [{**base, **r} for r in rules]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], RULE_SCHEMA)


def channels_table(spark: SparkSession, channels: Sequence[Mapping]) -> DataFrame:
    rows = [(c["channel_id"], c["channel_type"], c.get("name"), c.get("enabled", True)) for c in channels]
    return spark.createDataFrame(rows, CHANNEL_SCHEMA)


def breaches(metrics: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Metric rows that meet an enabled rule, with the rule's columns.

    The rules come as configuration, so their table is small by construction
    and is broadcast.
    """
    table = F.broadcast(rules_table(metrics.sparkSession, rules).filter("enabled"))
    return metrics.join(table, "metric").filter(compare_by(F.col("operator"), F.col("value"), F.col("threshold")))


def cooldown(
    hits: DataFrame, keys: Sequence[str] = ("rule_id",), ts: str = "ts", tiebreak: str = "event_id",
    cooldown_seconds: str | Column = "cooldown_seconds", stretch_rows: int = 1 << 20, last_fired: DataFrame | None = None,
) -> DataFrame:
    """Keep the hits that fire: after one fires, its key is silent for the cooldown.

    Which hit fires depends on the one before, so a plain window cannot tell.
    Time is cut into cells of one cooldown, and neighbouring cells of a key are
    put together to stretches of about ``stretch_rows`` distinct times, so
    dense spells give short stretches.  Three steps follow: (1) every stretch
    tells, for each moment it may be entered (they all lie in its first cell),
    when its last alert is; (2) these short tables are chained per key;
    (3) every stretch is replayed from its true entry moment.  Steps 1 and 3
    run in parallel over all stretches, so one hot rule is spread as well.
    Hits of one key with different cooldowns are told apart, each cooldown has its own silence.
    ``last_fired`` (``keys, ts``) carries the silence over from earlier runs.
    """
    keys = list(keys)
    seconds = quoted(cooldown_seconds) if isinstance(cooldown_seconds, str) else cooldown_seconds
    work = hits.withColumn("__t", micros(quoted(ts))).withColumn("__c", seconds.cast("bigint") * 1_000_000)
    at_once = work.filter("__c <= 0").drop("__t", "__c")
    times = work.filter("__c > 0").groupBy(*keys, "__c", "__t").agg(F.min(quoted(tiebreak)).alias("__id"))
    if last_fired is None:
        times = times.withColumn("__o", F.lit(0).cast("bigint"))
    else:
        # stretches start where the silence of the earlier run ends
        known = last_fired.select(*keys, micros(quoted(ts)).alias("__last"))
        times = join_on(times, known, keys, "left").withColumn("__o", F.coalesce(F.expr("__last + __c"), F.lit(0)))
        times = times.filter("__last IS NULL OR __t >= __o").drop("__last")
    keys = [*keys, "__c"]
    times = times.withColumn("__cell", F.expr("(__t - __o - pmod(__t - __o, __c)) div __c"))
    cells = times.groupBy(*keys, "__o", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*keys, "__o").orderBy("__cell")
    cells = cells.withColumn("__b", F.floor((F.sum("__n").over(along) - F.col("__n")) / F.lit(stretch_rows)).cast("bigint"))
    first_cell = F.min("__cell").over(Window.partitionBy(*keys, "__o", "__b"))
    cells = cells.withColumn("__start", F.col("__o") + first_cell * F.col("__c")).drop("__n")
    times = join_on(times, cells, [*keys, "__o", "__cell"]).drop("__cell", "__o")
    types = {f.name: f.dataType.simpleString() for f in times.schema.fields}
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def outline(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(part["__t"].to_numpy())
        c, b, start = (int(part[x].iloc[0]) for x in ("__c", "__b", "__start"))
        step = np.minimum(np.searchsorted(t, t + c), len(t))
        last = np.arange(len(t) + 1)
        jump = np.append(np.where(step < len(t), step, np.arange(len(t))), len(t))
        while True:  # pointer doubling: log2 of the alerts in the stretch
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        last = jump[: len(t)]
        entries = min(len(t), int(np.searchsorted(t, start + c)) + 1)
        exits = t[last[:entries]]
        ends = np.append(np.flatnonzero(exits[1:] != exits[:-1]), entries - 1)
        out = pd.DataFrame({"__b": b, "__until": t[ends], "__exit": exits[ends]})
        for name, value in zip(keys, group):
            out.insert(0, name, value)
        return out

    outlines = times.groupBy(*keys, "__b").applyInPandas(
        outline, f"{', '.join(f'`{k}` {types[k]}' for k in reversed(keys))}, __b bigint, __until bigint, __exit bigint"
    )
    chained = outlines.repartition(*keys).sortWithinPartitions(*keys, "__b", "__until")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, allowed, done = None, None, None
        for batch in batches:
            rows = []
            for key, b, until, leave in zip(
                batch[keys].itertuples(index=False, name=None), batch["__b"], batch["__until"], batch["__exit"]
            ):
                if key != current:
                    current, allowed, done = key, None, None
                if b == done or (allowed is not None and until < allowed):
                    continue
                rows.append((*key, b, allowed if allowed is not None else np.iinfo(np.int64).min))
                allowed, done = leave + key[-1], b
            yield pd.DataFrame(rows, columns=[*keys, "__b", "__from"])

    entry = chained.mapInPandas(chain, f"{key_ddl}, __b bigint, __from bigint")

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__t")
        t, c, allowed = part["__t"].to_numpy(), int(part["__c"].iloc[0]), int(part["__from"].iloc[0])
        keep, i = [], int(np.searchsorted(t, allowed))
        while i < len(t):
            keep.append(i)
            i = int(np.searchsorted(t, t[i] + c))
        return part.iloc[keep][[*keys, "__t", "__id"]]

    fired = join_on(times, entry, [*keys, "__b"]).groupBy(*keys, "__b").applyInPandas(
        replay, f"{key_ddl}, __t bigint, __id {types['__id']}"
    )
    renamed = fired.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__t").alias("__ft"), "__id")
    cond = (F.col("__t") == F.col("__ft")) & (quoted(tiebreak) == F.col("__id"))
    for i, k in enumerate(keys):
        cond = cond & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    timed = work.filter("__c > 0").join(renamed, cond, "left_semi").drop("__t", "__c")
    return timed.unionByName(at_once)


def alerts(hits: DataFrame, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """Alert rows of fired hits: id, title, message, severity, status ``active``, metadata.

    The id holds rule, time and the hit's own ``tiebreak``, so alerts of one rule and moment have different ids.
    """
    t = quoted(ts).cast("timestamp")
    return hits.select(
        F.concat_ws("_", "rule_id", F.date_format(t, "yyyyMMdd_HHmmss_SSSSSS"), quoted(tiebreak).cast("string")).alias("alert_id"),
        "rule_id",
        F.concat(F.lit("Alert: "), "name").alias("title"),
        F.concat("description", F.lit(" - "), "metric", F.lit(": "), F.col("value").cast("string")).alias("message"),
        "severity",
        F.lit("active").alias("status"),
        t.alias("created_at"),
        F.create_map(F.lit("metric_name"), F.col("metric"), F.lit("metric_value"), F.col("value").cast("string")).alias("metadata"),
        "channels",
        "delay_minutes",
        F.lit(0).alias("escalation_level"),
    )


def escalate(raised: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Current state of alerts at ``now``.

    ``actions``: ``(alert_id, action, acted_at, acted_by)`` with ``acknowledge``
    or ``resolve``.  An alert without an action before ``created_at +
    delay_minutes`` is escalated one level; a later action still sets its
    status.  Alerts whose rule has no delay never escalate.
    """
    seen = actions.filter(F.col("acted_at") <= now).groupBy("alert_id").agg(
        F.min("acted_at").alias("first_action_at"),
        F.max_by(F.struct("action", "acted_at", "acted_by"), F.struct("acted_at", "action")).alias("last"),
    )
    deadline = F.col("created_at") + F.make_dt_interval(mins=F.col("delay_minutes"))
    overdue = F.coalesce(
        (deadline <= now) & (F.col("first_action_at").isNull() | (F.col("first_action_at") > deadline)), F.lit(False)
    )
    status = (
        F.when(F.col("last.action") == "resolve", "resolved")
        .when(F.col("last.action") == "acknowledge", "acknowledged")
        .when(overdue, "escalated").otherwise("active")
    )
    joined = raised.join(seen, "alert_id", "left")
    return joined.select(
        *[quoted(c) for c in raised.columns if c not in ("status", "escalation_level")],
        status.alias("status"),
        F.when(overdue, F.col("escalation_level") + 1).otherwise(F.col("escalation_level")).alias("escalation_level"),
        F.when(overdue, deadline).alias("escalated_at"),
        F.col("last.acted_at").alias("acted_at"),
        F.col("last.acted_by").alias("acted_by"),
    )


def counts(raised: DataFrame, since: Column | None = None) -> DataFrame:
    """Alert counts in all, by status, by severity and by rule: ``(dimension, value, n)``."""
    rows = raised if since is None else raised.filter(F.col("created_at") >= since)
    dims = ("status", "severity", "rule_id")
    grouped = rows.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dims]
    )
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def recent(raised: DataFrame, since: Column | None = None, limit: int = 10) -> DataFrame:
    rows = raised if since is None else raised.filter(F.col("created_at") >= since)
    return newest(rows, "created_at", limit, tiebreak=["alert_id"])


def route(raised: DataFrame, channels: Sequence[Mapping]) -> DataFrame:
    """One row per alert and enabled channel; a rule may name a channel by id or by type.

    The channels are configuration, so they come in as a literal map and nothing is joined or shuffled.  Several channels
    of one type get the alert each; naming a channel by id and by type still sends once.
    """
    named: dict[str, list[tuple[str, str]]] = {}
    for c in channels:
        if c.get("enabled", True):
            for name in {c["channel_id"], c["channel_type"]}:
                named.setdefault(name, []).append((c["channel_id"], c["channel_type"]))
    kind = "array<struct<channel_id:string,channel_type:string>>"
    if not named:
        return raised.withColumns({"channel_id": F.lit(None).cast("string"), "channel_type": F.lit(None).cast("string")}).where("false")
    known = F.create_map(*[
        x for name, targets in named.items()
        for x in (F.lit(name), F.array(*[F.struct(F.lit(i).alias("channel_id"), F.lit(k).alias("channel_type")) for i, k in targets]).cast(kind))
    ])
    targets = F.array_distinct(F.flatten(F.filter(F.transform("channels", lambda n: known[n]), lambda x: x.isNotNull())))
    return raised.withColumn("__to", F.explode(targets)).select(*[quoted(c) for c in raised.columns], "__to.channel_id", "__to.channel_type")


def payload(channel_type: Column) -> Column:
    """Message body per channel type (e-mail text, chat JSON, webhook JSON, short text)."""
    created = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    loud = F.upper("severity")
    colour = F.lit(OTHER_COLOUR)
    for name, value in SEVERITY_COLOURS.items():
        colour = F.when(F.col("severity") == name, F.lit(value)).otherwise(colour)
    # Layout of the messages.
    email = F.concat(
        F.lit("["), loud, F.lit("] "), F.col("title"),
        F.lit("\n\nAlert Details:\n- Title: "), F.col("title"), F.lit("\n- Message: "), F.col("message"),
        F.lit("\n- Severity: "), F.col("severity"), F.lit("\n- Created: "), created,
        F.lit("\n- Alert ID: "), F.col("alert_id"), F.lit("\n\nPlease take appropriate action."),
    )

    def item(title: str, value: Column, short: bool) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))

    chat = F.to_json(F.struct(
        F.concat(F.lit("🚨 *"), F.col("title"), F.lit("*")).alias("text"),
        F.array(F.struct(colour.alias("color"), F.array(
            item("Message", F.col("message"), False), item("Severity", F.col("severity"), True),
            item("Alert ID", F.col("alert_id"), True), item("Created", created, True),
        ).alias("fields"))).alias("attachments"),
    ))
    hook = F.to_json(F.struct(
        "alert_id", "title", "message", "severity", "status", created.alias("created_at"), "metadata"
    ))
    short = F.concat(F.lit("ALERT ["), loud, F.lit("]: "), F.col("title"), F.lit(" - "), F.col("message"))
    return (
        F.when(channel_type == "email", email).when(channel_type == "slack", chat)
        .when(channel_type == "webhook", hook).when(channel_type == "sms", short)
    )


def outbox(raised: DataFrame, channels: Sequence[Mapping]) -> DataFrame:
    """Messages to send: ``(alert_id, channel_id, channel_type, payload)``."""
    routed = route(raised, channels)
    return routed.select("alert_id", "channel_id", "channel_type", payload(F.col("channel_type")).alias("payload")).filter(
        F.col("payload").isNotNull()
    )


def fire(metrics: DataFrame, rules: Sequence[Mapping], ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """Rules → cooldown → alert rows, in one call."""
    hits = breaches(metrics, rules).withColumn("cooldown_seconds", F.col("cooldown_minutes") * 60)
    return alerts(cooldown(hits, ts=ts, tiebreak=tiebreak), ts, tiebreak)


def process_metrics(
    wide: DataFrame, names: Sequence[str], rules: Sequence[Mapping], fired_triggers: DataFrame | None = None,
    due_reports: DataFrame | None = None, ts: str = "ts", tiebreak: str | None = None,
) -> DataFrame:
    """Status of one batch of metric rows: ``(system, item, n)`` for alerts by rule, investigations and due reports.

    All metrics are checked against the rules, and a rule that fired is silent for its cooldown.  ``tiebreak`` names the
    row's own id; without it, rows of one time are one for a rule with a cooldown.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), quoted(n).cast("double").alias("value")) for n in names])
    own = quoted(tiebreak if tiebreak else ts)
    long = wide.select(quoted(ts).alias("ts"), own.alias("event_id"), F.inline(pairs)).filter("value is not null")
    hits = breaches(long, rules).withColumn("cooldown_seconds", F.col("cooldown_minutes") * 60)
    parts = [
        cooldown(hits).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("alerting").alias("system"), F.col("rule_id").alias("item"), "n")
    ]
    if fired_triggers is not None:
        parts.append(fired_triggers.select(
            F.lit("root_cause").alias("system"), F.col("trigger_id").alias("item"), F.lit(1).cast("bigint").alias("n")))
    if due_reports is not None:
        parts.append(due_reports.select(
            F.lit("reporting").alias("system"), F.col("report_id").alias("item"), F.lit(1).cast("bigint").alias("n")))
    return union_all(parts)
