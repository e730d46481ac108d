"""Queries over aggregation, windows and filters."""

from pyspark.sql import functions as F

from tidewatch.functions.common import same_type_literal
from tidewatch.operators import aggregates as A
from tidewatch.operators import predicates as P
from tidewatch.operators import windows as W
from tidewatch.plans.registry import query, rnd, stamp, tidy

EVENT_RULES = [
    {"type": "count", "column": "value", "output_key": "n_events"},
    {"type": "sum", "column": "value"},
    {"type": "mean", "column": "value"},
    {"type": "std", "column": "value"},
    {"type": "min", "column": "value"},
    {"type": "max", "column": "value"},
    {"type": "median", "column": "value"},
    {"type": "quantile", "column": "value", "quantile": 0.95, "output_key": "value_p95"},
    {"type": "unique_count", "column": "user_id", "output_key": "n_users"},
    {"type": "most_common", "column": "user_id", "output_key": "top_user"},
]

EVENT_RULES_SQL = """
  count(*) AS n_events, round(sum(value), 4) AS value_sum, round(avg(value), 6) AS value_mean,
  round(stddev_samp(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max,
  round(quantile_cont(value, 0.5), 6) AS value_median, round(quantile_cont(value, 0.95), 6) AS value_p95,
  count(DISTINCT user_id) AS n_users"""


def event_rules_sql(group: str, where: str = "") -> str:
    keys = f"{group}," if group else ""
    by = f"GROUP BY {group}" if group else ""
    join = f"JOIN best USING ({group})" if group else "CROSS JOIN best"
    return f"""
    WITH src AS (SELECT *, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start FROM events {where}),
    stats AS (SELECT {keys} {EVENT_RULES_SQL} FROM src {by}),
    counted AS (SELECT {keys} user_id, count(*) AS n FROM src GROUP BY {keys} user_id),
    ranked AS (SELECT *, row_number() OVER ({'PARTITION BY ' + group if group else ''} ORDER BY n DESC, user_id) AS r
               FROM counted),
    best AS (SELECT {keys} user_id AS top_user FROM ranked WHERE r = 1)
    SELECT stats.*, best.top_user FROM stats {join}"""


def _events_result(df):
    return df.withColumn("value_sum", F.round("value_sum", 4)).transform(tidy)


@query("agg_rules_global", event_rules_sql(""))
def agg_rules_global(t):
    return _events_result(A.aggregate(t.events, EVENT_RULES))


@query("agg_rules_by_group", event_rules_sql("event_type"))
def agg_rules_by_group(t):
    return _events_result(A.aggregate(t.events, EVENT_RULES, ["event_type"]))


@query("agg_window_hourly", event_rules_sql("event_type, window_start"))
def agg_window_hourly(t):
    return _events_result(A.aggregate_by_time(t.events, EVENT_RULES, "ts", "1H", ["event_type"]))


@query(
    "agg_window_sliding",
    """
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value
    FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w, value FROM events)
    GROUP BY 1""",
)
def agg_window_sliding(t):
    rules = [
        {"type": "count", "column": "value", "output_key": "n"},
        {"type": "mean", "column": "value", "output_key": "mean_value"},
    ]
    return tidy(A.aggregate_by_time(t.events, rules, "ts", "2D", slide="1D"))


@query(
    "agg_group_sum",
    "SELECT l_returnflag, round(sum(l_quantity), 4) AS total, count(*) AS n FROM lineitem GROUP BY 1",
)
def agg_group_sum(t):
    rules = [
        {"type": "sum", "column": "l_quantity", "output_key": "total"},
        {"type": "count", "column": "l_quantity", "output_key": "n"},
    ]
    return tidy(A.aggregate(t.lineitem, rules, ["l_returnflag"]), 4)


@query(
    "agg_custom_and_absent",
    """SELECT l_linestatus, round(sum(l_extendedprice * l_extendedprice) / 1e9, 4) AS energy
       FROM lineitem GROUP BY 1""",
)
def agg_custom_and_absent(t):
    rules = [
        {"type": "custom", "column": "l_extendedprice", "output_key": "energy", "function": lambda c: F.sum(c * c) / 1e9},
        {"type": "mean", "column": "no_such_column"},
    ]
    return tidy(A.aggregate(t.lineitem, rules, ["l_linestatus"]), 4)


DAILY_METRICS_SQL = """daily AS (
  SELECT event_type AS metric, date_trunc('day', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"""


def daily_metrics(t):
    return t.events.groupBy(
        F.col("event_type").alias("metric"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(F.avg("value").alias("value"))


@query(
    "trend_of_aggregates",
    f"""WITH {DAILY_METRICS_SQL},
    s AS (SELECT metric, count(*) AS n, arg_min(value, ts) AS f, arg_max(value, ts) AS l, stddev_pop(value) AS v
          FROM daily GROUP BY 1)
    SELECT metric, CASE WHEN l > f THEN 'increasing' ELSE 'decreasing' END AS trend,
           round(CASE WHEN f = 0 THEN 0 ELSE (l - f) / f * 100 END, 6) AS change_percent,
           round(v, 6) AS volatility FROM s WHERE n > 1""",
)
def trend_of_aggregates(t):
    return tidy(A.trends(daily_metrics(t)))


@query(
    "agg_summary",
    f"""WITH {DAILY_METRICS_SQL},
    s AS (SELECT metric, count(*) AS n, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM daily GROUP BY 1),
    c AS (SELECT count(*) AS n_events, avg(value) AS value_mean FROM events)
    SELECT 'current' AS section, 'n_events' AS metric, n_events::DOUBLE AS value, NULL::VARCHAR AS note FROM c
    UNION ALL SELECT 'current', 'value_mean', round(value_mean, 6), NULL FROM c
    UNION ALL SELECT 'trend', metric, round((l - f) / f * 100, 6),
              CASE WHEN l > f THEN 'increasing' ELSE 'decreasing' END FROM s WHERE n > 1
    UNION ALL SELECT 'quality', m, 100.0, NULL FROM (VALUES ('completeness'), ('consistency'), ('timeliness')) q(m)""",
)
def agg_summary(t):
    return tidy(A.summary(A.aggregate(t.events, EVENT_RULES[0:1] + EVENT_RULES[2:3]), daily_metrics(t)))


@query(
    "agg_column_statistics",
    """
    WITH x AS (SELECT l_returnflag AS k, l_extendedprice AS v FROM lineitem),
    m AS (SELECT k, avg(v) AS a, stddev_pop(v) AS s FROM x GROUP BY k)
    SELECT x.k AS l_returnflag, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
      min(v) AS min, max(v) AS max, round(avg(((v - a) / s) ** 3), 6) AS skew,
      round(avg(((v - a) / s) ** 4) - 3, 6) AS kurtosis, round(quantile_cont(v, 0.5), 6) AS median,
      round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75
    FROM x JOIN m USING (k) GROUP BY x.k""",
)
def agg_column_statistics(t):
    return tidy(A.column_statistics(t.lineitem, "l_extendedprice", ["l_returnflag"]))


@query(
    "agg_top_values",
    "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
)
def agg_top_values(t):
    return tidy(A.top_values(t.part, "p_type"))


LAST_N_WANTED = {
    "value_sum": ("sum", "value"),
    "value_average": ("average", "value"),
    "value_min": ("min", "value"),
    "value_max": ("max", "value"),
    "n": ("count", "value"),
    "other": ("unknown", "value"),
}


@query(
    "agg_last_rows_by_key",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    l AS (SELECT * FROM r WHERE rn <= 50)
    SELECT user_id, round(sum(value), 4) AS value_sum, round(avg(value), 6) AS value_average, min(value) AS value_min,
           max(value) AS value_max, count(*) AS n, 0.0::DOUBLE AS other
    FROM l GROUP BY 1 HAVING count(*) >= 50""",
)
def agg_last_rows_by_key(t):
    out = A.last_rows_aggregate(t.events, "ts", 50, LAST_N_WANTED, ["user_id"], ["event_id"])
    return tidy(out.withColumn("value_sum", F.round("value_sum", 4)))


@query(
    "agg_last_rows_short_keys",
    "SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) < 50)",
)
def agg_last_rows_short_keys(t):
    """Rows of the keys that have no full window."""
    return A.short_rows(t.events, 50, ["user_id"]).select("event_id", "user_id", "value")


@query(
    "agg_last_rows_or_all",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM events)
    SELECT true AS is_aggregate, user_id, NULL::BIGINT AS event_id, NULL::DOUBLE AS value, round(avg(value), 6) AS mean_value FROM r WHERE rn <= 50 AND c >= 50 GROUP BY user_id
    UNION ALL SELECT false, user_id, event_id, round(value, 6), NULL FROM r WHERE c < 50""",
)
def agg_last_rows_or_all(t):
    """Full windows as aggregates, the rows of short ones unchanged, in one result."""
    out = A.last_rows_or_all(t.events, "ts", 50, {"mean_value": ("average", "value")}, ["user_id"], ["event_id"])
    return tidy(out.select("is_aggregate", "user_id", "event_id", "value", "mean_value"))


@query(
    "agg_last_rows_global",
    """WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)
    SELECT round(sum(value), 4) AS value_sum, round(avg(value), 6) AS value_average, min(value) AS value_min,
           max(value) AS value_max, count(*) AS n, 0.0::DOUBLE AS other FROM l""",
)
def agg_last_rows_global(t):
    out = A.last_rows_aggregate(t.events, "ts", 500, LAST_N_WANTED, tiebreak=["event_id"])
    return tidy(out.withColumn("value_sum", F.round("value_sum", 4)))


# ---- filters and projections ----

FILTERS = [
    ("equals", "event_type", "equals", "error", "event_type = 'error'"),
    ("not_equals", "event_type", "not_equals", "error", "event_type <> 'error'"),
    ("greater_than", "value", "greater_than", 100.0, "value > 100"),
    ("less_than", "value", "less_than", 5.0, "value < 5"),
    ("contains", "value", "contains", "9.9", "contains(value::VARCHAR, '9.9')"),
    ("regex", "event_type", "regex", "i[ec]", "regexp_matches(event_type, 'i[ec]')"),
]


def _register_filters():
    for name, field, operator, value, sql in FILTERS:

        @query(f"filter_{name}", f"SELECT event_id, event_type, value FROM events WHERE {sql}")
        def run(t, field=field, operator=operator, value=value):
            rows = P.apply_filters(t.events, [{"field": field, "operator": operator, "value": value}])
            return rows.select("event_id", "event_type", "value")


_register_filters()


@query(
    "filter_chain",
    "SELECT event_id FROM events WHERE event_type <> 'view' AND value > 20 AND value < 60 AND props LIKE '%7%'",
)
def filter_chain(t):
    chain = [
        {"field": "event_type", "operator": "not_equals", "value": "view"},
        {"field": "value", "operator": "greater_than", "value": 20.0},
        {"field": "value", "operator": "less_than", "value": 60.0},
        {"field": "props", "operator": "contains", "value": "7"},
    ]
    return P.apply_filters(t.events, chain).select("event_id")


@query("filter_unknown_operator_lenient", "SELECT event_id FROM events WHERE value IS NOT NULL")
def filter_unknown_operator_lenient(t):
    rows = P.apply_filters(t.events, [{"field": "value", "operator": "near", "value": 3}], strict=False)
    return rows.select("event_id")


# a null and a missing key are written into the payload by expression
FAULTY_PROPS = """CASE WHEN event_id % 50 = 0 THEN '{"k": null}' WHEN event_id % 50 = 1 THEN '{"z": 1}' ELSE props END"""


@query(
    "filter_raw_not_equals",
    f"""WITH r AS (SELECT event_id, {FAULTY_PROPS} AS p FROM events)
    SELECT event_id FROM r WHERE json_exists(p, '$.k')
      AND ((p->>'$.k') IS NULL OR TRY_CAST(p->>'$.k' AS DOUBLE) IS NULL OR TRY_CAST(p->>'$.k' AS DOUBLE) <> 5)""",
)
def filter_raw_not_equals(t):
    rows = t.events.select("event_id", F.expr(FAULTY_PROPS).alias("p"))
    return rows.filter(P.raw_condition("p", "k", "not_equals", 5)).select("event_id")


@query("project_map_fields", "SELECT event_type AS kind, value AS amount FROM events")
def project_map_fields(t):
    return P.map_fields(t.events, {"event_type": "kind", "value": "amount", "absent": "x"})


@query("project_rename_fields", "SELECT event_id, event_type AS ts, user_id, value AS amount, props FROM events")
def project_rename_fields(t):
    return P.rename_fields(t.events, {"value": "amount", "event_type": "ts"})


@query("project_remove_fields", "SELECT event_id, user_id, event_type, value FROM events")
def project_remove_fields(t):
    return P.remove_fields(t.events, ["props", "ts"])


@query("project_custom", "SELECT event_id, round(value * 2, 6) AS doubled FROM events")
def project_custom(t):
    return P.custom(t.events, lambda d: d.select("event_id", rnd(F.col("value") * 2).alias("doubled")))


@query(
    "project_first_present",
    f"""WITH r AS (SELECT event_id, {FAULTY_PROPS} AS p FROM events)
    SELECT event_id, CASE WHEN json_exists(p, '$.k') THEN p->>'$.k' WHEN json_exists(p, '$.z') THEN p->>'$.z' END
      AS picked FROM r""",
)
def project_first_present(t):
    rows = t.events.select("event_id", F.expr(FAULTY_PROPS).alias("p"))
    return rows.select("event_id", P.first_present(["k", "z"], payload="p").alias("picked"))


@query(
    "filter_then_transform",
    "SELECT event_id AS id, value AS amount FROM events WHERE event_type = 'purchase' AND value > 50",
)
def filter_then_transform(t):
    config = {
        "filters": [
            {"field": "event_type", "operator": "equals", "value": "purchase"},
            {"field": "value", "operator": "greater_than", "value": 50.0},
        ],
        "transformations": [
            {"type": "field_mapping", "mapping": {"event_id": "id", "value": "v", "event_type": "e"}},
            {"type": "field_renaming", "renames": {"v": "amount"}},
            {"type": "field_removal", "fields": ["e"]},
        ],
    }
    return P.apply_processing(t.events, config)


# ---- row windows and series ----


@query(
    "rolling_features",
    """
    WITH f AS (SELECT event_id, event_type, value, count(value) OVER w AS n, avg(value) OVER w AS a,
      stddev_samp(value) OVER w AS s, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT event_id, event_type, CASE WHEN n = 5 THEN round(a, 6) END AS value_rolling_mean_5,
      CASE WHEN n = 5 THEN round(s, 4) END AS value_rolling_std_5, CASE WHEN n = 5 THEN lo END AS value_rolling_min_5,
      CASE WHEN n = 5 THEN hi END AS value_rolling_max_5 FROM f""",
)
def rolling_features(t):
    src = t.events.select("event_id", "event_type", "ts", "value")
    out = W.rolling(src, "value", "ts", 5, ("mean", "std", "min", "max"), ["event_type"], ["event_id"])
    return out.select(
        "event_id",
        "event_type",
        rnd("value_rolling_mean_5").alias("value_rolling_mean_5"),
        rnd("value_rolling_std_5", 4).alias("value_rolling_std_5"),
        "value_rolling_min_5",
        "value_rolling_max_5",
    )


@query(
    "trailing_mean",
    """
    WITH f AS (SELECT event_id, user_id, value, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER w AS a
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT event_id, user_id, round(CASE WHEN n < 10 THEN value ELSE a END, 6) AS aggregated FROM f""",
)
def trailing_mean(t):
    src = t.events.select("event_id", "user_id", "ts", "value")
    out = W.trailing(src, "value", "ts", "mean", 10, ["user_id"], ["event_id"])
    return out.select("event_id", "user_id", rnd("aggregated").alias("aggregated"))


@query(
    "trailing_sum_global",
    """
    WITH f AS (SELECT event_id, sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a
      FROM events) SELECT event_id, round(a, 4) AS aggregated FROM f""",
)
def trailing_sum_global(t):
    src = t.events.select("event_id", "ts", "value")
    out = W.trailing(src, "value", "ts", "sum", 10, (), ["event_id"])
    return out.select("event_id", rnd("aggregated", 4).alias("aggregated"))


@query(
    "series_last_points_trend",
    f"""WITH {DAILY_METRICS_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC) AS rn FROM daily),
    l AS (SELECT metric, value, 10 - rn AS x FROM r WHERE rn <= 10)
    SELECT metric, count(*) AS n_points, round(regr_slope(value, x), 6) AS slope,
           round(regr_intercept(value, x), 6) AS intercept FROM l GROUP BY 1 HAVING count(*) >= 10""",
)
def series_last_points_trend(t):
    return tidy(W.last_points_trend(daily_metrics(t), ["metric"], "ts", "value", 10))


@query(
    "series_time_trend",
    f"""WITH {DAILY_METRICS_SQL},
    s AS (SELECT metric, count(value) AS n_points, regr_slope(value, epoch(ts)) * 1e6 AS slope FROM daily
          WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
    SELECT metric, n_points, round(slope, 4) AS slope_e6,
           CASE WHEN slope > 0 THEN 'improving' ELSE 'degrading' END AS trend_direction FROM s WHERE n_points > 1""",
)
def series_time_trend(t):
    daily = daily_metrics(t)
    out = W.time_trend(daily, ["metric"], "ts", "value", since=same_type_literal(daily, "ts", "2024-01-10"))
    return out.select("metric", "n_points", rnd(F.col("slope") * 1e6, 4).alias("slope_e6"), "trend_direction")


@query(
    "series_newest_z",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    s AS (SELECT user_id, count(*) AS n_points, max(value) FILTER (rn = 1) AS newest_value,
      avg(value) FILTER (rn > 1) AS earlier_mean, stddev_pop(value) FILTER (rn > 1) AS earlier_std FROM r GROUP BY 1)
    SELECT user_id, newest_value, n_points, round(earlier_mean, 6) AS earlier_mean, round(earlier_std, 6) AS earlier_std,
      round(abs(newest_value - earlier_mean) / nullif(earlier_std, 0), 6) AS z_score FROM s WHERE n_points >= 10""",
)
def series_newest_z(t):
    return tidy(W.newest_z(t.events, ["user_id"], "ts", "value", ["event_id"]))


@query(
    "newest_rows",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events
       ORDER BY events.ts DESC, event_id DESC LIMIT 10""",
)
def newest_rows(t):
    return W.newest(t.events.select("event_id", "ts", "value"), "ts", 10, tiebreak=["event_id"]).withColumn(
        "ts", stamp("ts")
    )


@query(
    "latest_per_key",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER
       (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_per_key(t):
    out = W.latest_per_key(t.events.select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", ["event_id"])
    return out.drop("ts")


@query(
    "mean_duration",
    """SELECT o_orderpriority, round(avg(epoch(l_shipdate) - epoch(o_orderdate)), 3) AS mean_seconds
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL GROUP BY 1""",
)
def mean_duration(t):
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return tidy(W.mean_duration(joined, "o_orderdate", "l_shipdate", ["o_orderpriority"]), 3)
