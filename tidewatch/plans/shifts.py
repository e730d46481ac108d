"""Queries over distribution drift."""

from pyspark.sql import functions as F

from tidewatch.functions.common import same_type_literal
from tidewatch.operators import drift as D
from tidewatch.operators import iforest
from tidewatch.operators.monitoring import process_dataset
from tidewatch.plans.registry import query, tidy

SPLIT = "2024-01-15"
SHIP_SPLIT = "1998-06-01"


def event_sides(t):
    e = t.events.select("event_type", "ts", "value")
    base = F.col("ts") < same_type_literal(e, "ts", SPLIT)
    return e.select(
        F.col("event_type").alias("feature"), F.when(base, "baseline").otherwise("current").alias("side"), "value"
    )


def line_sides(t):
    rows = t.lineitem
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return D.to_sides(rows, features, F.col("l_shipdate") < same_type_literal(rows, "l_shipdate", SHIP_SPLIT))


EVENT_SIDES = f"""sides AS (SELECT event_type AS feature,
  CASE WHEN ts < TIMESTAMP '{SPLIT}' THEN 'baseline' ELSE 'current' END AS side, value FROM events)"""
LINE_SIDES = "sides AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN l_shipdate < TIMESTAMP '{SHIP_SPLIT}' THEN 'baseline' ELSE 'current' END AS side, {c} AS value FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
) + ")"

RANK_SQL = """
c AS (SELECT feature, value, count(*) FILTER (side = 'baseline') AS nb, count(*) FILTER (side = 'current') AS nc
      FROM sides GROUP BY 1, 2),
p AS (SELECT *, sum(nb) OVER w AS cb, sum(nc) OVER w AS cc, sum(nb) OVER (PARTITION BY feature) AS tb,
      sum(nc) OVER (PARTITION BY feature) AS tc FROM c
      WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ranks AS (SELECT feature, max(tb)::DOUBLE AS n1, max(tc)::DOUBLE AS n2,
      max(abs(cb::DOUBLE / tb - cc::DOUBLE / tc)) AS ks,
      sum(nb * ((cb - nb + cc - nc)::DOUBLE + (nb + nc + 1) / 2.0)) AS r1,
      sum(((nb + nc)::DOUBLE) ** 3 - (nb + nc)) AS ties FROM p GROUP BY feature),
tests AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u,
      (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5)
        / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM ranks),
m AS (SELECT feature, avg(value) FILTER (side = 'baseline') AS m1, avg(value) FILTER (side = 'current') AS m2,
      var_samp(value) FILTER (side = 'baseline') AS v1, var_samp(value) FILTER (side = 'current') AS v2
      FROM sides GROUP BY 1),
ts AS (SELECT tests.*, n1 + n2 - 2 AS df,
      (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t
      FROM tests JOIN m USING (feature))"""

# p-values by Simpson's rule over the densities: an independent route to the same numbers
PVALUE_SQL = """
g AS (SELECT i::DOUBLE AS i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
      FROM generate_series(0, 4000) s(i)),
pv AS (SELECT feature,
      greatest(0, least(1, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))
        FROM generate_series(1, 100) q(k)))) AS ks_series, lam
      FROM (SELECT feature, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * ks AS lam FROM ts)),
nt AS (SELECT feature,
      1 - sqrt(2 / pi()) * sum(w * exp(-0.5 * (greatest(z, 0) * i / 4000) ** 2)) * greatest(z, 0) / 12000 AS mw_p,
      1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
        * sum(w * (1 + (t * i / 4000) ** 2 / df) ** (-(df + 1) / 2)) * abs(t) / 12000 AS t_p
      FROM ts, g GROUP BY feature, z, t, df)"""


def statistical_sql(sides: str) -> str:
    return f"""WITH {sides}, {RANK_SQL}, {PVALUE_SQL},
    a AS (SELECT ts.*, CASE WHEN lam < 0.2 THEN 1.0 ELSE ks_series END AS ks_p, mw_p, t_p
          FROM ts JOIN pv USING (feature) JOIN nt USING (feature)),
    b AS (SELECT *, (ks_p + mw_p + t_p) / 3 AS mp, n1 >= 100 AND n2 >= 100 AS enough FROM a)
    SELECT feature, enough AND 1 - mp > 0.05 AS drift_detected, CASE WHEN enough THEN round(1 - mp, 5) ELSE 0 END AS drift_score,
      CASE WHEN enough THEN round(1 - sqrt(((ks_p - mp) ** 2 + (mw_p - mp) ** 2 + (t_p - mp) ** 2) / 3), 5) ELSE 0 END AS confidence,
      'statistical' AS method, n1::BIGINT AS n_baseline, n2::BIGINT AS n_current, round(ks, 5) AS ks_statistic,
      round(ks_p, 5) AS ks_pvalue, round(u, 5) AS mw_statistic, round(mw_p, 5) AS mw_pvalue,
      round(t, 5) AS t_statistic, round(t_p, 5) AS t_pvalue, enough AND least(ks_p, mw_p, t_p) < 0.05 AS p_flag FROM b"""


@query("drift_statistical_events", statistical_sql(EVENT_SIDES))
def drift_statistical_events(t):
    return tidy(D.statistical(event_sides(t)), 5)


@query("drift_statistical_many_features", statistical_sql(LINE_SIDES))
def drift_statistical_many_features(t):
    return tidy(D.statistical(line_sides(t)), 5)


@query(
    "drift_rank_tests",
    f"WITH {EVENT_SIDES}, {RANK_SQL} SELECT feature, n1::BIGINT AS n_baseline, n2::BIGINT AS n_current, "
    "round(ks, 6) AS ks_statistic, round(u, 4) AS mw_statistic, round(z, 6) AS mw_z FROM ts",
)
def drift_rank_tests(t):
    return tidy(D.rank_tests(event_sides(t)).withColumn("mw_statistic", F.round("mw_statistic", 4)))


@query(
    "drift_t_test",
    f"WITH {LINE_SIDES}, {RANK_SQL} SELECT feature, round(t, 6) AS t_statistic, df::DOUBLE AS t_df FROM ts",
)
def drift_t_test(t):
    return tidy(D.t_test(line_sides(t)))


def moments(side: str, a: str) -> str:
    return f"""{a} AS (SELECT feature, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM sides WHERE side = '{side}' GROUP BY 1),
    {a}2 AS (SELECT feature, n, m, s, sk, ku FROM {a} JOIN (SELECT feature, avg(((value - m) / s) ** 3) AS sk,
      avg(((value - m) / s) ** 4) - 3 AS ku FROM sides JOIN {a} USING (feature) WHERE side = '{side}' GROUP BY 1) USING (feature))"""


@query(
    "drift_distribution",
    f"""WITH {LINE_SIDES}, {moments('baseline', 'b')}, {moments('current', 'c')},
    d AS (SELECT feature, b2.n AS nb, c2.n AS nc, abs(c2.m - b2.m) / (b2.s + 1e-8) AS mean_diff,
      abs(c2.s - b2.s) / (b2.s + 1e-8) AS std_diff, abs(c2.sk - b2.sk) AS skew_diff, abs(c2.ku - b2.ku) AS kurt_diff
      FROM b2 JOIN c2 USING (feature)),
    e AS (SELECT *, least((mean_diff + std_diff + skew_diff + kurt_diff) / 4, 1.0) AS score FROM d)
    SELECT feature, score > 0.01 AS drift_detected, round(score, 6) AS drift_score, round(least(nc * 1.0 / nb, 1.0), 6) AS confidence,
      'distribution' AS method, nb AS n_baseline, nc AS n_current, round(mean_diff, 6) AS mean_diff,
      round(std_diff, 6) AS std_diff, round(skew_diff, 6) AS skew_diff, round(kurt_diff, 6) AS kurt_diff FROM e""",
)
def drift_distribution(t):
    return tidy(D.distribution(line_sides(t), threshold=0.01))


@query(
    "drift_gate_small_samples",
    f"""WITH {EVENT_SIDES} SELECT feature, false AS drift_detected, 0.0::DOUBLE AS drift_score,
    count(*) FILTER (side = 'current') AS n_current FROM sides GROUP BY 1""",
)
def drift_gate_small_samples(t):
    out = D.statistical(event_sides(t), min_samples=1_000_000_000)
    return out.select("feature", "drift_detected", "drift_score", "n_current")


@query(
    "drift_baseline_snapshot",
    f"""WITH {LINE_SIDES}, {moments('baseline', 'b')}
    SELECT feature, any_value(b2.n) AS n, round(any_value(m), 6) AS mean, round(any_value(s), 6) AS std, min(value) AS min,
      max(value) AS max, round(any_value(sk), 6) AS skew, round(any_value(ku), 6) AS kurtosis,
      round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25,
      round(quantile_cont(value, 0.75), 6) AS q75
    FROM sides JOIN b2 USING (feature) WHERE side = 'baseline' GROUP BY feature""",
)
def drift_baseline_snapshot(t):
    return tidy(D.baseline_snapshot(line_sides(t).filter(F.col("side") == "baseline")))


@query("drift_isolation_forest")
def drift_isolation_forest(t):
    e = t.events
    base = F.col("ts") < same_type_literal(e, "ts", SPLIT)
    return tidy(iforest.drift(e, "value", ["event_id"], base))


@query("quality_outlier_forest")
def quality_outlier_forest(t):
    flagged = iforest.outlier_flags(t.events.select("event_id", "value"), "value", ["event_id"])
    return flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_outlier").alias("outliers"))


@query(
    "drift_summary",
    """WITH d AS (SELECT event_type AS feature, date_trunc('day', ts) AS ts, avg(value) > 50 AS hit FROM events GROUP BY 1, 2),
    p AS (SELECT feature, count(*) AS total_checks, count(*) FILTER (hit) AS drift_events, max(ts) AS last FROM d GROUP BY 1)
    SELECT feature, total_checks, drift_events, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_check,
      round(drift_events * 1.0 / total_checks, 6) AS drift_rate, (drift_events > 0)::BIGINT AS features_with_drift FROM p
    UNION ALL SELECT NULL, sum(total_checks)::BIGINT, sum(drift_events)::BIGINT, strftime(max(last), '%Y-%m-%d %H:%M:%S'),
      round(avg((drift_events > 0)::INT), 6), sum((drift_events > 0)::INT)::BIGINT FROM p""",
)
def drift_summary(t):
    daily = t.events.groupBy(
        F.col("event_type").alias("feature"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")
    ).agg((F.avg("value") > 50).alias("drift_detected"))
    return tidy(D.summary(daily))


@query(
    "dataset_drift_quality_features",
    f"""WITH b AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE ts < TIMESTAMP '{SPLIT}'),
    c AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE ts >= TIMESTAMP '{SPLIT}'),
    q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT 'drift' AS stage, 'value' AS item, round(abs(c.m - b.m) / (b.s + 1e-8), 6) AS result FROM b, c
    UNION ALL SELECT 'quality', 'r1', round(1 - count(*) FILTER (value > 200) * 1.0 / count(*), 6) FROM events
    UNION ALL SELECT 'features', 'amount', round(1 - count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 1.0 / count(*), 6) FROM events, q""",
)
def dataset_drift_quality_features(t):
    e = t.events
    done = process_dataset(e, {
        "drift": {"columns": ["value"], "is_baseline": F.col("ts") < same_type_literal(e, "ts", SPLIT), "method": "distribution"},
        "rules": [{"rule_id": "r1", "rule_type": "range", "field_name": "value", "parameters": {"max_value": 200}}],
        "features": [{"feature_name": "amount", "feature_type": "numeric", "source_fields": ["value"]}],
    })

    def rows(df, stage, item, result):
        return df.select(F.lit(stage).alias("stage"), F.col(item).alias("item"), F.col(result).alias("result"))

    return tidy(
        rows(done.drift, "drift", "feature", "mean_diff")
        .unionByName(rows(done.quality, "quality", "rule_id", "score"))
        .unionByName(rows(done.features, "features", "feature", "quality_score"))
    )
