"""Queries over feature building and text features."""

from pyspark.sql import functions as F

from tidewatch.operators import features as X
from tidewatch.operators import text as T
from tidewatch.plans.registry import query, rnd, tidy


@query(
    "feat_datetime_parts",
    """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
      day(o_orderdate) AS o_orderdate_day, hour(o_orderdate) AS o_orderdate_hour,
      isodow(o_orderdate) - 1 AS o_orderdate_dayofweek, isodow(o_orderdate) >= 6 AS o_orderdate_is_weekend FROM orders""",
)
def feat_datetime_parts(t):
    return tidy(X.datetime_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate"))


BIN_SQL = "greatest(1, least({n}, ceil(({x} - lo) / ((hi - lo) / {n}))))::BIGINT - 1"


@query(
    "feat_bins_equal_width",
    f"""SELECT p_partkey, {BIN_SQL.format(n=10, x='p_retailprice')} AS price_bin
    FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""",
)
def feat_bins_equal_width(t):
    out = X.bin_equal_width(t.part, "p_retailprice", 10, output="price_bin")
    return tidy(out.select("p_partkey", "price_bin"))


@query(
    "feat_bins_labelled",
    f"""SELECT p_partkey, ['low', 'mid', 'high'][{BIN_SQL.format(n=3, x='p_size')} + 1] AS size_band
    FROM part, (SELECT min(p_size) AS lo, max(p_size)::DOUBLE AS hi FROM part)""",
)
def feat_bins_labelled(t):
    out = X.bin_equal_width(t.part, "p_size", 3, ["low", "mid", "high"], "size_band")
    return out.select("p_partkey", "size_band")


@query(
    "feat_bins_by_edges",
    """SELECT p_partkey, CASE WHEN p_retailprice > 900 AND p_retailprice <= 950 THEN 'cheap' WHEN p_retailprice > 950 AND p_retailprice <= 1000
      THEN 'dear' END AS band FROM part""",
)
def feat_bins_by_edges(t):
    return X.bin_by_edges(t.part, "p_retailprice", [900, 950, 1000], ["cheap", "dear"], "band").select("p_partkey", "band")


NORMAL = {
    "z_score": ("avg({c})", "stddev_samp({c})"),
    "min_max": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def _register_normalize():
    for method, (centre, spread) in NORMAL.items():
        stats = ", ".join(
            f"{centre.format(c=c)} AS c_{c}, {spread.format(c=c)} AS s_{c}" for c in ("l_quantity", "l_extendedprice")
        )

        @query(
            f"feat_normalize_{method}",
            f"""SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - c_l_quantity) / s_l_quantity, 6) + 0.0 AS l_quantity_normalized,
            round((l_extendedprice - c_l_extendedprice) / s_l_extendedprice, 6) + 0.0 AS l_extendedprice_normalized
            FROM lineitem, (SELECT {stats} FROM lineitem)""",
        )
        def run(t, method=method):
            out = X.normalize(t.lineitem, ["l_quantity", "l_extendedprice", "absent"], method)
            return out.select(
                "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey",
                rnd("l_quantity_normalized").alias("l_quantity_normalized"),
                rnd("l_extendedprice_normalized").alias("l_extendedprice_normalized"),
            )


_register_normalize()


@query(
    "feat_scale_standard",
    """SELECT p_partkey, round((p_retailprice - a) / s, 6) + 0.0 AS p_retailprice_scaled
    FROM part, (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS s FROM part)""",
)
def feat_scale_standard(t):
    return tidy(X.scale(t.part, "p_retailprice").select("p_partkey", "p_retailprice_scaled"))


@query(
    "feat_scale_minmax",
    """SELECT p_partkey, round((p_size - lo) * 1.0 / (hi - lo), 6) + 0.0 AS p_size_scaled, 0.0::DOUBLE AS constant
    FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)""",
)
def feat_scale_minmax(t):
    out = X.scale(X.scale(t.part.withColumn("one", F.lit(1.0)), "p_size", "minmax"), "one", "minmax", "constant")
    return tidy(out.select("p_partkey", "p_size_scaled", "constant"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "feat_one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"o_orderpriority = '{p}' AS \"o_orderpriority_{p}\"" for p in PRIORITIES)
    + " FROM orders",
)
def feat_one_hot(t):
    return X.one_hot(t.orders, "o_orderpriority").select("o_orderkey", *[f"`o_orderpriority_{p}`" for p in PRIORITIES])


@query(
    "feat_label_encode",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE code END AS priority_encoded FROM orders JOIN
    (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders
     WHERE o_orderkey % 11 <> 0)) ON v = o_orderpriority""",
)
def feat_label_encode(t):
    o = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority")
    )
    return X.label_encode(o, "priority").select("o_orderkey", "priority_encoded")


@query(
    "feat_label_encode_many_values",
    """SELECT p_partkey, code AS p_name_encoded FROM part JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
    FROM (SELECT DISTINCT p_name AS v FROM part)) ON v = p_name""",
)
def feat_label_encode_many_values(t):
    return X.label_encode(t.part, "p_name").select("p_partkey", "p_name_encoded")


@query(
    "feat_frequency_encode",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS o_custkey_freq FROM orders",
)
def feat_frequency_encode(t):
    return X.frequency_encode(t.orders, "o_custkey").select("o_orderkey", "o_custkey_freq")


@query(
    "feat_interactions",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_extendedprice, 4) + 0.0 AS prod,
      round(l_extendedprice / nullif(l_tax, 0), 4) + 0.0 AS quot, round(l_quantity + l_tax, 4) AS total,
      round(l_tax - l_discount, 4) + 0.0 AS diff FROM lineitem""",
)
def feat_interactions(t):
    df = t.lineitem
    for kind, pair, out in (
        ("multiply", ["l_quantity", "l_extendedprice"], "prod"),
        ("divide", ["l_extendedprice", "l_tax"], "quot"),
        ("add", ["l_quantity", "l_tax"], "total"),
        ("subtract", ["l_tax", "l_discount"], "diff"),
    ):
        df = X.interaction(df, pair, kind, out)
    return tidy(df.select("l_orderkey", "l_linenumber", "l_partkey", "prod", "quot", "total", "diff"), 4)


@query(
    "feat_steps_in_order",
    f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS sd FROM orders)
    SELECT o_orderkey, month(o_orderdate) AS o_orderdate_month, {BIN_SQL.format(n=5, x='o_totalprice')} AS o_totalprice_binned,
      round((o_totalprice - a) / sd, 6) + 0.0 AS o_totalprice_normalized, count(*) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_freq,
      round(o_totalprice * o_custkey, 2) AS o_totalprice_o_custkey_interaction FROM orders, s""",
)
def feat_steps_in_order(t):
    steps = [
        {"type": "extract_datetime", "column": "o_orderdate"},
        {"type": "create_categorical", "column": "o_totalprice", "bins": 5},
        {"type": "normalize", "columns": ["o_totalprice"]},
        {"type": "encode_categorical", "columns": ["o_orderstatus"], "method": "frequency"},
        {"type": "create_interaction", "columns": ["o_totalprice", "o_custkey"]},
        {"type": "no_such_step"},
    ]
    out = X.apply_steps(t.orders, steps).select(
        "o_orderkey", "o_orderdate_month", "o_totalprice_binned", "o_totalprice_normalized", "o_orderstatus_freq",
        F.round("o_totalprice_o_custkey_interaction", 2).alias("o_totalprice_o_custkey_interaction"),
    )
    return tidy(out)


@query(
    "feat_numeric_from_text",
    """SELECT event_id, TRY_CAST(coalesce(CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN value::VARCHAR END, user_id::VARCHAR) AS DOUBLE) AS feature
    FROM events WHERE event_id % 3 <> 0""",
)
def feat_numeric_from_text(t):
    e = t.events.select(
        "event_id",
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN CAST(value AS STRING) END").alias("a"),
        F.col("user_id").cast("string").alias("b"),
    )
    return X.numeric_feature(e, ["a", "b"]).select("event_id", "feature")


@query(
    "feat_datetime_values",
    """SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS epoch, hour(ts)::DOUBLE AS hour, (isodow(ts) - 1)::DOUBLE AS dow,
       month(ts)::DOUBLE AS month FROM events""",
)
def feat_datetime_values(t):
    df = t.events.select("event_id", "ts")
    for kind, out in (("timestamp", "epoch"), ("hour", "hour"), ("day_of_week", "dow"), ("month", "month")):
        df = X.datetime_feature(df, "ts", kind, out)
    return df.select("event_id", F.round("epoch", 3).alias("epoch"), "hour", "dow", "month")


@query(
    "feat_date_range",
    """SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_ts, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_ts,
       count(o_orderdate) AS source_count FROM orders""",
)
def feat_date_range(t):
    return tidy(X.date_range(t.orders, "o_orderdate"))


@query("feat_text_length", "SELECT doc_id, length(text) AS feature FROM documents WHERE text IS NOT NULL")
def feat_text_length(t):
    return tidy(X.text_length(t.documents, "text").select("doc_id", "feature"))


@query(
    "feat_text_metadata",
    "SELECT lang, count(text) AS source_count, round(avg(length(text)), 6) AS avg_length, max(length(text)) AS max_length FROM documents GROUP BY 1",
)
def feat_text_metadata(t):
    return tidy(X.text_metadata(t.documents, "text", ["lang"]))


TFIDF_SQL = """
  w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
  c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
  v AS (SELECT term, sum(tf) AS total, count(*) AS docs FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 100),
  n AS (SELECT count(text) AS n FROM documents),
  raw AS (SELECT doc_id, term, tf * (ln((n + 1.0) / (docs + 1.0)) + 1) AS r FROM c JOIN v USING (term), n),
  norm AS (SELECT doc_id, sqrt(sum(r * r)) AS l FROM raw GROUP BY 1),
  tfidf AS (SELECT doc_id, term, r / l AS weight FROM raw JOIN norm USING (doc_id))"""


@query("feat_tfidf", f"WITH {TFIDF_SQL} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def feat_tfidf(t):
    return tidy(T.tfidf(t.documents, "doc_id", "text"))


@query(
    "feat_tfidf_first_term",
    f"""WITH {TFIDF_SQL}, f AS (SELECT doc_id, weight FROM tfidf WHERE term = (SELECT min(term) FROM tfidf))
    SELECT doc_id, round(coalesce(weight, 0.0), 6) AS feature FROM documents LEFT JOIN f USING (doc_id) WHERE text IS NOT NULL""",
)
def feat_tfidf_first_term(t):
    return tidy(T.first_term_weight(t.documents, "doc_id", "text"))


@query(
    "feat_derived",
    """SELECT event_id, concat_ws('_', event_type, CASE WHEN event_id % 2 = 0 THEN user_id END, event_id) AS joined,
      round(coalesce(TRY_CAST(event_type AS DOUBLE), 0) + coalesce(value, 0) + user_id, 4) AS total FROM events""",
)
def feat_derived(t):
    e = t.events.withColumn("even_user", F.when(F.col("event_id") % 2 == 0, F.col("user_id")))
    return tidy(e.select(
        "event_id", X.derive_concat(["event_type", "even_user", "event_id"]).alias("joined"),
        X.derive_sum(["event_type", "value", "user_id"]).alias("total"),
    ), 4)


@query("feat_derived_custom", "SELECT event_id, round(ln(value) + user_id, 6) AS per_user FROM events WHERE value > 1")
def feat_derived_custom(t):
    """A derived feature by the caller's own function of the table."""
    own = lambda df: df.where("value > 1").withColumn("per_user", F.ln("value") + F.col("user_id"))
    config = {"feature_name": "per_user", "feature_type": "derived", "source_fields": ["value"], "transformation": "custom", "parameters": {"function": own}}
    return tidy(X.engineer(t.events, config).select("event_id", "per_user"))


def _quality_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round(count({c}) * 1.0 / count(*) * (1 - count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)
      OR {c} > q3 + 1.5 * (q3 - q1)) * 1.0 / count({c})), 6) AS quality_score FROM x, (SELECT quantile_cont({c}, 0.25) AS q1,
      quantile_cont({c}, 0.75) AS q3 FROM x)"""


@query(
    "feat_quality_score",
    "WITH x AS (SELECT CASE WHEN event_id % 10 <> 0 THEN value END AS amount, user_id FROM events) "
    + " UNION ALL ".join(_quality_sql(c) for c in ("amount", "user_id")),
)
def feat_quality_score(t):
    x = t.events.select(F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("amount"), "user_id")
    return tidy(X.quality_score(x, ["amount", "user_id"]))


@query(
    "feat_statistics",
    """SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
       round(quantile_cont(value, 0.5), 6) AS median FROM events""",
)
def feat_statistics(t):
    return tidy(X.statistics(t.events, "value"))


@query(
    "feat_summary",
    """WITH r AS (SELECT event_type AS feature, date_trunc('day', ts) AS ts, avg(CASE WHEN value < 100 THEN 1.0 ELSE 0.0 END) AS q
      FROM events GROUP BY 1, 2),
    reg AS (SELECT DISTINCT event_type AS feature, CASE WHEN event_type IN ('click', 'view') THEN 'numeric' ELSE 'text' END AS k,
      event_type <> 'error' AS enabled FROM events),
    d AS (SELECT feature, avg(q) AS a FROM r GROUP BY 1)
    SELECT 'summary' AS section, 'total_features' AS name, count(*)::DOUBLE AS value FROM reg
    UNION ALL SELECT 'summary', 'active_features', count(*) FILTER (enabled)::DOUBLE FROM reg
    UNION ALL SELECT 'summary', 'overall_quality_score', round(avg(a), 6) FROM d
    UNION ALL SELECT 'feature_types', k, count(*)::DOUBLE FROM reg GROUP BY k
    UNION ALL SELECT 'feature_quality', feature, round(a, 6) FROM d""",
)
def feat_summary(t):
    results = t.events.groupBy(
        F.col("event_type").alias("feature"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(F.avg(F.when(F.col("value") < 100, 1.0).otherwise(0.0)).alias("quality_score"))
    registry = t.events.select(F.col("event_type").alias("feature")).distinct().select(
        "feature",
        F.when(F.col("feature").isin("click", "view"), "numeric").otherwise("text").alias("feature_type"),
        (F.col("feature") != "error").alias("enabled"),
    )
    return tidy(X.summary(results, registry))


@query(
    "feat_configured",
    """WITH s AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS sd FROM part),
    c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_type AS v FROM part))
    SELECT p_partkey, round((p_retailprice - a) / sd, 6) + 0.0 AS price, code AS kind, length(p_name) AS name_length,
      p_brand || '_' || p_size AS brand_size FROM part, s JOIN c ON v = p_type""",
)
def feat_configured(t):
    df = t.part
    for config in (
        {"feature_name": "price", "feature_type": "numeric", "source_fields": ["p_retailprice"], "transformation": "scale"},
        {"feature_name": "kind", "feature_type": "categorical", "source_fields": ["p_type"], "transformation": "encode"},
        {"feature_name": "name_length", "feature_type": "text", "source_fields": ["p_name"], "transformation": "extract",
         "parameters": {"extraction_type": "length"}},
        {"feature_name": "brand_size", "feature_type": "derived", "source_fields": ["p_brand", "p_size"]},
    ):
        df = X.engineer(df, config)
    return tidy(df.select("p_partkey", "price", "kind", "name_length", "brand_size"))
