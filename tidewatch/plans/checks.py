"""Queries over record validation, batch profiles and quality rules."""

from pyspark.sql import functions as F

from tidewatch.operators import quality as Q
from tidewatch.operators import validation as V
from tidewatch.plans.registry import query, tidy

# faults are written into the payload by expression; the same text runs in both engines
PAYLOAD = """CASE event_id % 40
  WHEN 0 THEN '{"k": null}' WHEN 1 THEN '{"z": 1}' WHEN 2 THEN '{"k": "abc", "s": "x"}'
  WHEN 3 THEN '{"k": 5, "s": "ok", "b": true, "a": [1], "o": {"p": 1}}' WHEN 4 THEN '{"k": 0.5, "s": ""}'
  WHEN 5 THEN '{"k": true, "s": 7}' WHEN 6 THEN '{"k": 12, "s": "12x", "b": "no", "a": 3, "o": []}'
  ELSE props END"""

J = "json_type(p, '$.{f}')"
NUM = (
    "(CASE WHEN json_type(p, '$.{f}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(p->>'$.{f}' AS DOUBLE) "
    "WHEN json_type(p, '$.{f}') = 'BOOLEAN' THEN CASE WHEN p->>'$.{f}' = 'true' THEN 1 ELSE 0 END END)"
)
HAS = "(json_type(p, '$.{f}') IS NOT NULL AND json_type(p, '$.{f}') <> 'NULL')"
TRUTHY = (
    "(json_type(p, '$.{f}') IS NOT NULL AND json_type(p, '$.{f}') <> 'NULL' AND p->>'$.{f}' <> '' AND coalesce("
    + NUM + " <> 0, true))"
)
SRC = f"src AS (SELECT event_id, {PAYLOAD} AS p FROM events)"


def payloads(t):
    return t.events.select("event_id", F.expr(PAYLOAD).alias("p"))


def joined(errors: str = "errors"):
    return F.concat_ws("|", errors).alias("errors")


SCHEMA = {
    "type": "object",
    "required": ["k"],
    "properties": {
        "k": {"type": "number", "minimum": 3, "maximum": 95},
        "s": {"type": "string", "minLength": 1, "maxLength": 2, "pattern": "^[a-z]"},
    },
}
REPR = "CASE WHEN json_type(p, '$.{f}') = 'VARCHAR' THEN '''' || (p->>'$.{f}') || '''' WHEN json_type(p, '$.{f}') = 'NULL' THEN 'None' ELSE p->>'$.{f}' END"


def f(text: str, name: str) -> str:
    return text.replace("{f}", name)


SCHEMA_SQL = f"""'Schema validation failed: ' || CASE
  WHEN {f(J, 'k')} IS NULL THEN '''k'' is a required property'
  WHEN {f(J, 'k')} NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN {f(REPR, 'k')} || ' is not of type ''number'''
  WHEN {f(NUM, 'k')} < 3 THEN {f(REPR, 'k')} || ' is less than the minimum of 3'
  WHEN {f(NUM, 'k')} > 95 THEN {f(REPR, 'k')} || ' is greater than the maximum of 95'
  WHEN {f(J, 's')} IS NULL THEN NULL
  WHEN {f(J, 's')} <> 'VARCHAR' THEN {f(REPR, 's')} || ' is not of type ''string'''
  WHEN length(p->>'$.s') < 1 THEN {f(REPR, 's')} || ' is too short'
  WHEN length(p->>'$.s') > 2 THEN {f(REPR, 's')} || ' is too long'
  WHEN NOT regexp_matches(p->>'$.s', '^[a-z]') THEN {f(REPR, 's')} || ' does not match ''^[a-z]'''
END"""


@query(
    "validate_json_schema",
    f"WITH {SRC} SELECT event_id, coalesce({SCHEMA_SQL}, '') AS errors, ({SCHEMA_SQL}) IS NULL AS is_valid FROM src",
)
def validate_json_schema(t):
    out = V.validate(payloads(t), schema=SCHEMA, payload="p")
    return out.select("event_id", joined(), "is_valid")


RULE_CASES = [
    ("required", [{"type": "required", "field": "k"}], f"{f(J, 'k')} IS NULL", "Required field 'k' is missing"),
    ("not_null", [{"type": "not_null", "field": "k"}], f"{f(J, 'k')} = 'NULL'", "Field 'k' cannot be null"),
    (
        "min_length",
        [{"type": "min_length", "field": "s", "value": 2}],
        f"{f(TRUTHY, 's')} AND length(p->>'$.s') < 2",
        "Field 's' must be at least 2 characters",
    ),
    (
        "max_length",
        [{"type": "max_length", "field": "s", "value": 2}],
        f"{f(TRUTHY, 's')} AND length(p->>'$.s') > 2",
        "Field 's' must be at most 2 characters",
    ),
    (
        "min_value",
        [{"type": "min_value", "field": "k", "value": 10}],
        f"{f(NUM, 'k')} < 10",
        "Field 'k' must be at least 10",
    ),
    (
        "max_value",
        [{"type": "max_value", "field": "k", "value": 90}],
        f"{f(NUM, 'k')} > 90",
        "Field 'k' must be at most 90",
    ),
    (
        "regex",
        [{"type": "regex", "field": "s", "value": "[a-z]+"}],
        f"{f(TRUTHY, 's')} AND NOT regexp_matches(p->>'$.s', '^(?:[a-z]+)')",
        "Field 's' does not match pattern [a-z]+",
    ),
    (
        "enum",
        [{"type": "enum", "field": "s", "value": ["x", "ok", 7]}],
        f"NOT coalesce(({f(J, 's')} = 'VARCHAR' AND p->>'$.s' IN ('x', 'ok')) OR {f(NUM, 's')} = 7, false)",
        "Field 's' must be one of ['x', 'ok', 7]",
    ),
]


def _register_rules():
    for name, rules, cond, message in RULE_CASES:
        text = message.replace("'", "''")

        @query(
            f"validate_{name}",
            f"WITH {SRC} SELECT event_id, CASE WHEN {cond} THEN '{text}' ELSE '' END AS errors FROM src",
        )
        def run(t, rules=rules):
            return V.validate(payloads(t), rules=rules, payload="p").select("event_id", joined())


_register_rules()

TYPE_RULES = [
    {"type": "data_type", "field": "k", "value": "number"},
    {"type": "data_type", "field": "s", "value": "string"},
    {"type": "data_type", "field": "b", "value": "boolean"},
    {"type": "data_type", "field": "a", "value": "array"},
    {"type": "data_type", "field": "o", "value": "object"},
]


@query(
    "validate_data_type",
    f"""WITH {SRC} SELECT event_id, concat_ws('|',
      CASE WHEN {f(HAS, 'k')} AND {f(J, 'k')} NOT IN ('UBIGINT','BIGINT','DOUBLE','BOOLEAN') THEN 'Field ''k'' must be a number' END,
      CASE WHEN {f(HAS, 's')} AND {f(J, 's')} <> 'VARCHAR' THEN 'Field ''s'' must be a string' END,
      CASE WHEN {f(HAS, 'b')} AND {f(J, 'b')} <> 'BOOLEAN' THEN 'Field ''b'' must be a boolean' END,
      CASE WHEN {f(HAS, 'a')} AND {f(J, 'a')} <> 'ARRAY' THEN 'Field ''a'' must be an array' END,
      CASE WHEN {f(HAS, 'o')} AND {f(J, 'o')} <> 'OBJECT' THEN 'Field ''o'' must be an object' END) AS errors FROM src""",
)
def validate_data_type(t):
    return V.validate(payloads(t), rules=TYPE_RULES, payload="p").select("event_id", joined())


LIMITS = {"k": {"z_score_threshold": 1.5, "mean": 50, "std": 28, "min_value": 2, "max_value": 97}, "s": {"pattern": "[a-z]"}}
LIMITS_SQL = f"""concat_ws('|',
      CASE WHEN abs(({f(NUM, 'k')} - 50) / 28.0) > 1.5
        THEN 'Anomaly detected in field ''k'': z-score ' || printf('%.2f', ({f(NUM, 'k')} - 50) / 28.0) END,
      CASE WHEN {f(NUM, 'k')} < 2 THEN 'Anomaly detected in field ''k'': value ' || (p->>'$.k') || ' below minimum 2' END,
      CASE WHEN {f(NUM, 'k')} > 97 THEN 'Anomaly detected in field ''k'': value ' || (p->>'$.k') || ' above maximum 97' END,
      CASE WHEN {f(HAS, 's')} AND NOT regexp_matches(p->>'$.s', '^(?:[a-z])')
        THEN 'Anomaly detected in field ''s'': value does not match expected pattern' END)"""


@query("validate_anomaly_limits", f"WITH {SRC} SELECT event_id, {LIMITS_SQL} AS errors FROM src")
def validate_anomaly_limits(t):
    return V.validate(payloads(t), limits=LIMITS, payload="p").select("event_id", joined())


ALL_RULES = [rules[0] for _, rules, _, _ in RULE_CASES[:7]]


def checked(t):
    return V.validate(payloads(t), SCHEMA, ALL_RULES, LIMITS, payload="p")


CHECKED_SQL = f"""{SRC}, checked AS (SELECT event_id, list_filter([{SCHEMA_SQL},
  {', '.join("CASE WHEN " + c + " THEN '" + m.replace("'", "''") + "' END" for _, _, c, m in RULE_CASES[:7])}]
  || string_split({LIMITS_SQL}, '|'), lambda x: x IS NOT NULL AND x <> '') AS errors FROM src),
  verdict AS (SELECT event_id, errors, len(errors) = 0 AS is_valid FROM checked)"""


@query(
    "validate_records",
    f"WITH {CHECKED_SQL} SELECT event_id, array_to_string(errors, '|') AS errors, is_valid FROM verdict",
)
def validate_records(t):
    return checked(t).select("event_id", joined(), "is_valid")


@query(
    "validate_batch_totals",
    f"""WITH {CHECKED_SQL} SELECT count(*) AS total_records, count(*) FILTER (is_valid) AS valid_records,
    count(*) FILTER (NOT is_valid) AS invalid_records,
    round(count(*) FILTER (is_valid) * 100.0 / count(*), 6) AS validation_rate FROM verdict""",
)
def validate_batch_totals(t):
    return tidy(V.totals(checked(t)))


@query(
    "validate_quarantine",
    f"WITH {CHECKED_SQL} SELECT event_id AS record_id, array_to_string(errors, '|') AS errors FROM verdict WHERE NOT is_valid",
)
def validate_quarantine(t):
    return V.invalid_records(checked(t), "event_id").select("record_id", joined())


SUMMARY_SQL = f"""{CHECKED_SQL}, e AS (SELECT unnest(errors) AS error FROM verdict),
  sums AS (SELECT CASE WHEN contains(error, ':') THEN split_part(error, ':', 1) ELSE 'Unknown' END AS error_type,
    count(*) AS n FROM e GROUP BY 1)"""


@query("validate_error_summary", f"WITH {SUMMARY_SQL} SELECT * FROM sums")
def validate_error_summary(t):
    return V.error_summary(checked(t))


@query(
    "validate_report",
    f"""WITH {SUMMARY_SQL}, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (is_valid)::DOUBLE AS v FROM verdict)
    SELECT 'summary' AS section, 'total_records' AS name, n AS value FROM c
    UNION ALL SELECT 'summary', 'valid_records', v FROM c UNION ALL SELECT 'summary', 'invalid_records', n - v FROM c
    UNION ALL SELECT 'summary', 'validation_rate', round(v * 100 / n, 6) FROM c
    UNION ALL SELECT 'top_errors', error_type, n::DOUBLE FROM (SELECT * FROM sums ORDER BY n DESC, error_type LIMIT 5)""",
)
def validate_report(t):
    return tidy(V.report(checked(t)))


@query(
    "validate_recommendations",
    f"""WITH {CHECKED_SQL}, c AS (SELECT count(*) FILTER (is_valid) * 100.0 / count(*) AS rate FROM verdict),
    g AS (SELECT count(*) FILTER (value < 40) AS m, count(*) AS n FROM events),
    d AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type))
    SELECT printf('Low validation rate (%.1f%%). Review data quality and validation rules.', rate) AS recommendation FROM c WHERE rate < 90
    UNION ALL SELECT printf('High missing values in field ''%s'' (%.1f%%). Consider data imputation or source investigation.',
      'value', m * 100.0 / n) FROM g WHERE m * 100.0 / n > 20
    UNION ALL SELECT printf('Found %d duplicate records. Consider deduplication strategy.', dup::BIGINT) FROM d WHERE dup > 0""",
)
def validate_recommendations(t):
    gaps = t.events.select("event_id", F.when(F.col("value") >= 40, F.col("value")).alias("value"))
    return V.recommendations(
        checked(t), V.missing_counts(gaps), V.duplicate_count(t.events, ["user_id", "event_type"])
    )


@query(
    "validate_typed_columns",
    """SELECT o_orderkey, concat_ws('|',
      CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'Field ''o_orderstatus'' must be one of [''F'', ''O'']' END,
      CASE WHEN o_totalprice < 1000 THEN 'Field ''o_totalprice'' must be at least 1000' END,
      CASE WHEN o_totalprice > 450000 THEN 'Field ''o_totalprice'' must be at most 450000' END,
      CASE WHEN NOT regexp_matches(o_orderpriority, '^(?:[12]-)') THEN 'Field ''o_orderpriority'' does not match pattern [12]-' END,
      'Required field ''nope'' is missing') AS errors FROM orders""",
)
def validate_typed_columns(t):
    rules = [
        {"type": "enum", "field": "o_orderstatus", "value": ["F", "O"]},
        {"type": "min_value", "field": "o_totalprice", "value": 1000},
        {"type": "max_value", "field": "o_totalprice", "value": 450000},
        {"type": "regex", "field": "o_orderpriority", "value": "[12]-"},
        {"type": "required", "field": "nope"},
    ]
    return V.validate(t.orders, rules=rules).select("o_orderkey", joined())


# ---- profiles ----

GAPPY = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM {orders}"""


def gappy(t):
    o = t.orders
    return o.select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


GAPPY_SQL = f"WITH g AS ({GAPPY.format(orders='orders')})"


@query(
    "profile_missing_and_types",
    f"""{GAPPY_SQL} SELECT 'o_orderkey' AS "column", 'bigint' AS data_type, count(*) - count(o_orderkey) AS missing, count(*) AS total FROM g
    UNION ALL SELECT 'o_custkey', 'bigint', count(*) - count(o_custkey), count(*) FROM g
    UNION ALL SELECT 'price', 'double', count(*) - count(price), count(*) FROM g
    UNION ALL SELECT 'priority', 'string', count(*) - count(priority), count(*) FROM g
    UNION ALL SELECT 'status', 'string', count(*) - count(status), count(*) FROM g""",
)
def profile_missing_and_types(t):
    return tidy(V.missing_counts(gappy(t)))


@query(
    "profile_duplicates",
    """SELECT sum(n)::BIGINT AS total_records, sum(n - 1)::BIGINT AS duplicate_records
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)""",
)
def profile_duplicates(t):
    return tidy(V.duplicate_count(t.lineitem.select("l_partkey", "l_suppkey")))


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
        max({c}) AS max, round(quantile_cont({c}, 0.5), 6) AS median FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def profile_numeric(t):
    return tidy(V.numeric_profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query(
    "profile_categorical",
    GAPPY_SQL
    + ", l AS (SELECT 'priority' AS c, priority AS v FROM g UNION ALL SELECT 'status', status FROM g),"
    """ n AS (SELECT c, v, count(*) AS n FROM l GROUP BY 1, 2),
    m AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS r FROM n WHERE v IS NOT NULL)
    SELECT l.c AS "column", count(DISTINCT l.v) AS unique_values,
      round((count(*) - count(l.v)) * 100.0 / count(*), 6) AS missing_percentage, any_value(m.v) AS most_common
    FROM l JOIN m ON m.c = l.c AND m.r = 1 GROUP BY 1""",
)
def profile_categorical(t):
    return tidy(V.categorical_profile(gappy(t), ["priority", "status"]))


# ---- quality rules ----

RESULT_SQL = """rule_id, field_name, rule_type, coalesce(hits * 1.0 / nullif(total, 0), 0) <= max_allowed AS passed,
  round(1 - coalesce(hits * 1.0 / nullif(total, 0), 0), 6) AS score, hits AS issue_count,
  round(coalesce(hits * 1.0 / nullif(total, 0), 0), 6) AS issue_pct, max_allowed, severity"""


def outcome(parts: list[str], prefix: str = "WITH ") -> str:
    body = " UNION ALL ".join(parts)
    return f"{prefix} r(rule_id, field_name, rule_type, hits, total, max_allowed, severity) AS ({body}) SELECT {RESULT_SQL} FROM r"


@query(
    "quality_missing",
    outcome(
        [
            "SELECT 'm1', 'price', 'missing', (count(*) - count(price))::BIGINT, count(*), 0.1::DOUBLE, 'warning' FROM g",
            "SELECT 'm2', 'status', 'missing', (count(*) - count(status))::BIGINT, count(*), 0.1::DOUBLE, 'error' FROM g",
            "SELECT 'm3', 'nope', 'missing', count(*), count(*), 0.1::DOUBLE, 'warning' FROM g",
        ],
        GAPPY_SQL + ",",
    ),
)
def quality_missing(t):
    rules = [
        {"rule_id": "m1", "rule_type": "missing", "field_name": "price"},
        {"rule_id": "m2", "rule_type": "missing", "field_name": "status", "severity": "error"},
        {"rule_id": "m3", "rule_type": "missing", "field_name": "nope"},
        {"rule_id": "off", "rule_type": "missing", "field_name": "price", "enabled": False},
    ]
    return tidy(Q.check(gappy(t), rules))


def iqr_sql(rule: str, column: str, table: str, limit: float = 0.05, severity: str = "warning", where: str = "true") -> str:
    return f"""SELECT '{rule}', '{column}', 'outlier', count(*) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)),
      count({column}), {limit}::DOUBLE, '{severity}' FROM {table}, (SELECT quantile_cont({column}, 0.25) AS q1,
      quantile_cont({column}, 0.75) AS q3 FROM {table} WHERE {where}) WHERE {where}"""


@query(
    "quality_outlier_iqr",
    outcome([iqr_sql("o1", "value", "events"), iqr_sql("o2", "user_id", "events")]),
)
def quality_outlier_iqr(t):
    rules = [
        {"rule_id": "o1", "rule_type": "outlier", "field_name": "value"},
        {"rule_id": "o2", "rule_type": "outlier", "field_name": "user_id"},
    ]
    return tidy(Q.check(t.events, rules))


@query(
    "quality_outlier_zscore",
    outcome([
        """SELECT 'z1', 'value', 'outlier', count(*) FILTER (abs(value - a) / s > 3), count(value), 0.05::DOUBLE, 'warning'
        FROM events, (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events)"""
    ]),
)
def quality_outlier_zscore(t):
    rule = {"rule_id": "z1", "rule_type": "outlier", "field_name": "value", "parameters": {"method": "zscore"}}
    return tidy(Q.check(t.events, [rule]))


@query(
    "quality_duplicates",
    outcome([
        """SELECT 'd1', 'l_partkey', 'duplicate', sum(n - 1)::BIGINT, sum(n)::BIGINT, 0.1::DOUBLE, 'warning'
        FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)""",
        """SELECT 'd2', 'l_orderkey', 'duplicate', sum(n - 1)::BIGINT, sum(n)::BIGINT, 0.9::DOUBLE, 'warning'
        FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
    ]),
)
def quality_duplicates(t):
    rules = [
        {"rule_id": "d1", "rule_type": "duplicate", "field_name": "l_partkey", "parameters": {"fields": ["l_partkey", "l_suppkey"]}},
        {"rule_id": "d2", "rule_type": "duplicate", "field_name": "l_orderkey", "parameters": {"max_duplicate_pct": 0.9}},
    ]
    return tidy(Q.check(t.lineitem, rules))


EXPECTED = {
    "k": {"type": "integer", "required": True},
    "s": {"type": "string"},
    "b": {"type": "boolean"},
    "a": {"type": "float"},
}
VIOLATIONS_SQL = f"""{SRC}, v AS (
    SELECT event_id, key AS field, 'unexpected_field' AS issue, NULL AS expected_type, NULL AS actual_value
      FROM (SELECT event_id, unnest(json_keys(p)) AS key FROM src) WHERE key NOT IN ('k', 's', 'b', 'a')
    UNION ALL SELECT event_id, 'k', 'missing_required_field', NULL, NULL FROM src WHERE {f(J, 'k')} IS NULL
    UNION ALL SELECT event_id, 'k', 'type_mismatch', 'integer', coalesce(p->>'$.k', 'None') FROM src WHERE {f(J, 'k')} IS NOT NULL
      AND NOT ({f(J, 'k')} IN ('UBIGINT', 'BIGINT', 'BOOLEAN') OR ({f(J, 'k')} = 'VARCHAR' AND regexp_matches(p->>'$.k', '^[0-9]+$')))
    UNION ALL SELECT event_id, 's', 'type_mismatch', 'string', coalesce(p->>'$.s', 'None') FROM src
      WHERE {f(J, 's')} IS NOT NULL AND {f(J, 's')} <> 'VARCHAR'
    UNION ALL SELECT event_id, 'b', 'type_mismatch', 'boolean', coalesce(p->>'$.b', 'None') FROM src WHERE {f(J, 'b')} IS NOT NULL
      AND NOT ({f(J, 'b')} = 'BOOLEAN' OR p->>'$.b' IN ('true', 'false', 'True', 'False', '0', '1'))
    UNION ALL SELECT event_id, 'a', 'type_mismatch', 'float', coalesce(p->>'$.a', 'None') FROM src WHERE {f(J, 'a')} IS NOT NULL
      AND NOT ({f(J, 'a')} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')))"""


@query("quality_schema_violations", f"WITH {VIOLATIONS_SQL} SELECT * FROM v")
def quality_schema_violations(t):
    return Q.schema_violations(payloads(t), "p", EXPECTED).drop("p")


@query(
    "quality_schema",
    outcome(
        ["SELECT 's1', 'p', 'schema', (SELECT count(*) FROM v), count(*), 0.05::DOUBLE, 'error' FROM events"],
        f"WITH {VIOLATIONS_SQL},",
    ),
)
def quality_schema(t):
    rule = {"rule_id": "s1", "rule_type": "schema", "field_name": "p", "severity": "error"}
    return tidy(Q.check(payloads(t), [rule], schema=EXPECTED, payload="p"))


TYPE_FIELDS = ("string", "integer", "float", "boolean", "datetime", "anything")
TYPED_TEXT = """CASE event_id % 9 WHEN 0 THEN '{"x": "12"}' WHEN 1 THEN '{"x": 12}' WHEN 2 THEN '{"x": 1.5}' WHEN 3 THEN '{"x": "1.5"}'
  WHEN 4 THEN '{"x": true}' WHEN 5 THEN '{"x": "True"}' WHEN 6 THEN '{"x": "2024-01-02T03:04:05"}'
  WHEN 7 THEN '{"x": "2024/01/02"}' ELSE '{"x": null}' END"""


@query(
    "quality_type_tests",
    f"""WITH s AS (SELECT event_id, event_id % 9 AS c FROM events)
    SELECT event_id, c IN (0, 3, 5, 6, 7) AS "string", c IN (0, 1, 4) AS "integer", c IN (0, 1, 2, 3, 4) AS "float",
      c IN (4, 5) AS "boolean", c IN (6, 7) AS "datetime", true AS anything FROM s""",
)
def quality_type_tests(t):
    rows = t.events.select("event_id", F.try_parse_json(F.expr(TYPED_TEXT)).alias("v"))
    x = V.JsonField("v", ["x"])
    return rows.select("event_id", *[Q.type_matches(x, kind).alias(kind) for kind in TYPE_FIELDS])


@query(
    "quality_range",
    outcome([
        """SELECT 'r1', 'l_quantity', 'range', count(*) FILTER (l_quantity < 5 OR l_quantity > 48), count(l_quantity), 0.05::DOUBLE, 'warning' FROM lineitem""",
        """SELECT 'r2', 'l_discount', 'range', count(*) FILTER (l_discount > 0.09), count(l_discount), 0.2::DOUBLE, 'warning' FROM lineitem""",
    ]),
)
def quality_range(t):
    rules = [
        {"rule_id": "r1", "rule_type": "range", "field_name": "l_quantity", "parameters": {"min_value": 5, "max_value": 48}},
        {"rule_id": "r2", "rule_type": "range", "field_name": "l_discount", "parameters": {"max_value": 0.09, "max_out_of_range_pct": 0.2}},
    ]
    return tidy(Q.check(t.lineitem, rules))


URL_SQL = r"'^https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?$'"
EMAIL_SQL = r"'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'"


@query(
    "quality_format",
    outcome([
        f"SELECT 'f1', 'url', 'format', count(*) FILTER (NOT regexp_matches(url, {URL_SQL})), count(url), 0.05::DOUBLE, 'warning' FROM pages",
        f"SELECT 'f2', 'url', 'format', count(*) FILTER (NOT regexp_matches(url, {EMAIL_SQL})), count(url), 0.05::DOUBLE, 'warning' FROM pages",
        "SELECT 'f3', 'url', 'format', count(*) FILTER (NOT regexp_matches(url, '^(?:https)')), count(url), 0.6::DOUBLE, 'warning' FROM pages",
    ]),
)
def quality_format(t):
    rules = [
        {"rule_id": "f1", "rule_type": "format", "field_name": "url", "parameters": {"format_type": "url"}},
        {"rule_id": "f2", "rule_type": "format", "field_name": "url", "parameters": {"format_type": "email"}},
        {"rule_id": "f3", "rule_type": "format", "field_name": "url", "parameters": {"pattern": "https", "max_violation_pct": 0.6}},
    ]
    return tidy(Q.check(t.pages, rules))


@query(
    "quality_default_rules",
    outcome(
        [
            f"SELECT 'missing_values:{c}', '{c}', 'missing', (count(*) - count({c}))::BIGINT, count(*), 0.1::DOUBLE, 'warning' FROM customer"
            for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        ]
        + [iqr_sql(f"outliers:{c}", c, "customer") for c in ("c_custkey", "c_nationkey", "c_acctbal")]
        + [
            "SELECT 'duplicates', '*', 'duplicate', sum(n - 1)::BIGINT, sum(n)::BIGINT, 0.01::DOUBLE, 'error' FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)",
            "SELECT 'schema', '*', 'schema', count(*), count(*), 0.05::DOUBLE, 'error' FROM customer",
        ]
    ),
)
def quality_default_rules(t):
    schema = {
        "c_custkey": {"type": "integer", "required": True},
        "c_name": {"type": "string", "required": True},
        "c_nationkey": {"type": "integer"},
        "c_acctbal": {"type": "float"},
    }
    return tidy(Q.check(t.customer, Q.default_rules("c_custkey"), schema=schema))


@query(
    "quality_summary",
    """WITH h AS (SELECT event_type, date_trunc('day', ts) AS ts, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS pct
      FROM events GROUP BY 1, 2),
    r AS (SELECT event_type AS rule_id, ts, 1 - pct AS score, pct <= 0.12 AS passed FROM h)
    SELECT rule_id, count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks,
      count(*) FILTER (NOT passed) AS failed_checks, round(avg(score), 6) AS avg_score,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_check, round(count(*) FILTER (passed) * 1.0 / count(*), 6) AS overall_score
    FROM r GROUP BY GROUPING SETS ((rule_id), ())""",
)
def quality_summary(t):
    daily = t.events.groupBy(
        F.col("event_type").alias("rule_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(F.avg(F.when(F.col("value") > 100, 1.0).otherwise(0.0)).alias("pct"))
    results = daily.select("rule_id", "ts", (1 - F.col("pct")).alias("score"), (F.col("pct") <= 0.12).alias("passed"))
    return tidy(Q.summary(results))

