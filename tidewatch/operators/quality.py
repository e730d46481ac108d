"""Data-quality rules.

All enabled rules of a dataset become one aggregate; what a rule needs first
(quartiles, moments) comes in as one statistics row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import attach, merge_by_keys, number, numeric_columns, quoted, truth, union_all
from tidewatch.functions.ordered import exact_quantiles
from tidewatch.operators.validation import JsonField, duplicate_count, extract_fields, starts_with_match

# Patterns of the built-in formats.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_PATTERN = (
    r"^https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?$"
)

# Name of the limit parameter and its default, per rule type.
LIMITS = {
    "missing": ("max_missing_pct", 0.1),
    "outlier": ("max_outlier_pct", 0.05),
    "duplicate": ("max_duplicate_pct", 0.1),
    "schema": ("max_violation_pct", 0.05),
    "range": ("max_out_of_range_pct", 0.05),
    "format": ("max_violation_pct", 0.05),
}

# Layouts a text may have to count as a date, besides ISO 8601.
DATE_LAYOUTS = (
    "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd",
    "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss",
)


def default_rules(unique_id: str = "id") -> list[dict]:
    """Rule pack a dataset starts with: ``*`` stands for every column."""
    return [
        {"rule_id": "missing_values", "rule_type": "missing", "field_name": "*", "parameters": {"max_missing_pct": 0.1}, "severity": "warning"},
        {"rule_id": "outliers", "rule_type": "outlier", "field_name": "*", "parameters": {"method": "iqr", "max_outlier_pct": 0.05}, "severity": "warning"},
        {"rule_id": "duplicates", "rule_type": "duplicate", "field_name": "*", "parameters": {"fields": [unique_id], "max_duplicate_pct": 0.01}, "severity": "error"},
        {"rule_id": "schema", "rule_type": "schema", "field_name": "*", "parameters": {"max_violation_pct": 0.05}, "severity": "error"},
    ]


def parsed_time(text: Column) -> Column:
    """Timestamp of a text in ISO 8601 or one of the known layouts, else NULL."""
    return F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_LAYOUTS])


def type_matches(field: JsonField, expected: str) -> Column:
    """Loose type test on a JSON field; an unknown type name always matches."""
    text = field.text
    if expected == "string":
        ok = field.is_string
    elif expected == "integer":
        ok = field.is_integer | field.is_bool | (field.is_string & text.rlike(r"^[0-9]+$"))
    elif expected == "float":
        ok = field.is_number | field.is_bool | (field.is_string & text.try_cast("double").isNotNull())
    elif expected == "boolean":
        ok = (
            field.is_bool
            | (field.is_string & text.isin("true", "false", "True", "False"))
            | (field.is_number & field.value.isin(0.0, 1.0))
        )
    elif expected == "datetime":
        ok = field.is_string & parsed_time(text).isNotNull()
    else:
        return F.lit(True)
    return truth(ok)


def schema_violations(df: DataFrame, payload: str, schema: Mapping[str, Mapping]) -> DataFrame:
    """One row per violation: ``(input columns, field, issue, expected_type, actual_value)``."""
    whole = df.withColumn("__v", F.try_parse_json(quoted(payload)))
    parsed, ready = extract_fields(whole, "__v", [[name] for name in schema])
    none = F.lit(None).cast("string")

    def item(field: Column, issue: str, expected: Column = none, actual: Column = none) -> Column:
        return F.struct(
            field.cast("string").alias("field"), F.lit(issue).alias("issue"),
            expected.cast("string").alias("expected_type"), actual.cast("string").alias("actual_value"),
        )

    known = F.array(*[F.lit(k) for k in schema])
    keys = F.coalesce(F.json_object_keys(quoted(payload)), F.array().cast("array<string>"))
    unexpected = F.transform(F.array_except(keys, known), lambda k: item(k, "unexpected_field"))
    checks: list[Column] = []
    for name, spec in schema.items():
        f = JsonField("__v", [name], ready)
        if spec.get("required", False):
            checks.append(F.when(f.missing(), item(F.lit(name), "missing_required_field")))
        if "type" in spec:
            wrong = f.exists & ~type_matches(f, spec["type"])
            shown = F.when(f.is_null, F.lit("None")).otherwise(f.text)
            checks.append(F.when(wrong, item(F.lit(name), "type_mismatch", F.lit(spec["type"]), shown)))
    found = F.concat(unexpected, F.array_compact(F.array(*checks))) if checks else unexpected
    return parsed.select(*[quoted(c) for c in df.columns], F.inline(found))


def expand_rules(df: DataFrame, rules: Sequence[Mapping]) -> list[dict]:
    """Enabled rules, with ``*`` replaced by every column (numeric ones for outliers)."""
    out = []
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        if rule["field_name"] != "*" or rule["rule_type"] in ("duplicate", "schema"):
            out.append(dict(rule))
            continue
        columns = numeric_columns(df) if rule["rule_type"] == "outlier" else df.columns
        out += [{**rule, "rule_id": f"{rule['rule_id']}:{c}", "field_name": c} for c in columns]
    return out


def outlier_bounds(df: DataFrame, fields: Sequence[str], zscore: Sequence[str] = ()) -> DataFrame:
    """One row: ``<field>.q1/.q3`` for IQR fields, ``<field>.mean/.std`` for z-score fields."""
    parts = []
    if fields:
        wanted = {f"{c}.q1": (c, 0.25) for c in fields} | {f"{c}.q3": (c, 0.75) for c in fields}
        parts.append(exact_quantiles(df, [], wanted))
    if zscore:
        parts.append(df.agg(*[
            e for c in zscore
            for e in (F.avg(number(quoted(c))).alias(f"{c}.mean"), F.stddev_pop(number(quoted(c))).alias(f"{c}.std"))
        ]))
    return merge_by_keys(parts, [])


def outside_iqr(x: Column, q1: Column, q3: Column) -> Column:
    iqr = q3 - q1
    return (x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)


def _row(rule: Mapping, hits: Column, total: Column) -> Column:
    name, default = LIMITS[rule["rule_type"]]
    params = rule.get("parameters", {})
    return F.struct(
        F.lit(rule["rule_id"]).alias("rule_id"), F.lit(rule["field_name"]).alias("field_name"),
        F.lit(rule["rule_type"]).alias("rule_type"), hits.cast("bigint").alias("hits"),
        total.cast("bigint").alias("total"), F.lit(float(params.get(name, default))).alias("max_allowed"),
        F.lit(rule.get("severity", "warning")).alias("severity"),
    )


def check(
    df: DataFrame, rules: Sequence[Mapping], schema: Mapping[str, Mapping] | None = None, payload: str | None = None
) -> DataFrame:
    """Run all rules: ``(rule_id, field_name, rule_type, passed, score, issue_count, issue_pct, max_allowed, severity)``.

    ``payload`` names a raw JSON column for schema rules; without it the typed
    row is written as JSON first.
    """
    rules = expand_rules(df, rules)
    iqr = sorted({r["field_name"] for r in rules if r["rule_type"] == "outlier" and r.get("parameters", {}).get("method", "iqr") == "iqr"})
    zs = sorted({r["field_name"] for r in rules if r["rule_type"] == "outlier" and r.get("parameters", {}).get("method") == "zscore"})
    work = attach(df, outlier_bounds(df, iqr, zs), []) if iqr or zs else df
    slots: list[Column] = []
    aggs: list[Column] = []
    parts: list[DataFrame] = []

    def count_into(rule: Mapping, hit: Column, base: Column) -> None:
        i = len(slots)
        aggs.append(F.count_if(truth(hit)).alias(f"h{i}"))
        aggs.append(F.count_if(truth(base)).alias(f"t{i}"))
        slots.append(_row(rule, F.col(f"h{i}"), F.col(f"t{i}")))

    for rule in rules:
        kind, name, params = rule["rule_type"], rule["field_name"], rule.get("parameters", {})
        if kind == "duplicate":
            dup = duplicate_count(df, params.get("fields", [name]))
            parts.append(dup.select(F.inline(F.array(_row(rule, F.col("duplicate_records"), F.col("total_records"))))))
            continue
        if kind == "schema":
            if schema is None:
                count_into(rule, F.lit(False), F.lit(True))
                continue
            raw = df if payload else df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("__raw"))
            counted = union_all([
                schema_violations(raw.select(quoted(payload or "__raw")), payload or "__raw", schema).agg(
                    F.count(F.lit(1)).alias("hits")),
                df.agg(F.count(F.lit(1)).alias("total")),
            ]).agg(F.max("hits").alias("hits"), F.max("total").alias("total"))
            parts.append(counted.select(F.inline(F.array(_row(rule, F.col("hits"), F.col("total"))))))
            continue
        if kind == "outlier" and params.get("method") == "isolation_forest":
            from tidewatch.operators.iforest import outlier_flags

            flagged = outlier_flags(df, name, rule.get("key_columns") or params.get("key_columns") or ())
            counted = flagged.agg(F.count_if("is_outlier").alias("hits"), F.count(F.lit(1)).alias("total"))
            parts.append(counted.select(F.inline(F.array(_row(rule, F.col("hits"), F.col("total"))))))
            continue
        c = quoted(name) if name in df.columns else F.lit(None).cast("string")
        x = number(c)
        if kind == "missing":
            nan = F.isnan(c) if dict(df.dtypes).get(name) in ("double", "float") else F.lit(False)
            count_into(rule, c.isNull() | nan, F.lit(True))
        elif kind == "outlier" and params.get("method", "iqr") == "iqr":
            count_into(rule, outside_iqr(x, quoted(f"{name}.q1"), quoted(f"{name}.q3")), x.isNotNull())
        elif kind == "outlier" and params.get("method") == "zscore":
            z = F.abs(x - quoted(f"{name}.mean")) / F.nullif(quoted(f"{name}.std"), F.lit(0.0))
            count_into(rule, z > 3, x.isNotNull())
        elif kind == "range":
            low, high = params.get("min_value"), params.get("max_value")
            bad = (x < F.lit(low) if low is not None else F.lit(False)) | (
                x > F.lit(high) if high is not None else F.lit(False)
            )
            count_into(rule, bad, x.isNotNull())
        elif kind == "format":
            form = params.get("format_type", "regex")
            pattern = {"email": EMAIL_PATTERN, "url": URL_PATTERN}.get(form, params.get("pattern"))
            if not pattern:
                count_into(rule, F.lit(False), F.lit(True))
            else:
                count_into(rule, ~starts_with_match(c.cast("string"), pattern), c.isNotNull())
    if slots:
        parts.insert(0, work.agg(*aggs).select(F.inline(F.array(*slots))))
    few = (F.col("rule_type") == "outlier") & (F.col("total") < 10)
    pct = F.when(few, 0.0).otherwise(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("total")), F.lit(0.0)))
    return union_all(parts).select(
        "rule_id", "field_name", "rule_type",
        (pct <= F.col("max_allowed")).alias("passed"),
        (1 - pct).alias("score"),
        F.when(few, F.lit(0)).otherwise(F.col("hits")).cast("bigint").alias("issue_count"),
        pct.alias("issue_pct"), "max_allowed", "severity",
    )


def summary(results: DataFrame, rules: Sequence[str] = ("rule_id",), ts: str = "ts") -> DataFrame:
    """Per rule: checks, passed, failed, mean score, last check; and the overall row (``rule_id`` NULL)."""
    return (
        results.groupingSets([[quoted(r) for r in rules], []], *[quoted(r) for r in rules])
        .agg(
            F.count(F.lit(1)).alias("total_checks"),
            F.count_if("passed").alias("passed_checks"),
            F.count_if(~F.col("passed")).alias("failed_checks"),
            F.avg("score").alias("avg_score"),
            F.max(quoted(ts)).alias("last_check"),
        )
        .withColumn("overall_score", F.col("passed_checks") / F.col("total_checks"))
    )
