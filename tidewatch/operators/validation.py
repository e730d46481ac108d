"""Record validation: JSON-schema checks, field rules, anomaly limits, batch profiles.

All checks of a record become one array expression, evaluated in one
projection; failing records can be written to a quarantine table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.common import number, numeric_columns, quoted, string_columns, truth, union_all
from tidewatch.operators.aggregates import aggregate

# Message texts, which results are compared by.
MESSAGES = {
    "schema": "Schema validation failed: ",
    "required": "Required field '{f}' is missing",
    "not_null": "Field '{f}' cannot be null",
    "min_length": "Field '{f}' must be at least {v} characters",
    "max_length": "Field '{f}' must be at most {v} characters",
    "min_value": "Field '{f}' must be at least {v}",
    "max_value": "Field '{f}' must be at most {v}",
    "regex": "Field '{f}' does not match pattern {v}",
    "enum": "Field '{f}' must be one of {v}",
    "number": "Field '{f}' must be a number",
    "string": "Field '{f}' must be a string",
    "boolean": "Field '{f}' must be a boolean",
    "array": "Field '{f}' must be an array",
    "object": "Field '{f}' must be an object",
    "z_score": "Anomaly detected in field '{f}': z-score ",
    "below": "Anomaly detected in field '{f}': value ",
    "pattern": "Anomaly detected in field '{f}': value does not match expected pattern",
}


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def starts_with_match(text: Column, pattern: str) -> Column:
    """Regular expression anchored at the start only."""
    return text.rlike("^(?:" + pattern + ")")


class JsonField:
    """One field of a VARIANT column: a present null differs from an absent key.

    ``ready`` gives columns already extracted by :func:`extract_fields`.
    """

    def __init__(self, variant: str, path: Sequence[str], ready: Mapping[tuple, Sequence[str]] | None = None):
        columns = (ready or {}).get(tuple(path))
        if columns:
            self.get, self.kind, self.text, double = (F.col(c) for c in columns)
        else:
            self.get, self.kind, self.text, double = _json_parts(f"try_variant_get(`{variant}`, {_json_path(path)}, 'variant')")
        self.exists = self.get.isNotNull()
        self.is_null = truth(self.kind == "VOID")
        self.is_bool = self.kind == "BOOLEAN"
        self.is_integer = (self.kind == "BIGINT") | self.kind.rlike(r"^DECIMAL\(\d+,0\)$")
        self.is_number = self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL")
        self.is_string = self.kind == "STRING"
        self.is_array = self.kind.startswith("ARRAY")
        self.is_object = self.kind.startswith("OBJECT")
        self.value = F.when(self.is_number, double).when(self.is_bool, F.when(self.text == "true", 1.0).otherwise(0.0))

    def missing(self) -> Column:
        return ~self.exists

    def has_value(self) -> Column:
        return self.exists & ~self.is_null


def _json_path(path: Sequence[str]) -> str:
    return sql_text("$" + "".join('["' + p.replace('"', '\\"') + '"]' for p in path))


def _json_parts(get: str) -> tuple[Column, Column, Column, Column]:
    """The field itself, its type name, its text, its number."""
    return (
        F.expr(get), F.expr(f"schema_of_variant({get})"), F.expr(f"try_variant_get({get}, '$', 'string')"),
        F.expr(f"try_variant_get({get}, '$', 'double')"),
    )


def extract_fields(df: DataFrame, variant: str, paths: Sequence[Sequence[str]]) -> tuple[DataFrame, dict[tuple, list[str]]]:
    """Pull every field out of the VARIANT column once; the checks then read plain columns."""
    wanted = list(dict.fromkeys(tuple(p) for p in paths))
    pulled = df.select("*", *[
        F.expr(f"try_variant_get(`{variant}`, {_json_path(p)}, 'variant')").alias(f"__g{i}") for i, p in enumerate(wanted)
    ])
    parts, ready = [], {}
    for i, p in enumerate(wanted):
        _, kind, text, double = _json_parts(f"__g{i}")
        parts += [kind.alias(f"__k{i}"), text.alias(f"__t{i}"), double.alias(f"__d{i}")]
        ready[p] = [f"__{x}{i}" for x in "gktd"]
    return pulled.select("*", *parts), ready


def schema_paths(schema: Mapping, path: Sequence[str] = ()) -> list[tuple]:
    """Paths of all fields a JSON schema looks at."""
    out = [tuple(path)] + [(*path, n) for n in schema.get("required", ())]
    for name, sub in schema.get("properties", {}).items():
        out += schema_paths(sub, (*path, name))
    return out


class TypedField:
    """One column of a typed frame: an absent key and null are both NULL."""

    def __init__(self, df: DataFrame, name: str):
        known = name in df.columns
        c = quoted(name) if known else F.lit(None).cast("string")
        kind = df.schema[name].dataType if known else T.NullType()
        self.exists = c.isNotNull()
        self.is_null = c.isNull()
        self.text = c.cast("string") if not isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(c)
        self.is_bool = F.lit(isinstance(kind, T.BooleanType))
        self.is_number = F.lit(isinstance(kind, T.NumericType))
        self.is_integer = F.lit(isinstance(kind, T.IntegralType))
        self.is_string = F.lit(isinstance(kind, T.StringType))
        self.is_array = F.lit(isinstance(kind, T.ArrayType))
        self.is_object = F.lit(isinstance(kind, (T.StructType, T.MapType)))
        numeric = isinstance(kind, (T.NumericType, T.BooleanType))
        self.value = c.cast("double") if numeric else F.lit(None).cast("double")

    def missing(self) -> Column:
        return ~self.exists

    def has_value(self) -> Column:
        return self.exists


def _python_list(values: Sequence) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def _in_list(field, values: Sequence) -> Column:
    texts = [v for v in values if isinstance(v, str)]
    numbers = [float(v) for v in values if isinstance(v, (int, float))]
    hit = F.lit(False)
    if texts:
        hit = hit | (field.is_string & field.text.isin(*texts))
    if numbers:
        hit = hit | field.value.isin(*numbers)
    if any(v is None for v in values):
        hit = hit | ~field.has_value()
    return truth(hit)


def rule_error(field, rule: Mapping) -> Column:
    """Error text of one rule, NULL when the record passes."""
    kind, name, v = rule["type"], rule["field"], rule.get("value")
    message = MESSAGES.get(kind, "").format(f=name, v=_python_list(v) if kind == "enum" else v)
    truthy = field.has_value() & (field.text != "") & ~truth(field.value == 0)
    if kind == "required":
        failed = field.missing()
    elif kind == "not_null":
        failed = field.is_null
    elif kind == "min_length":
        failed = truthy & (F.length(field.text) < F.lit(v))
    elif kind == "max_length":
        failed = truthy & (F.length(field.text) > F.lit(v))
    elif kind == "min_value":
        failed = field.value < F.lit(v)
    elif kind == "max_value":
        failed = field.value > F.lit(v)
    elif kind == "regex":
        failed = truthy & ~starts_with_match(field.text, v)
    elif kind == "enum":
        failed = ~_in_list(field, v)
    elif kind == "data_type":
        allowed = {
            "number": field.is_number | field.is_bool,
            "string": field.is_string,
            "boolean": field.is_bool,
            "array": field.is_array,
            "object": field.is_object,
        }
        if v not in allowed:
            return F.lit(None).cast("string")
        message = MESSAGES[v].format(f=name)
        failed = field.has_value() & ~truth(allowed[v])
    else:
        return F.lit(None).cast("string")
    return F.when(truth(failed), F.lit(message))


def anomaly_errors(field, name: str, limits: Mapping) -> list[Column]:
    """Error texts of z-score, range and pattern limits on one field."""
    out: list[Column] = []
    if "z_score_threshold" in limits:
        mean, std = float(limits.get("mean", 0)), float(limits.get("std", 1))
        z = (field.value - mean) / std if std != 0 else F.lit(0.0)
        text = F.concat(F.lit(MESSAGES["z_score"].format(f=name)), F.format_string("%.2f", z))
        out.append(F.when(truth(F.abs(z) > float(limits["z_score_threshold"])) & field.value.isNotNull(), text))
    for key, word, worse in (("min_value", "below minimum", "<"), ("max_value", "above maximum", ">")):
        if key in limits:
            bound = limits[key]
            failed = field.value < F.lit(bound) if worse == "<" else field.value > F.lit(bound)
            text = F.concat(F.lit(MESSAGES["below"].format(f=name)), field.text, F.lit(f" {word} {bound}"))
            out.append(F.when(truth(failed), text))
    if "pattern" in limits:
        failed = field.has_value() & ~starts_with_match(field.text, limits["pattern"])
        out.append(F.when(truth(failed), F.lit(MESSAGES["pattern"].format(f=name))))
    return out


def schema_error(
    variant: str, schema: Mapping, path: Sequence[str] = (), ready: Mapping[tuple, Sequence[str]] | None = None
) -> Column:
    """At most one JSON-schema error per record: missing keys first, then properties in order.

    Supported: type, properties, required, minimum, maximum, minLength,
    maxLength, enum, pattern.
    """
    shown_errors: list[Column] = []
    nested: list[Column] = []
    own = JsonField(variant, path, ready)
    shown = F.when(own.is_string, F.concat(F.lit("'"), own.text, F.lit("'"))).when(own.is_null, "None").otherwise(
        own.text
    )
    for word, value in schema.items():
        if word == "type":
            kinds = {
                "object": own.is_object,
                "array": own.is_array,
                "string": own.is_string,
                "boolean": own.is_bool,
                "number": own.is_number,
                "integer": own.is_integer | (own.is_number & (own.value == F.floor(own.value))),
                "null": own.is_null,
            }
            if value in kinds:
                bad = own.exists & ~truth(kinds[value])
                shown_errors.append(F.when(bad, F.concat(shown, F.lit(f" is not of type '{value}'"))))
        elif word == "required":
            for name in value:
                gap = own.is_object & JsonField(variant, [*path, name], ready).missing()
                shown_errors.append(F.when(truth(gap), F.lit(f"'{name}' is a required property")))
        elif word == "properties":
            nested = [schema_error(variant, sub, [*path, name], ready) for name, sub in value.items()]
        elif word in ("minimum", "maximum"):
            bad = own.is_number & (own.value < float(value) if word == "minimum" else own.value > float(value))
            text = f" is less than the minimum of {value}" if word == "minimum" else (
                f" is greater than the maximum of {value}"
            )
            shown_errors.append(F.when(truth(bad), F.concat(shown, F.lit(text))))
        elif word in ("minLength", "maxLength"):
            size = F.length(own.text)
            bad = own.is_string & (size < value if word == "minLength" else size > value)
            text = " is too short" if word == "minLength" else " is too long"
            shown_errors.append(F.when(truth(bad), F.concat(shown, F.lit(text))))
        elif word == "enum":
            bad = own.exists & ~_in_list(own, value)
            shown_errors.append(F.when(truth(bad), F.concat(shown, F.lit(f" is not one of {_python_list(value)}"))))
        elif word == "pattern":
            bad = own.is_string & ~own.text.rlike(value)
            shown_errors.append(F.when(truth(bad), F.concat(shown, F.lit(f" does not match {value!r}"))))
    return F.coalesce(*shown_errors, *nested, F.lit(None).cast("string"))


def validate(
    df: DataFrame,
    schema: Mapping | None = None,
    rules: Sequence[Mapping] = (),
    limits: Mapping[str, Mapping] | None = None,
    payload: str | None = None,
) -> DataFrame:
    """Add ``errors ARRAY<STRING>`` and ``is_valid``: schema error, rule errors, anomaly errors in this order.

    With ``payload`` the record is a raw JSON text column, else the typed
    columns are checked (a schema needs ``payload``).
    """
    if schema is not None and payload is None:
        raise ValueError("a JSON schema needs the raw payload column")
    ready: dict[tuple, list[str]] = {}
    work = df
    if payload:
        paths = (schema_paths(schema) if schema is not None else []) + [(r["field"],) for r in rules]
        paths += [(name,) for name in limits or {}]
        work, ready = extract_fields(df.withColumn("__v", F.try_parse_json(quoted(payload))), "__v", paths)
    known: dict[str, object] = {}

    def field(name: str):
        if name not in known:
            known[name] = JsonField("__v", [name], ready) if payload else TypedField(df, name)
        return known[name]

    checks: list[Column] = []
    if schema is not None:
        unreadable = F.when(F.col("__v").isNull(), F.lit("record is not JSON"))
        checks.append(F.concat(F.lit(MESSAGES["schema"]), F.coalesce(unreadable, schema_error("__v", schema, (), ready))))
    checks += [rule_error(field(r["field"]), r) for r in rules]
    for name, limit in (limits or {}).items():
        checks += anomaly_errors(field(name), name, limit)
    errors = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    checked = work.select(*[quoted(c) for c in df.columns], errors.alias("errors"))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def totals(checked: DataFrame) -> DataFrame:
    """Counts of one batch: total, valid, invalid, rate in percent."""
    return checked.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_valid").alias("valid_records"),
        F.count_if(~F.col("is_valid")).alias("invalid_records"),
    ).withColumn(
        "validation_rate",
        F.coalesce(F.try_divide(F.col("valid_records") * F.lit(100.0), F.col("total_records")), F.lit(0.0)),
    )


def invalid_records(checked: DataFrame, record_id: str) -> DataFrame:
    """Failing records with their errors: the quarantine table."""
    return checked.filter(~F.col("is_valid")).select(quoted(record_id).alias("record_id"), "errors")


def error_summary(checked: DataFrame) -> DataFrame:
    """Errors by kind: the text before the first ``:``, else ``Unknown``."""
    e = F.col("error")
    kind = F.when(F.contains(e, F.lit(":")), F.substring_index(e, ":", 1)).otherwise("Unknown")
    return (
        checked.select(F.explode("errors").alias("error"))
        .groupBy(kind.alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def report(checked: DataFrame, top: int = 5) -> DataFrame:
    """Validation report as ``(section, name, value)``: counts, rate, most frequent error kinds."""
    counts = totals(checked)
    rows = F.array(*[
        F.struct(F.lit("summary").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for c in counts.columns
    ])
    worst = error_summary(checked).orderBy(F.desc("n"), "error_type").limit(top)
    return union_all([
        counts.select(F.inline(rows)),
        worst.select(
            F.lit("top_errors").alias("section"), F.col("error_type").alias("name"), F.col("n").cast("double").alias("value")
        ),
    ])


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values (NULL or NaN) per column with the column type: one pass."""
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def missing(c: str) -> Column:
        empty = quoted(c).isNull()
        return empty | F.isnan(quoted(c)) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else empty

    wide = df.agg(
        F.count(F.lit(1)).alias("__total"), *[F.count_if(missing(c)).alias(f"m{i}") for i, c in enumerate(columns)]
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kinds[c].simpleString()).alias("data_type"),
            F.col(f"m{i}").alias("missing"),
            F.col("__total").alias("total"),
        )
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(rows))


def duplicate_count(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each distinct record."""
    groups = df.groupBy(*[quoted(c) for c in (fields or df.columns)]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_records"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, sample std, min, max, median per numeric column."""
    columns = list(columns or numeric_columns(df))
    kinds = ("mean", "std", "min", "max", "median")
    typed = df.select(*[number(quoted(c)).alias(c) for c in columns])
    wide = aggregate(typed, [{"type": k, "column": c, "output_key": f"{c}.{k}"} for c in columns for k in kinds])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[quoted(f"{c}.{k}").alias(k) for k in kinds]) for c in columns
    ])
    return wide.select(F.inline(rows))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, most common value (smallest on a tie) and missing percent per text column."""
    columns = list(columns or string_columns(df))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])
    counted = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy("column").agg(
        F.count("value").alias("unique_values"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("__top"),
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) * 100.0 / F.sum("n")).alias(
            "missing_percentage"
        ),
    )
    top = (
        counted.filter(F.col("value").isNotNull())
        .join(sums.select(F.col("column").alias("__c"), "__top"), (F.col("column") == F.col("__c")) & (F.col("n") == F.col("__top")))
        .groupBy("column")
        .agg(F.min("value").alias("most_common"))
    )
    return sums.drop("__top").join(top, "column", "left")


def recommendations(checked: DataFrame, missing: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Advice rows: low validation rate, columns over 20 % missing, duplicates."""
    rate = F.col("validation_rate")
    low = totals(checked).filter(rate < 90).select(
        F.format_string("Low validation rate (%.1f%%). Review data quality and validation rules.", rate).alias(
            "recommendation"
        )
    )
    pct = F.col("missing") * 100.0 / F.col("total")
    gaps = missing.filter(F.col("total") > 0).filter(pct > 20).select(
        F.format_string(
            "High missing values in field '%s' (%.1f%%). Consider data imputation or source investigation.",
            "column",
            pct,
        ).alias("recommendation")
    )
    copies = duplicates.filter("duplicate_records > 0").select(
        F.format_string(
            "Found %d duplicate records. Consider deduplication strategy.", "duplicate_records"
        ).alias("recommendation")
    )
    return union_all([low, gaps, copies])
