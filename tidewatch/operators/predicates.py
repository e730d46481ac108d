"""Row filters, threshold tests and field projections built from configuration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import col_of, quoted, truth

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def condition(field: str | Column, operator: str, value, strict: bool = True) -> Column:
    """One filter condition; a record without the field never passes.

    With ``strict=False`` an unknown operator keeps every record that has the field.
    """
    c = col_of(field)
    text = c.cast("string")
    tests: dict[str, Callable[[], Column]] = {
        "equals": lambda: c == F.lit(value),
        "not_equals": lambda: c != F.lit(value),
        "greater_than": lambda: c > F.lit(value),
        "less_than": lambda: c < F.lit(value),
        "contains": lambda: text.contains(str(value)),
        "regex": lambda: text.rlike(str(value)),
    }
    if operator in tests:
        return tests[operator]()
    if strict:
        raise ValueError(f"unknown filter operator {operator}")
    return c.isNotNull()


def raw_condition(payload: str, field: str, operator: str, value, strict: bool = True) -> Column:
    """The same test on a field of a raw JSON text column, where an explicit null differs from absence.

    ``not_equals`` keeps a record whose field is present and null.
    """
    present = truth(F.array_contains(F.json_object_keys(quoted(payload)), field))
    got = F.get_json_object(quoted(payload), f"$['{field}']")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and operator not in ("contains", "regex"):
        got = got.try_cast("double")
    test = condition(got, operator, value, strict)
    if operator == "not_equals":
        test = test | got.isNull()
    return present & truth(test)


def apply_filters(df: DataFrame, filters: Sequence[Mapping], strict: bool = True) -> DataFrame:
    """All conditions ANDed, in order."""
    return reduce(
        lambda d, f: d.filter(condition(quoted(f["field"]), f["operator"], f["value"], strict)), filters, df
    )


def compare(operator: str, value: Column, threshold: Column) -> Column:
    """Threshold test with a fixed operator; an unknown operator is false."""
    fn = COMPARE.get(operator)
    return truth(fn(value, threshold)) if fn else F.lit(False)


def compare_by(operator: Column, value: Column, threshold: Column) -> Column:
    """Threshold test whose operator is a column (a rules table)."""
    out = F.lit(False)
    for sign, fn in COMPARE.items():
        out = F.when(operator == sign, truth(fn(value, threshold))).otherwise(out)
    return out


def map_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep only the mapped fields, under their new names; unknown sources are skipped."""
    return df.select(*[quoted(a).alias(b) for a, b in mapping.items() if a in df.columns])


def rename_fields(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename one after the other, keep the rest; a rename onto an existing field replaces it."""
    current: dict[str, Column] = {c: quoted(c) for c in df.columns}
    for old, new in renames.items():
        if old in current:
            moved = current.pop(old)
            current[new] = moved
    return df.select(*[c.alias(name) for name, c in current.items()])


def remove_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.drop(*fields)


def custom(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Hook for a caller's own DataFrame function; identity when none is given."""
    return df.transform(fn) if fn else df


def first_present(fields: Sequence[str], payload: str | None = None) -> Column:
    """First field that is there.

    On typed columns this is the first non-null one.  With ``payload`` (raw
    JSON text) a present key wins even if its value is null.
    """
    if payload is None:
        return F.coalesce(*[quoted(f) for f in fields])
    keys = F.json_object_keys(quoted(payload))
    out = F.lit(None).cast("string")
    for f in reversed(fields):
        out = F.when(truth(F.array_contains(keys, f)), F.get_json_object(quoted(payload), f"$['{f}']")).otherwise(out)
    return out


TRANSFORMS: dict[str, Callable[[DataFrame, Mapping], DataFrame]] = {
    "field_mapping": lambda df, s: map_fields(df, s["mapping"]),
    "field_renaming": lambda df, s: rename_fields(df, s["renames"]),
    "field_removal": lambda df, s: remove_fields(df, s["fields"]),
    "custom_function": lambda df, s: custom(df, s.get("function")),
}


def apply_processing(df: DataFrame, config: Mapping, strict: bool = True) -> DataFrame:
    """Filters, then transformations, in the configured order (batch or stream)."""
    out = apply_filters(df, config.get("filters", ()), strict)
    for step in config.get("transformations", ()):
        if step["type"] in TRANSFORMS:
            out = TRANSFORMS[step["type"]](out, step)
    return out
