"""Order-dependent work without a single-task sort.

Ranks, exact percentiles and row-frame windows need a total order.  A window
without a partition key, or with a hot one, would put that order into one task.
The helpers here cut the order into slices that are a pure function of the data
(so a recomputed task gives the same slices), keep a running total over the
bounded list of slices, and do the fine work inside each slice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import NUMERIC, attach, join_on, merge_by_keys, micros, number, quoted, union_all

# Slices per key: few enough for one running total, many enough that a slice of
# a key with 10^11 distinct values is still an easy sort.
SLICES = 1 << 16
SUB_SLICES = 1 << 10
HOT_ROWS = 1 << 22
BLOCK_ROWS = 1 << 16
# Default of spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT = 1000


def _slice_of(value: str) -> Column:
    """Slice number of ``value`` within ``[__lo, __hi]``, never decreasing in it.

    Equal-width slices first; inside one, slices of equal ratio of the
    magnitude.  The first handles offsets, the second long tails.
    """
    v = f"`{value}`"
    return F.expr(
        f"CAST(CASE WHEN __hi > __lo THEN floor(({v} - __lo) / (__hi - __lo) * {SLICES}D) ELSE 0 END AS BIGINT)"
        f" * {1 << 24}L + {1 << 23}L + CAST(CASE WHEN {v} = 0 THEN 0 ELSE"
        f" signum({v}) * (floor(ln(least(abs({v}), 1e308D)) * 2048) + {1 << 22}) END AS BIGINT)"
    )


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """Distinct values per key with summed measures; NULL and NaN are left out."""
    measures = measures or {"n": F.lit(1)}
    rows = df.select(*[quoted(k) for k in keys], number(quoted(value)).alias(value), *[
        m.cast("bigint").alias(name) for name, m in measures.items()
    ]).filter(quoted(value).isNotNull())
    return rows.groupBy(*keys, value).agg(*[F.sum(name).alias(name) for name in measures])


def with_prefix(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    keep: Column | None = None,
) -> DataFrame:
    """Add ``before_m`` (sum of ``m`` over smaller values) and ``total_m`` per key.

    ``counts`` has one row per (keys, value).  The offset of a slice travels as
    one extra first row of the slice, so rows and offsets meet in the shuffle
    the running sum needs anyway.  ``keep`` drops whole slices by a condition
    on ``__o_n``, ``__s_n`` and ``total_n``, so that only the slices a
    percentile falls into are sorted.
    """
    limits = counts.groupBy(*keys).agg(
        F.min(value).alias("__lo"), F.max(value).alias("__hi"), *[F.sum(m).alias(f"total_{m}") for m in measures]
    )
    sliced = attach(counts, limits, keys).withColumn(
        "__slice", _slice_of(value)
    ).drop("__lo", "__hi")
    per_slice = sliced.groupBy(*keys, "__slice").agg(
        *[F.sum(m).alias(f"__s_{m}") for m in measures], *[F.max(f"total_{m}").alias(f"total_{m}") for m in measures]
    )
    order = Window.partitionBy(*keys).orderBy("__slice")
    offsets = per_slice.select(
        "*", *[(F.sum(f"__s_{m}").over(order) - F.col(f"__s_{m}")).alias(f"__o_{m}") for m in measures]
    )
    if keep is not None:
        wanted = offsets.filter(keep).select(*keys, "__slice", *[f"__o_{m}" for m in measures])
        if not keys:
            wanted = F.broadcast(wanted)  # at most two slices per requested rank
        joined = join_on(sliced, wanted, [*keys, "__slice"])
        inner = Window.partitionBy(*keys, "__slice").orderBy(value)
        return joined.select(
            *[quoted(c) for c in counts.columns],
            *[(F.col(f"__o_{m}") + F.sum(m).over(inner) - F.col(m)).alias(f"before_{m}") for m in measures],
            *[F.col(f"total_{m}") for m in measures],
        )
    marked = union_all([
        sliced.withColumn("__row", F.lit(1)),
        offsets.select(*keys, "__slice", F.lit(0).alias("__row"), *[F.col(f"__o_{m}").alias(m) for m in measures]),
    ])
    inner = Window.partitionBy(*keys, "__slice").orderBy("__row", value).rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(
        "*", *[(F.sum(m).over(inner) - F.col(m)).alias(f"before_{m}") for m in measures]
    ).filter("__row = 1").drop("__row", "__slice")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], brackets: bool = False
) -> DataFrame:
    """Exact percentiles, linear interpolation: ``{output: (column, q)}`` → one row per key.

    Values are counted first (map-side), slices that hold no wanted rank are skipped.  With ``brackets``, for few keys with
    very many distinct values each, a sketch narrows every rank before anything is shuffled (``bracketed_quantiles``): two
    more scans, but no exchange of all values.  No task ever holds all values of a key.
    """
    if brackets:
        return bracketed_quantiles(df, keys, wanted)
    columns = sorted({c for c, _ in wanted.values()})
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), number(quoted(c)).alias("v")) for i, c in enumerate(columns)])
    long = df.select(*[quoted(k) for k in keys], F.explode(pairs).alias("__p")).select(
        *[quoted(k) for k in keys], F.col("__p.c").alias("__col"), F.col("__p.v").alias("__val")
    )
    counts = value_counts(long, [*keys, "__col"], "__val")
    probs = {i: sorted({q for cc, q in wanted.values() if cc == c}) for i, c in enumerate(columns)}

    def rank(q: float) -> str:
        return f"({float(q)!r}D * (total_n - 1))"

    cases = " ".join(
        f"WHEN {i} THEN array({', '.join(f'{f}{rank(q)}' for q in qs for f in ('floor', 'ceil'))})"
        for i, qs in probs.items()
    )
    touched = F.expr(f"exists(CASE __col {cases} END, e -> e >= __o_n AND e < __o_n + __s_n)")
    ranked = with_prefix(counts, [*keys, "__col"], "__val", ["n"], keep=touched)
    outputs = []
    for out, (c, q) in wanted.items():
        mine = f"__col = {columns.index(c)}"
        low, high = (
            f"max(CASE WHEN {mine} AND {f}{rank(q)} >= before_n AND {f}{rank(q)} < before_n + n THEN __val END)"
            for f in ("floor", "ceil")
        )
        part = f"max(CASE WHEN {mine} THEN {rank(q)} - floor{rank(q)} END)"
        outputs.append(F.expr(f"{low} + ({high} - {low}) * {part}").alias(out))
    return ranked.groupBy(*keys).agg(*outputs)


# A bracket reaches this share of the values to either side of its rank; the sketch is off by a quarter of it at most.
BRACKET = 0.002
SKETCH = 2000
FEW = 2000  # up to so many values a bracket holds them all


def _literals(row: DataFrame) -> list[Column]:
    """The only row of a table as literal columns."""
    values = row.head()
    return [F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in row.schema]


def bracketed_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``exact_quantiles`` in three scans that shuffle only values close to a wanted rank.

    A mergeable sketch gives a lower and an upper value around every rank, the second scan counts what lies below, the
    third one counts the distinct values between.  The rank inside the bracket is then exact; a bracket that missed its
    rank would raise an error.
    """
    columns = sorted({c for c, _ in wanted.values()})
    places = sorted({(columns.index(c), float(q)) for c, q in wanted.values()})
    rows = df.select(*[quoted(k) for k in keys], *[number(quoted(c)).alias(f"__v{i}") for i, c in enumerate(columns)])
    sketch = []
    for i in range(len(columns)):
        v = F.col(f"__v{i}")
        points = [p for j, q in places if j == i for p in (max(q - BRACKET, 0.0), min(q + BRACKET, 1.0))]
        sketch += [
            F.count(v).alias(f"__n{i}"), F.min(v).alias(f"__min{i}"), F.max(v).alias(f"__max{i}"),
            F.percentile_approx(v, F.array(*[F.lit(p) for p in points]), F.lit(SKETCH)).alias(f"__p{i}"),
        ]
    ends, seen = [], dict.fromkeys(range(len(columns)), 0)
    for k, (i, q) in enumerate(places):
        at, seen[i] = seen[i], seen[i] + 2
        wide = F.col(f"__n{i}") <= FEW
        ends += [
            F.when(wide | F.lit(q <= BRACKET), F.col(f"__min{i}")).otherwise(F.col(f"__p{i}")[at]).alias(f"__ql{k}"),
            F.when(wide | F.lit(q >= 1 - BRACKET), F.col(f"__max{i}")).otherwise(F.col(f"__p{i}")[at + 1]).alias(f"__qh{k}"),
            (F.lit(q) * (F.col(f"__n{i}") - 1)).alias(f"__qr{k}"),
        ]
    bounds = rows.groupBy(*keys).agg(*sketch).select(*[quoted(k) for k in keys], *ends)
    # one row of numbers for a whole table: as literals they reach the scan, and no plan is nested in a plan
    near = attach(rows, bounds, keys) if keys else rows.select("*", *_literals(bounds))
    counted = near.groupBy(*keys).agg(*[
        e for k, (i, _) in enumerate(places)
        for e in (F.count_if(F.col(f"__v{i}") < F.col(f"__ql{k}")).alias(f"__qb{k}"), *[F.first(f"__q{x}{k}").alias(f"__q{x}{k}") for x in "lhr"])
    ])
    inside = [F.col(f"__v{i}").between(F.col(f"__ql{k}"), F.col(f"__qh{k}")) for k, (i, _) in enumerate(places)]
    hits = F.array(*[
        F.when(inside[k], F.struct(F.lit(k).alias("k"), (F.floor(f"__qr{k}") - F.col(f"__qb{k}")).alias("r"), (F.col(f"__qr{k}") - F.floor(f"__qr{k}")).alias("f"), F.col(f"__v{i}").alias("v")))
        for k, (i, _) in enumerate(places)
    ])
    group = [*keys, "__k", "__qr", "__f"]
    near = attach(rows, counted, keys) if keys else rows.select("*", *_literals(counted))
    close = near.where(reduce(or_, inside)).select(*[quoted(k) for k in keys], F.explode(F.array_compact(hits)).alias("__x")).select(
        *[quoted(k) for k in keys], F.col("__x.k").alias("__k"), F.col("__x.r").alias("__qr"), F.col("__x.f").alias("__f"), F.col("__x.v").alias("__val")
    ).groupBy(*group, "__val").agg(F.count(F.lit(1)).alias("n"))
    above = "(__qr + CASE WHEN __f > 0 THEN 1 ELSE 0 END)"
    touched = F.expr(f"exists(array(__qr, {above}), e -> e >= __o_n AND e < __o_n + __s_n)")
    ranked = with_prefix(close, group, "__val", ["n"], keep=touched)
    outputs = []
    for out, (c, q) in wanted.items():
        mine = f"__k = {places.index((columns.index(c), float(q)))}"
        low, high = (f"max(CASE WHEN {mine} AND {r} >= before_n AND {r} < before_n + n THEN __val END)" for r in ("__qr", above))
        missed = f"max(CASE WHEN {mine} THEN 1 END) IS NOT NULL AND ({low} IS NULL OR {high} IS NULL)"
        outputs.append(F.expr(
            f"CASE WHEN {missed} THEN raise_error('a percentile lies outside its bracket') ELSE {low} + ({high} - {low}) * max(CASE WHEN {mine} THEN __f END) END"
        ).cast("double").alias(out))
    return ranked.groupBy(*keys).agg(*outputs)


def most_common(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, str]) -> DataFrame:
    """Most frequent non-null value per key, smallest on a tie: ``{output: column}``."""
    parts = []
    for out, column in wanted.items():
        counted = df.filter(quoted(column).isNotNull()).groupBy(*keys, quoted(column).alias("__v")).agg(
            F.count(F.lit(1)).alias("__n")
        )
        best = counted.groupBy(*keys).agg(F.max("__n").alias("__m"))
        top = attach(counted, best, keys).filter(F.col("__n") == F.col("__m"))
        parts.append(top.groupBy(*keys).agg(F.min("__v").alias(out)))
    return merge_by_keys(parts, keys)


def with_order_index(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = (), total: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``__idx``: 0-based position of each row within its key, ordered by ``ts, tiebreak``.

    ``ts`` is a timestamp or a number.  Rows are ranked by the original values
    inside time slices of the key; the slice offsets come from one running total over the bounded
    list of slices.  A slice with more than ``hot_rows`` rows is cut again:
    over its own time range, or, when all its rows have one and the same time,
    over the range of the first tiebreak if that is a number.  ``total`` names
    an extra column with the row count of the key.
    """
    kind = df.schema[ts].dataType.typeName()
    if kind.startswith("timestamp") or kind == "date":
        position = micros(quoted(ts))
    else:  # a double cannot tell large integers apart
        position = quoted(ts).cast("decimal(20,0)" if kind == "long" else "double")
    numeric_tie = bool(tiebreak) and isinstance(df.schema[tiebreak[0]].dataType, NUMERIC)
    placed = df.withColumn("__pos", position).withColumn(
        "__tie", quoted(tiebreak[0]).cast("double") if numeric_tie else F.lit(None).cast("double")
    )
    limits = placed.groupBy(*keys).agg(
        F.min("__pos").alias("__lo"), F.max("__pos").alias("__hi"), *([F.count(F.lit(1)).alias(total)] if total else [])
    )
    sliced = attach(placed, limits, keys).withColumn(
        "__slice",
        F.expr(
            "CASE WHEN __pos IS NULL THEN -1L WHEN __hi > __lo THEN"
            f" CAST(floor((__pos - __lo) / CAST(__hi - __lo AS DOUBLE) * {SLICES}D) AS BIGINT) ELSE 0L END"
        ),
    ).drop("__lo", "__hi")
    hot = sliced.groupBy(*keys, "__slice").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__lo"), F.max("__pos").alias("__hi"),
        F.min("__tie").alias("__tlo"), F.max("__tie").alias("__thi"), (F.min(quoted(ts)) == F.max(quoted(ts))).alias("__same"),
    ).filter(F.col("__n") > hot_rows).drop("__n")
    # usually there is no hot slice: AQE then drops this join at run time
    cut = join_on(sliced, hot, [*keys, "__slice"], "left").withColumn(
        "__sub",
        F.expr(
            f"CASE WHEN __hi > __lo THEN CAST(floor((__pos - __lo) / CAST(__hi - __lo AS DOUBLE) * {SUB_SLICES}D) AS BIGINT)"
            f" WHEN __same AND __thi > __tlo THEN CAST(floor((__tie - __tlo) / (__thi - __tlo) * {SUB_SLICES}D) AS BIGINT) ELSE 0L END"
        ),
    ).drop("__lo", "__hi", "__tlo", "__thi", "__same")
    cut = cut.withColumn("__sub", F.coalesce("__sub", F.lit(-1)))
    sizes = cut.groupBy(*keys, "__slice", "__sub").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__slice", "__sub")
    offsets = sizes.select(
        *[quoted(k) for k in keys],
        "__slice",
        "__sub",
        F.lit(0).alias("__row"),
        (F.sum("__n").over(order) - F.col("__n")).alias("__off"),
    )
    marked = union_all([cut.withColumn("__row", F.lit(1)), offsets])
    inner = Window.partitionBy(*keys, "__slice", "__sub").orderBy("__row", quoted(ts), *[quoted(t) for t in tiebreak])
    return marked.select(
        *[quoted(c) for c in df.columns],
        "__row",
        (F.first("__off").over(inner) + F.row_number().over(inner) - 2).alias("__idx"),
        *([F.col(total)] if total else []),
    ).filter("__row = 1").drop("__row")


def newest_rows(df: DataFrame, keys: Sequence[str], ts: str, limit: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest ``limit`` rows per key.

    A small limit is applied inside each task before the shuffle (Spark's
    window group limit); a larger one uses the order index, so that no task
    sorts a whole key.
    """
    if limit <= GROUP_LIMIT:
        order = [F.desc(quoted(ts)), *[F.desc(quoted(t)) for t in tiebreak]]
        ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.filter(F.col("__rn") <= limit).drop("__rn")
    indexed = with_order_index(df, keys, ts, tiebreak, total="__total")
    return indexed.filter(F.col("__idx") >= F.col("__total") - limit).drop("__idx", "__total")


def framed_window(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: Sequence[str],
    lookback: int,
    columns: Callable[[Window], Mapping[str, Column]],
    block_rows: int = BLOCK_ROWS,
    total: str | None = None,
) -> DataFrame:
    """Row-frame window functions that look back at most ``lookback`` rows.

    Rows are numbered, cut into blocks, and the last ``lookback`` rows of a
    block are repeated in front of the next one, so a key of any size is
    spread over many tasks.  ``columns`` gets the ordered window spec and
    returns ``{name: expression}``; ``__idx`` (and ``total``) may be used.
    """
    size = max(block_rows, lookback, 1)
    indexed = with_order_index(df, keys, ts, tiebreak, total)
    own = F.floor(F.col("__idx") / F.lit(size)).cast("bigint")
    homes = F.when(F.col("__idx") % size >= size - lookback, F.array(own, own + 1)).otherwise(F.array(own))
    spread = indexed.withColumn("__own", own).withColumn("__block", F.explode(homes))
    spec = Window.partitionBy(*keys, "__block").orderBy("__idx")
    exprs = columns(spec)
    extra = ["__idx"] + ([total] if total else [])
    return spread.select(
        *[quoted(c) for c in df.columns],
        *[F.col(c) for c in extra],
        "__own",
        "__block",
        *[e.alias(name) for name, e in exprs.items()],
    ).filter(F.col("__own") == F.col("__block")).drop("__own", "__block")


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values with their 0-based place in sorted order: ``(column, code)``.

    The distinct values are range-partitioned and written once to the shared
    checkpoint folder, which fixes the partition numbers; then only the
    partition sizes are totalled.
    """
    from tidewatch.session import cut_lineage

    distinct = df.select(quoted(column)).filter(quoted(column).isNotNull()).distinct()
    ranged = cut_lineage(
        distinct.repartitionByRange(quoted(column)).withColumn("__part", F.spark_partition_id())
    )
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        "__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__off")
    )
    inner = Window.partitionBy("__part").orderBy(quoted(column))
    return join_on(ranged, offsets, ["__part"]).select(
        quoted(column), (F.col("__off") + F.row_number().over(inner) - 1).cast("bigint").alias("code")
    )


__all__ = [
    "dense_codes",
    "exact_quantiles",
    "framed_window",
    "most_common",
    "newest_rows",
    "union_all",
    "value_counts",
    "with_order_index",
    "with_prefix",
]
