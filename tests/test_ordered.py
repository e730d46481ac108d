"""Ranks, percentiles and framed windows against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from tidewatch.functions import ordered as O
from tidewatch.operators import windows as W

RNG = np.random.default_rng(7)
SHAPES = {
    "normal": RNG.normal(size=500),
    "constant": np.full(50, 3.0),
    "ties": RNG.integers(0, 4, 300).astype(float),
    "outlier": np.concatenate([[-1e9], RNG.random(300)]),
    "offset": 1.7e9 + RNG.random(300),
    "offset_and_zero": np.concatenate([[0.0], 1.7e9 + RNG.random(300)]),
    "tiny": RNG.random(200) * 1e-300,
    "mixed_signs": np.concatenate([-np.exp(RNG.normal(0, 20, 200)), np.exp(RNG.normal(0, 20, 200)), [0.0]]),
    "one": np.array([5.0]),
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(k, float(x)) for k, v in SHAPES.items() for x in v]
    rows += [("normal", None), ("normal", float("nan")), (None, 2.0), (None, 4.0)]
    return spark.createDataFrame(rows, "k string, x double").repartition(5).cache()


def test_quantiles_equal_numpy(shapes):
    got = O.exact_quantiles(shapes, ["k"], {"lo": ("x", 0.1), "mid": ("x", 0.5), "hi": ("x", 0.99)}).toPandas().set_index("k")
    for k, v in SHAPES.items():
        for name, q in (("lo", 0.1), ("mid", 0.5), ("hi", 0.99)):
            assert got.loc[k, name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-310), (k, name)
    assert got[got.index.isna()]["mid"].iloc[0] == 3.0


def test_quantiles_without_key_and_without_rows(spark, shapes):
    whole = O.exact_quantiles(shapes, [], {"m": ("x", 0.25)}).head()["m"]
    every = np.concatenate([*SHAPES.values(), [2.0, 4.0]])
    assert whole == pytest.approx(np.quantile(every, 0.25))
    empty = O.exact_quantiles(shapes.limit(0), [], {"m": ("x", 0.25)}).collect()
    assert len(empty) == 1 and empty[0]["m"] is None


def test_prefix_sums(shapes):
    counts = O.value_counts(shapes, ["k"], "x")
    got = O.with_prefix(counts, ["k"], "x", ["n"]).filter("k is not null").toPandas()
    for k, v in SHAPES.items():
        part = got[got.k == k].sort_values("x")
        assert list(part["before_n"]) == [int((v < x).sum()) for x in part["x"]]
        assert set(part["total_n"]) == {len(v)}


def test_partition_count_does_not_matter(spark, shapes):
    wanted = {"m": ("x", 0.3)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, O.exact_quantiles(shapes, ["k"], wanted).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


@pytest.fixture(scope="module")
def series():
    n = 400
    return pd.DataFrame({
        "k": np.where(RNG.random(n) < 0.7, "hot", "cold"),
        # many equal times, so that the tiebreak matters
        "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(RNG.integers(0, 60, n) * 3600, unit="s"),
        "id": np.arange(n),
        "x": np.where(RNG.random(n) < 0.05, np.nan, RNG.normal(size=n)),
    })


@pytest.mark.parametrize("hot_rows", [1, 5, 1 << 22])
@pytest.mark.parametrize("one_time", [False, True])
def test_order_index(spark, series, hot_rows, one_time):
    frame = series.assign(t=series["t"].iloc[0]) if one_time else series
    got = O.with_order_index(spark.createDataFrame(frame), ["k"], "t", ["id"], "n", hot_rows).toPandas()
    for k, part in got.groupby("k"):
        part = part.sort_values(["t", "id"])
        assert list(part["__idx"]) == list(range(len(part)))
        assert set(part["n"]) == {len(part)}


@pytest.mark.parametrize("block", [5, 7, 64, 100_000])
def test_rolling_equals_pandas(spark, series, block):
    df = spark.createDataFrame(series)
    got = W.rolling(df, "x", "t", 5, ("mean", "std", "min", "max"), ["k"], ["id"], block_rows=block).toPandas().set_index("id").sort_index()
    ref = series.sort_values(["t", "id"])
    for fn in ("mean", "std", "min", "max"):
        want = ref.groupby("k")["x"].rolling(5).agg(fn).reset_index(level=0, drop=True).sort_index()
        np.testing.assert_allclose(got[f"x_rolling_{fn}_5"].astype(float), want, rtol=1e-9, atol=1e-12)
    assert len(got) == len(series)


def test_trailing_short_series_is_unchanged(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0)], "t int, x double")
    got = {r["t"]: r["aggregated"] for r in W.trailing(df, "x", "t", "mean", 10).collect()}
    assert got == {1: 5.0, 2: 7.0}
    got = {r["t"]: r["aggregated"] for r in W.trailing(df, "x", "t", "sum", 2, block_rows=1).collect()}
    assert got == {1: 5.0, 2: 12.0}


def test_dense_codes(spark):
    df = spark.createDataFrame([(w,) for w in "pear fig apple fig kiwi".split()] + [(None,)], "w string")
    got = {r["w"]: r["code"] for r in O.dense_codes(df, "w").collect()}
    assert got == {"apple": 0, "fig": 1, "kiwi": 2, "pear": 3}


def test_most_common_takes_smallest_on_tie(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None), ("b", "z")], "k string, v string")
    assert {r["k"]: r["m"] for r in O.most_common(df, ["k"], {"m": "v"}).collect()} == {"a": "x", "b": "z"}


def test_no_single_task_sort(shapes):
    """The only windows without a hash exchange run over the bounded slice table."""
    plan = O.with_prefix(O.value_counts(shapes, ["k"], "x"), ["k"], "x", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("few", [2000, 10])
def test_percentiles_by_bracket(spark, monkeypatch, few):
    """Ties, one key with most values, null and NaN, a key without values, and more values than a bracket holds whole."""
    monkeypatch.setattr(O, "FEW", few)
    rng = np.random.default_rng(few)
    rows = [("hot" if i % 3 else None, float(x), float(rng.integers(0, 7)) if i % 11 else float("nan")) for i, x in enumerate(rng.normal(size=9000) * 1e6)]
    rows += [("small", 1.0, None), ("small", 2.0, 5.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    wanted = {f"{c}{q}": (c, q) for c in "xy" for q in (0.0, 0.001, 0.25, 0.5, 0.999, 1.0)}

    def exact(own, c, q):
        values = [v for v in (r[1 if c == "x" else 2] for r in own) if v is not None and v == v]
        return np.quantile(values, q) if values else None

    whole = O.exact_quantiles(df, [], wanted, brackets=True).head().asDict()
    assert all(abs(whole[o] - exact(rows, c, q)) < 1e-6 for o, (c, q) in wanted.items())
    for r in O.exact_quantiles(df, ["k"], wanted, brackets=True).collect():
        own = [x for x in rows if x[0] == r.k]
        for o, (c, q) in wanted.items():
            want = exact(own, c, q)
            assert (r[o] is None and want is None) or abs(r[o] - want) < 1e-6, (r.k, o)
