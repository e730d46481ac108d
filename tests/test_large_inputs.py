"""Inputs that break caps, inexact orders and mixed groups."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import ordered as O
from tidewatch.operators import alerting, iforest, rootcause


@pytest.mark.parametrize("hot_rows", [O.HOT_ROWS, 3])
def test_neighbouring_nanoseconds_keep_their_order(spark, hot_rows):
    start = 1_700_000_000_000_000_000
    rows = [("k", start + i, 100 - i) for i in range(20)] + [("k", start + 5_000_000, 0), ("k", None, 1)]
    df = spark.createDataFrame(rows, "k string, ts bigint, tie int").repartition(4)
    got = O.with_order_index(df, ["k"], "ts", ["tie"], hot_rows=hot_rows).collect()
    expected = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert [(r["k"], r["ts"], r["tie"]) for r in sorted(got, key=lambda r: r["__idx"])] == expected
    assert sorted(r["__idx"] for r in got) == list(range(len(rows)))


def test_newest_rows_agree_on_both_sides_of_the_plan_choice(spark):
    start = 1_700_000_000_000_000_000
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") + start).alias("ts"), "id")
    wide = {r["id"] for r in O.newest_rows(df, ["k"], "ts", O.GROUP_LIMIT + 1, ["id"]).collect()}
    narrow = {r["id"] for r in O.newest_rows(df, ["k"], "ts", O.GROUP_LIMIT, ["id"]).collect()}
    assert wide - narrow == {998, 999} and narrow < wide


def test_correlations_of_more_than_three_hundred_metrics(spark):
    x = np.random.default_rng(5).normal(size=(320, 12))
    t0 = datetime(2024, 1, 1)
    rows = [(f"m{i:03d}", t0 + timedelta(minutes=j), float(x[i, j])) for i in range(320) for j in range(12)]
    got = rootcause.correlations(spark.createDataFrame(rows, "metric string, ts timestamp, value double")).toPandas()
    assert len(got) == 320 * 319 // 2 and set(got["n"]) == {12}
    i, j = (got[c].str[1:].astype(int).to_numpy() for c in ("metric1", "metric2"))
    assert (i < j).all()
    np.testing.assert_allclose(got["correlation"], np.corrcoef(x)[i, j], atol=1e-9)


def test_correlations_of_named_metrics_keep_the_given_order(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(m, t0 + timedelta(minutes=j), float(j * s)) for m, s in (("a", 1), ("b", -1), ("c", 2)) for j in range(11)]
    series = spark.createDataFrame(rows, "metric string, ts timestamp, value double")
    got = rootcause.correlations(series, ["c", "a"], symmetric=True).collect()
    assert sorted((r["metric1"], r["metric2"], round(r["correlation"], 9)) for r in got) == [("a", "c", 1.0), ("c", "a", 1.0)]
    assert [r["metric1"] for r in rootcause.correlations(series, ["c", "a"]).collect()] == ["c"]


@pytest.mark.parametrize("n", [1, 100, 30_000, 400_000])
def test_every_tree_draws_its_own_rows(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 17).cast("double").alias("x"))
    drawn = iforest.draw(df, "x", ["id"]).groupBy("tree").count().collect()
    assert len(drawn) == iforest.TREES and {r["count"] for r in drawn} == {min(n, iforest.SAMPLE)}
    with pytest.raises(ValueError):
        iforest.draw(df, "x", [])


def test_cooldowns_of_one_key_are_kept_apart(spark):
    t0 = datetime(2024, 1, 1)
    hits = [("r", i, t0 + timedelta(seconds=i), 10 if i % 2 else 40) for i in range(60)]
    df = spark.createDataFrame(hits, "rule_id string, event_id long, ts timestamp, cooldown_seconds long")
    for stretch in (1, 1 << 20):
        got = sorted(r["event_id"] for r in alerting.cooldown(df, stretch_rows=stretch).collect())
        assert got == [0, 1, 11, 21, 31, 40, 41, 51]
