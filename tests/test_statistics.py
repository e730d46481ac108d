"""p-values, drift, performance, A/B and isolation forest on small hand cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import stats as P
from tidewatch.operators import abtest as B
from tidewatch.operators import drift as D
from tidewatch.operators import features as X
from tidewatch.operators import iforest as I
from tidewatch.operators import performance as M

RNG = np.random.default_rng(11)


def test_known_p_values():
    assert P.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert P.student_two_sided(-12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert P.student_two_sided(0.0, 7) == pytest.approx(1.0)
    assert P.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert P.normal_two_sided(-0.3) == 1.0
    assert math.isnan(P.student_two_sided(1.0, 0))


def sides(spark, base, cur, name="f"):
    rows = [(name, "baseline", float(x)) for x in base] + [(name, "current", float(x)) for x in cur]
    return spark.createDataFrame(rows, "feature string, side string, value double")


def test_same_sample_has_no_distance(spark):
    x = RNG.normal(size=200)
    r = D.statistical(sides(spark, x, x)).head()
    assert r.ks_statistic == 0 and r.ks_pvalue == 1 and r.t_pvalue == pytest.approx(1)
    assert r.mw_statistic == pytest.approx(200 * 200 / 2) and r.mw_pvalue == 1
    assert not r.p_flag and r.drift_score == pytest.approx(0, abs=1e-9)


def test_distance_grows_with_the_shift(spark):
    x = RNG.normal(size=200)
    frames = [sides(spark, x, x + s, f"s{i}") for i, s in enumerate((0.1, 0.5, 2.0))]
    got = {r.feature: r for r in D.statistical(frames[0].union(frames[1]).union(frames[2])).collect()}
    ds = [got[f"s{i}"].ks_statistic for i in range(3)]
    assert ds == sorted(ds) and got["s2"].p_flag and got["s2"].drift_detected


def test_ks_and_mann_whitney_by_brute_force(spark):
    a, b = RNG.integers(0, 9, 120).astype(float), RNG.integers(2, 11, 150).astype(float)
    r = D.rank_tests(sides(spark, a, b)).head()
    grid = np.unique(np.concatenate([a, b]))
    assert r.ks_statistic == pytest.approx(max(abs((a <= g).mean() - (b <= g).mean()) for g in grid))
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    assert r.mw_statistic == pytest.approx(u)


def test_too_few_rows_do_not_count_as_drift(spark):
    r = D.statistical(sides(spark, RNG.normal(size=200), RNG.normal(5, 1, size=50))).head()
    assert not r.drift_detected and r.drift_score == 0 and r.confidence == 0


def test_distribution_drift_of_a_constant(spark):
    r = D.distribution(sides(spark, [1.0] * 120, [1.0] * 120)).head()
    assert r.drift_detected is False and r.drift_score is None


PRED = "model_id string, batch_id string, ts timestamp, y_true double, y_pred double, latency_ms double"


def predictions(spark, y, p, latency=50.0, model="m"):
    rows = [(model, "b", None, float(a), float(b), latency) for a, b in zip(y, p)]
    return spark.createDataFrame(rows, PRED)


def test_five_predictions(spark):
    r = M.batch_metrics(predictions(spark, [0, 1, 0, 1, 0], [0, 1, 0, 0, 0])).head()
    assert r.accuracy == pytest.approx(0.8) and r.recall == pytest.approx(0.8)
    assert r.precision == pytest.approx(0.6 * 0.75 + 0.4 * 1.0)
    assert r.f1_score == pytest.approx(0.6 * (2 * 0.75 / 1.75) + 0.4 * (2 * 0.5 / 1.5))
    assert r.auc_score == pytest.approx(0.75) and r.throughput_rps == pytest.approx(20.0)


def test_auc_edges(spark):
    assert M.auc(predictions(spark, [0, 0, 1, 1], [1, 2, 3, 4]), ["model_id"]).head().auc_score == 1.0
    assert M.auc(predictions(spark, [0, 0, 1, 1], [4, 3, 2, 1]), ["model_id"]).head().auc_score == 0.0
    assert M.auc(predictions(spark, [0, 0], [4, 3]), ["model_id"]).head().auc_score == 0.0
    assert M.auc(predictions(spark, [0, 1, 2], [4, 3, 1]), ["model_id"]).head().auc_score == 0.0


def test_regression_with_zero_range_and_other_types(spark):
    r = M.batch_metrics(predictions(spark, [2, 2], [2, 2], 0.0), "regression").head()
    assert r.accuracy == 1.0 and r.rmse == 0.0 and r.throughput_rps == 0.0
    assert M.batch_metrics(predictions(spark, [2], [1]), "clustering").head().f1_score == 0.5


def test_degradation_frame_leaves_out_the_point_just_before(spark):
    acc = [0.9] * 10 + [0.1, 0.5]
    rows = [("m", f"b{i:02d}", i, a, 10.0) for i, a in enumerate(acc)]
    df = spark.createDataFrame(rows, "model_id string, batch_id string, ts int, accuracy double, latency_ms double")
    got = {r.batch_id: r for r in M.degradation_alerts(df, block_rows=1).collect()}
    assert set(got) == {"b10", "b11"}
    assert got["b11"].threshold_value == pytest.approx(0.9)  # 0.1 is the point just before, not in the mean


def test_ab_gates_and_winner(spark):
    def arm(name, mean, n):
        return [("t", name, float(x)) for x in mean + RNG.normal(0, 1, n)]

    schema = "test_id string, assigned_model string, m double"
    r = B.analyze(spark.createDataFrame(arm("A", 0, 150) + arm("B", 2, 150), schema), "m").head()
    assert r.winner == "B" and r.statistical_significance and r.effect_size > 1 and r.ci_lower < 2 < r.ci_upper + 0.5
    low = B.analyze(spark.createDataFrame(arm("A", 0, 150) + arm("B", 2, 150), schema), "m", higher_is_better=False).head()
    assert low.winner == "A"
    assert B.analyze(spark.createDataFrame(arm("A", 0, 150) + arm("B", 2, 99), schema), "m").count() == 0


def test_assignment_is_stable_and_splits(spark):
    users = spark.range(5000).select(F.col("id").alias("user_id"))
    a = B.assign(users, "t", split=0.3)
    share = a.filter("assigned_model = 'B'").count() / 5000
    assert abs(share - 0.3) < 0.03
    assert a.exceptAll(B.assign(users.repartition(3), "t", split=0.3)).count() == 0
    assert B.assign(users, "t", enabled=False).filter("assigned_model = 'B'").count() == 0


def test_forest_flags_the_far_points(spark):
    x = np.concatenate([RNG.normal(0, 1, 990), np.full(10, 60.0) + RNG.random(10)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    flagged = I.outlier_flags(df, "x", ["id"]).toPandas()
    assert flagged[flagged.x > 50]["is_outlier"].all()
    assert 0.05 < flagged["is_outlier"].mean() <= 0.11
    again = I.outlier_flags(df.repartition(7), "x", ["id"]).toPandas().set_index("id").sort_index()
    np.testing.assert_array_equal(again["decision"], flagged.set_index("id").sort_index()["decision"])


def test_forest_drift(spark):
    x = np.concatenate([RNG.normal(0, 1, 600), RNG.normal(4, 1, 600)])
    df = spark.createDataFrame([(i, float(v), i < 600) for i, v in enumerate(x)], "id long, x double, base boolean")
    assert I.drift(df, "x", ["id"], F.col("base")).head().drift_detected
    same = df.withColumn("base", F.col("id") % 2 == 0)
    assert I.drift(same, "x", ["id"], F.col("base")).head().drift_score < 0.1


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.5, 9.0, 10.0], [5.0, 5.0], [0.0, 0.0], [float(x) for x in RNG.normal(size=60)]])
@pytest.mark.parametrize("bins", [1, 4, 10])
def test_bins_equal_pandas(spark, values, bins):
    import pandas as pd

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v_binned for r in X.bin_equal_width(df, "v", bins).orderBy("i").collect()]
    assert got == list(pd.cut(pd.Series(values), bins=bins).cat.codes)


def test_edges_scaling_and_one_hot_limits(spark):
    df = spark.createDataFrame([(0.0, "a"), (1.0, "b"), (2.0, None), (3.0, "b")], "v double, c string")
    assert [r.v_binned for r in X.bin_by_edges(df, "v", [0, 1, 2]).orderBy("v").collect()] == [None, 0, 1, None]
    assert {r.one_scaled for r in X.scale(df.withColumn("one", F.lit(4.0)), "one").collect()} == {0.0}
    hot = X.one_hot(df, "c").orderBy("v").collect()
    assert [(r.c_a, r.c_b) for r in hot] == [(True, False), (False, True), (False, False), (False, True)]
    many = spark.range(1500).selectExpr("cast(id AS string) AS c")
    assert len(X.one_hot(many, "c").columns) == 1501
    assert X.normalize(df.withColumn("one", F.lit(4.0)), ["one"]).filter("one_normalized is not null").count() == 0
