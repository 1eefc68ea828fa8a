import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.functions.student_t import t_test_p, two_sided_p
from paneltide.operators import evaluation as ev


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    return y, y + rng.normal(size=200) * 0.3, y + rng.normal(size=200) * 0.4


@pytest.fixture(scope="module")
def wide(spark, numbers):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*numbers)], "TRUE double, Informer_pred double, ETS_pred double")


def test_metrics(wide, numbers):
    y, a, b = numbers
    rows = {r.model: r for r in ev.error_metrics(ev.long_predictions(wide, "TRUE", ["Informer_pred", "ETS_pred"])).collect()}
    for name, p in (("Informer", a), ("ETS", b)):
        e = y - p
        r = rows[name]
        assert (r.n, r.MSE, r.RMSE, r.MAE, r.R2) == pytest.approx(
            (200, np.mean(e**2), math.sqrt(np.mean(e**2)), np.mean(abs(e)), 1 - np.sum(e**2) / np.sum((y - y.mean())**2)))


def test_relative_errors_with_zero_actual(spark):
    long = spark.createDataFrame([("m", "test", 0.0, 1.0), ("m", "test", 2.0, 1.0), ("z", "test", 0.0, 0.0)], "model string, split string, y double, p double")
    guarded = {r.model: r for r in ev.error_metrics_pct(long).collect()}
    assert guarded["m"].MAPE == pytest.approx((1e9 + 0.5) / 2 * 100) and guarded["z"].MAPE == 0
    raw = {r.model: r for r in ev.error_metrics_raw(long).collect()}
    assert math.isinf(raw["m"].MAPE) and math.isnan(raw["z"].MAPE)


def test_rse_and_product_correlation(wide, numbers):
    y, a, _ = numbers
    r = ev.rse_corr(ev.long_predictions(wide, "TRUE", ["Informer_pred"])).first()
    dy, dp = y - y.mean(), a - a.mean()
    assert r.RSE == pytest.approx(math.sqrt(np.sum((y - a)**2)) / math.sqrt(np.sum(dy**2)))
    assert r.CORR == pytest.approx(np.sum(dy * dp) / math.sqrt(np.sum(dy**2 * dp**2)))


def test_moments_in_one_pass_survive_offsets(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for key, offset in (("a", 0.0), ("b", 1e9), (None, -1e6)):
        y = rng.normal(size=500)
        p = y + rng.normal(size=500) * 0.5
        rows += [(key, float(a + offset), float(b + offset + 1)) for a, b in zip(y, p)]
        y, p = np.array([r[1] for r in rows[-500:]]), np.array([r[2] for r in rows[-500:]])
        dy, dp = y - y.mean(), p - p.mean()
        want[key] = (math.sqrt(np.sum((y - p) ** 2) / np.sum(dy ** 2)), np.sum(dy * dp) / math.sqrt(np.sum(dy ** 2 * dp ** 2)))
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 1.0, None)], "model string, y double, p double").repartition(7, F.rand(2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = ev.rse_corr(df)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {r.model: (r.RSE, r.CORR) for r in got.collect()} == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Join" not in plan
    whole = ev.rse_corr(df.where("model = 'a'"), ()).first()
    assert (whole.RSE, whole.CORR) == pytest.approx(want["a"])


def test_dm_statistic(wide, numbers):
    y, a, b = numbers
    rows = {r.criterion: r for r in ev.dm_tests(wide, "TRUE", "Informer_pred", ["ETS_pred"]).collect()}
    for name, loss in (("MAD", np.abs), ("MSE", np.square)):
        d = loss(y - a) - loss(y - b)
        want = d.mean() / math.sqrt(d.var() / 200) * math.sqrt(199 / 200)
        assert rows[name].statistic == pytest.approx(want) and rows[name].statistic < 0
        assert rows[name].p_value == pytest.approx(two_sided_p(np.array(want), np.array(199.0)).item())
    cells = ev.dm_table(ev.dm_tests(wide, "TRUE", "Informer_pred", ["ETS_pred"]), ["ETS"]).collect()
    assert all(c.ETS.startswith("-") and c.ETS.endswith("***") for c in cells)


def test_dm_without_variance(wide):
    same = wide.withColumn("Copy_pred", F.col("Informer_pred"))
    assert ev.dm_statistics(same, "TRUE", "Informer_pred", ["Copy_pred"]).first().statistic is None
    with pytest.raises(Exception, match="differ by a constant"):
        ev.dm_statistics(same, "TRUE", "Informer_pred", ["Copy_pred"], strict=True).collect()


@pytest.mark.parametrize("t, df, p", [  # closed forms for one and two degrees of freedom, normal limit, published marks
    (1.0, 1, 0.5), (math.sqrt(2), 2, 1 - 1 / math.sqrt(2)), (0.0, 7, 1.0), (1.959963984540054, 1e7, 0.05), (2.570581835636314, 5, 0.05),
    (-12.706204736432095, 1, 0.05), (63.65674116287158, 1, 0.01)])
def test_student_t(t, df, p):
    assert two_sided_p(np.array([t]), np.array([df]))[0] == pytest.approx(p, rel=1e-6)


@pytest.mark.parametrize("t, df, mark", [(-1.669, 671, "*"), (-1.499, 675, ""), (-1.574, 675, ""), (-2.245, 675, "**"), (-2.091, 675, "**"),
                                         (-1.881, 671, "*"), (-2.627, 671, "***"), (-3.473, 671, "***")])
def test_published_significance(t, df, mark):
    p = two_sided_p(np.array([t]), np.array([df]))[0]
    assert ("***" if p < .01 else "**" if p < .05 else "*" if p < .1 else "") == mark


def test_p_value_of_missing_statistic(frame):
    assert frame([(None, 5.0)], "t double, n double").select(t_test_p("t", "n").alias("p")).first().p is None


def brute(label, pred, average):
    classes = sorted(set(label) | set(pred))
    p, r, f, w = [], [], [], []
    for c in classes:
        hit = sum(a == b == c for a, b in zip(label, pred))
        said, true = pred.count(c), label.count(c)
        p.append(hit / said if said else 0)
        r.append(hit / true if true else 0)
        f.append(2 * p[-1] * r[-1] / (p[-1] + r[-1]) if p[-1] + r[-1] else 0)
        w.append(true if average == "weighted" else 1)
    return [np.average(x, weights=w) for x in (p, r, f)]


def test_classification_scores(frame):
    label, pred = [0, 0, 1, 1, 2, 2, 2, 0], [0, 1, 1, 1, 0, 3, 2, 0]
    got = ev.weighted_prf(frame(list(zip(label, pred)), "y int, p int"), "y", "p").first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == pytest.approx((5 / 8, *brute(label, pred, "weighted")))


def test_macro_scores_by_step(frame):
    rows = [(0, 1, [0.1, 0.9, 0.9]), (0, 0, [0.5, 0.2, 0.1]), (0, 2, [0.0, 1.0, 0.5]), (1, 2, [0.0, 0.1, 0.2])]
    got = {r.Day: r for r in ev.macro_prf_by_step(frame(rows, "step int, y int, s array<double>"), "y", "s", "step").collect()}
    want = brute([1, 0, 2], [1, 0, 1], "macro")
    assert (got[1].Accuracy, got[1].Precision, got[1].Recall, got[1].F1_Score) == pytest.approx((2 / 3, *want))
    assert got[2].F1_Score == 1.0
