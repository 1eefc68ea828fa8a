import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.operators import archive as arch, boosting, forecasting as fc
from paneltide.operators.panel import session_axis
from paneltide.operators.samples import prepare_samples
from paneltide.plans import comparison

SESSIONS = [d.date() for d in pd.bdate_range("2020-01-01", periods=60)]
PROVENANCE = "direct_terminal_target"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(SESSIONS[i], float(i), 2.0 * i) for i in range(60)], "date date, SR double, feature double")


@pytest.fixture(scope="module")
def axis(data):
    return session_axis(data)


@pytest.fixture(scope="module")
def archive(spark, data, axis):
    test = prepare_samples(data, axis, "SR", [], 5, 3, windows=False).where("split = 'test'")
    rows = test.select("origin_date", F.col("target_date").alias("date"), F.lit(5).alias("lead"), F.col("target").alias("actual_SR"),
                       (F.col("target") + 0.25).alias("predicted_SR"), F.lit("direct").alias("forecast_mode")).collect()
    return spark.createDataFrame(rows, "origin_date date, date date, lead int, actual_SR double, predicted_SR double, forecast_mode string")


def load(archive, data, axis, lead=5, provenance=PROVENANCE):
    return arch.load_archive(archive, data, axis, lead, "SR", provenance)


def noisy(spark, n=150, key=None, seed=5):
    rng = np.random.default_rng(seed)
    values = np.cumsum(rng.normal(size=n)) + rng.normal(size=n) * 2
    rows = [(*([key] if key else []), dt.date(2020, 1, 1) + dt.timedelta(days=i), float(values[i])) for i in range(n)]
    return values, spark.createDataFrame(rows, ("k string, " if key else "") + "date date, v double")


def levels(values, alpha):
    out = [values[0]]
    for x in values[1:]:
        out.append(alpha * x + (1 - alpha) * out[-1])
    return np.array(out)


def test_ar1_matches_least_squares(spark):
    values, df = noisy(spark)
    got = fc.fit_ar1(fc.training_rows(df, "v"), "v").first()
    train = values[:105]
    want = np.linalg.lstsq(np.column_stack([np.ones(104), train[:-1]]), train[1:], rcond=None)[0]
    assert (got.intercept, got.slope) == pytest.approx(tuple(want))
    sample = spark.createDataFrame([(3.0,)], "x double")
    made = fc.ar1_forecast(sample, spark.createDataFrame([(1.0, 0.5)], "intercept double, slope double"), 3).first().AR1_pred
    assert made == pytest.approx(1 + 0.5 * (1 + 0.5 * (1 + 0.5 * 3)))


def test_ar1_of_a_constant_series(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), 2.0) for i in range(20)], "date date, v double")
    got = fc.fit_ar1(fc.training_rows(df, "v"), "v").first()
    want = np.linalg.lstsq(np.column_stack([np.ones(13), np.full(13, 2.0)]), np.full(13, 2.0), rcond=None)[0]
    assert (got.intercept, got.slope) == pytest.approx(tuple(want))


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_ets_weight_against_brute_force(spark, block_rows):
    values, df = noisy(spark, key="a")
    other_values, other = noisy(spark, 90, "b", seed=9)
    rows = fc.training_rows(df.unionByName(other), "v", ["k"])
    got = {r.k: r.alpha for r in fc.fit_ets(rows, "v", ["k"], block_rows=block_rows).collect()}
    for key, series in (("a", values[:105]), ("b", other_values[:int(90 * .7)])):
        grid = np.linspace(1e-6, 1 - 1e-6, 20001)
        level, sse = np.full(grid.size, series[0]), np.zeros(grid.size)
        for x in series[1:]:
            sse += (x - level) ** 2
            level = grid * x + (1 - grid) * level
        assert got[key] == pytest.approx(grid[np.argmin(sse)], abs=1e-4)


@pytest.mark.parametrize("block_rows, fan", [(2, 2), (3, 5), (50, 256)])
def test_squared_errors_compose_in_a_tree(spark, block_rows, fan):
    values, df = noisy(spark, 61, "a")
    rows = fc.training_rows(df, "v", ["k"], 0.999)
    weights = spark.createDataFrame([("a", w) for w in (0.05, 0.3, 0.9)], "k string, alpha double")
    grid = weights.groupBy("k").agg(F.collect_list(F.struct("alpha", F.lit(0.0).alias("step"))).alias("candidates"))
    got = {r.alpha: r.sse for r in fc._chained_sse(fc._value_blocks(rows.where("i < fit_end"), "v", ["k"], block_rows), grid, ["k"], fan).collect()}
    for w in (0.05, 0.3, 0.9):
        path = levels(values[:60], w)
        assert got[w] == pytest.approx(float(np.sum((values[1:60] - path[:-1]) ** 2)), rel=1e-9)


@pytest.mark.parametrize("block_rows", [6, 4096])
def test_ets_levels(spark, block_rows):
    values, df = noisy(spark, 40)
    rows = fc.training_rows(df, "v")
    got = fc.ets_levels(rows, spark.createDataFrame([(0.3,)], "alpha double"), "v", block_rows=block_rows).orderBy("i").collect()
    assert [r.level for r in got] == pytest.approx(levels(values, 0.3).tolist())


def test_ets_assimilates_skipped_origins(data, axis):
    gapped = data.where(f"date <> '{SESSIONS[44]}'")
    samples = prepare_samples(gapped, axis, "SR", [], 5, 3, windows=False).where("split = 'test'")
    made = fc.ets_forecast(samples, fc.training_rows(gapped, "SR"), "SR", alpha=0.5).collect()
    path = levels([float(i) for i in range(60) if i != 44], 0.5)
    assert made and all(r.ETS_pred == pytest.approx(path[r.i]) for r in made)
    assert all(r.Persistence_pred == r.x for r in fc.persistence(samples).collect())


def test_archive_conventions(archive, data, axis):
    assert load(archive, data, axis).columns == ["origin_date", "date", "lead", "TRUE", "Informer_pred"]
    other = archive.withColumnsRenamed({"origin_date": "origin", "date": "target_date", "lead": "horizon", "actual_SR": "true", "predicted_SR": "pred"})
    other = other.withColumn("forecast_mode", F.lit("direct_terminal_target"))
    assert load(other, data, axis).count() == archive.count() == load(archive, data, axis).count()


@pytest.mark.parametrize("missing", ["forecast_mode", "origin_date", "lead"])
def test_archive_needs_its_metadata(archive, data, axis, missing):
    with pytest.raises(ValueError):
        load(archive.drop(missing), data, axis)


@pytest.mark.parametrize("column, value, rule", [
    ("lead", 1, "lead_matches"), ("forecast_mode", "joint", "forecast_mode"), ("target_mode", "joint", "target_mode"),
    ("provenance", "legacy", "provenance"), ("actual_SR", -100.0, "actual_matches_data"), ("predicted_SR", float("inf"), "finite_values"),
    ("target_date", "2020-01-01", "date_alias_conflict"), ("origin", "2020-01-01", "origin_on_calendar")])
def test_archive_conflicts(archive, data, axis, column, value, rule):
    base = {"target_mode": F.lit(PROVENANCE), "provenance": F.lit(PROVENANCE), "target_date": F.col("date").cast("string"), "origin": F.col("origin_date").cast("string")}
    first = F.col("date") == archive.agg({"date": "min"}).first()[0]
    altered = archive.withColumn(column, F.when(first, F.lit(value)).otherwise(base.get(column, F.col(column) if column in archive.columns else None)))
    with pytest.raises(ValueError, match=rule):
        load(altered, data, axis)


def test_archive_duplicates_provenance_and_empty(archive, data, axis):
    with pytest.raises(ValueError, match="unique_origin"):
        load(archive.unionByName(archive.limit(1)), data, axis)
    with pytest.raises(ValueError, match="provenance"):
        load(archive, data, axis, provenance="legacy_joint")
    with pytest.raises(ValueError, match="not_empty"):
        load(archive.limit(0), data, axis)


def run(archive, data, axis, models, **kw):
    return comparison.run_comparison(data, archive, axis, "SR", 5, 3, models, provenance=PROVENANCE, **kw)


def test_comparison_layout(archive, data, axis):
    out = run(archive, data, axis, ["Persistence", "AR(1)", "ETS"], ets_alpha=0.5)
    assert out.columns == ["origin_date", "date", "target_date", "lead", "horizon", "forecast_mode", "TRUE", "Informer_pred", "Persistence_pred", "AR1_pred", "ETS_pred"]
    rows = out.collect()
    assert len(rows) == archive.count() and all(r.date == r.target_date and r.horizon == 5 and r.forecast_mode == "direct" for r in rows)
    assert all(r.Persistence_pred == r["TRUE"] - 5 and r.AR1_pred == pytest.approx(r["TRUE"]) for r in rows)
    metrics, tests = comparison.evaluate(run(archive, data, axis, []).withColumn("Naive_pred", F.col("TRUE") + F.dayofmonth("date") / 7))
    assert {r.model for r in metrics.collect()} == {"Informer", "Naive"} and tests.count() == 2


def test_comparison_rejections(archive, data, axis):
    for models in (["LSTM"], ["ETS", "ETS"]):
        with pytest.raises(ValueError):
            run(archive, data, axis, models)
    first = F.col("date") == archive.agg({"date": "min"}).first()[0]
    early = archive.withColumns({
        "origin_date": F.when(first, F.lit(SESSIONS[10])).otherwise(F.col("origin_date")), "date": F.when(first, F.lit(SESSIONS[15])).otherwise(F.col("date")),
        "actual_SR": F.when(first, 15.0).otherwise(F.col("actual_SR"))})
    with pytest.raises(ValueError, match="no test sample covers"):
        run(early, data, axis, ["GBR"])


def test_gradient_boosting_smoke(data, axis):
    samples = prepare_samples(data, axis, "SR", ["feature"], 5, 3)
    made = comparison.forecasts(data, samples, "SR", ["feature"], 5, ["GBR"], settings={"GBR": {"n_estimators": 3, "max_depth": 2}})
    rows = made.collect()
    assert len(rows) == 14 and all(0 <= r.GBR_pred <= 60 for r in rows)


def slow_boost(x, y, train, rounds, rate, depth, bins):
    """Exhaustive search over bins, in units of 2**-30."""
    unit = 1 << 30
    low, high = x[train].min(0), x[train].max(0)
    codes = np.clip(np.floor((x - low) / np.where(high > low, (high - low) / bins, np.inf)), 0, bins - 1).astype(int)
    whole = np.round(y * unit).astype(np.int64)
    made = np.full(len(y), round(int(whole[train].sum()) / int(train.sum())), np.int64)
    for _ in range(rounds):
        residual, node, value = whole - made, np.ones(len(y), int), np.zeros(len(y), np.int64)
        for _ in range(depth):
            for k in set(node[train]):
                here = node == k
                best = None
                for f in range(x.shape[1]):
                    for cut in range(bins - 1):
                        left, right = here & train & (codes[:, f] <= cut), here & train & (codes[:, f] > cut)
                        if not left.any() or not right.any() or not (left & (codes[:, f] == cut)).any():
                            continue
                        ls, rs, ln, rn = float(residual[left].sum()), float(residual[right].sum()), left.sum(), right.sum()
                        gain = ls * ls / ln + rs * rs / rn - (ls + rs) ** 2 / (ln + rn)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, cut, round(rate * ls / ln), round(rate * rs / rn))
                if best:
                    right = here & (codes[:, best[1]] > best[2])
                    value[here], node[here] = best[3], 2 * k
                    value[right], node[right] = best[4], 2 * k + 1
        made = made + value
    return made / unit


def test_boosting_equals_exhaustive_search_in_every_series(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for key, n in (("a", 60), ("b", 35), (None, 20)):
        x = np.round(rng.normal(size=(n, 3)), 3)
        x[:, 2] = 1.0  # a constant feature is never cut
        y = np.round(np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) + rng.normal(size=n) * 0.1, 4)
        train = np.arange(n) < n * 0.7
        rows += [(key, i, x[i].tolist(), float(y[i]), bool(train[i])) for i in range(n)]
        expected |= {(key, i): p for i, p in enumerate(slow_boost(x, y, train, 4, 0.5, 2, 8))}
    df = spark.createDataFrame(rows, "k string, i int, x array<double>, y double, train boolean").repartition(5)
    got = {(r.k, r.i): r.p for r in boosting.boosted(df, "x", "y", "train", "p", ["k"], rounds=4, rate=0.5, depth=2, bins=8).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-8) for k in got)
    alone = boosting.boosted(df.where("k = 'b'"), "x", "y", "train", "p", rounds=4, rate=0.5, depth=2, bins=8).collect()
    assert {("b", r.i): r.p for r in alone} == {k: v for k, v in got.items() if k[0] == "b"}
    with pytest.raises(ValueError, match="rounds"):
        boosting.boosted(df, "x", "y", "train", "p", rounds=0)


def test_many_series_in_one_comparison(spark, data, archive, axis):
    models, settings = ["Persistence", "AR(1)", "ETS", "GBR"], {"GBR": {"n_estimators": 3, "max_depth": 2}}
    scaled = lambda df, columns, key, by: df.select(F.lit(key).alias("bank"), *[(F.col(c) * by).alias(c) if c in columns else F.col(c) for c in df.columns])
    values = ["SR", "feature"]
    both = scaled(data, values, "x", 1.0).union(scaled(data, values, "y", -2.0))
    numbers = ["actual_SR", "predicted_SR"]
    archives = scaled(archive, numbers, "x", 1.0).union(scaled(archive, numbers, "y", -2.0))
    out = run(archives, both, axis, models, settings=settings, series=["bank"])
    for key, by in (("x", 1.0), ("y", -2.0)):
        alone = run(scaled(archive, numbers, key, by).drop("bank"), scaled(data, values, key, by).drop("bank"), axis, models, settings=settings)
        assert sorted(map(tuple, out.where(f"bank = '{key}'").drop("bank").collect())) == sorted(map(tuple, alone.collect()))
    with pytest.raises(ValueError, match="unique_origin"):
        load_many(archives.union(archives.where("bank = 'x'").limit(1)), both, axis)
    metrics, tests = comparison.evaluate(out.withColumn("ETS_pred", F.col("ETS_pred") + F.dayofmonth("date") / 7), series=["bank"])
    assert metrics.count() == 10 and tests.count() == 16


def load_many(archive, data, axis):
    return arch.load_archive(archive, data, axis, 5, "SR", PROVENANCE, ["bank"])


def test_merge_one_to_one(frame):
    left = frame([(1,), (2,)], "k int")
    ok = frame([(1, 0.5), (2, 0.6), (3, 0.7)], "k int, p double")
    assert sorted(tuple(r) for r in arch.merge_one_to_one(left, ok, ["k"], "p", "M").collect()) == [(1, 0.5), (2, 0.6)]
    with pytest.raises(Exception, match="no forecast of M for 2"):
        arch.merge_one_to_one(left, ok.where("k <> 2"), ["k"], "p", "M").collect()
    with pytest.raises(Exception, match="two forecasts of M for 1"):
        arch.merge_one_to_one(left, ok.unionByName(ok.limit(1)), ["k"], "p", "M").collect()
    assert arch.merge_report(left, ok.where("k <> 2"), ["k"]).first().problem == "unmatched"


def test_export_frame(frame):
    made = fc.direct_result_frame(frame([(dt.date(2020, 1, 2), dt.date(2020, 1, 9), 4.0, 2.0), (dt.date(2020, 1, 1), dt.date(2020, 1, 8), 3.0, 1.0)],
                                        "origin_date date, target_date date, actual double, pred double"), 5).orderBy("target_date", "origin").collect()
    assert [(r.pred, r.actual, r.horizon, r.lead, r.forecast_mode) for r in made] == [(1.0, 3.0, 5, 5, "direct"), (2.0, 4.0, 5, 5, "direct")]
    again = frame([(dt.date(2020, 1, 2), dt.date(2020, 1, 2), 4.0, 2.0)], "origin_date date, target_date date, actual double, pred double")
    with pytest.raises(Exception, match="repeated or not before"):
        fc.direct_result_frame(again, 5).collect()
    joint = again.withColumn("scaled", F.array(F.lit(1.0)))
    with pytest.raises(ValueError, match="single number"):
        fc.prediction_frame(joint, "scaled", "v", 5, "GBR_pred")


def test_forecasting_data_checks(frame):
    good = frame([("2020-01-02", "1", "x", 2.0), ("2020-01-01", "3", "y", 4.0)], "d string, t string, note string, f double")
    assert arch.read_forecasting_data(good, "d", "t", ["f", "note", "f"]).columns == ["d", "t", "f"]
    for bad, what in ((good.unionByName(good), "a date of its own"), (good.withColumn("t", F.when(F.col("f") > 2, F.col("t"))), "gaps or text"),
                      (good.withColumn("t", F.lit("Infinity")), "infinite")):
        with pytest.raises(ValueError, match=what):
            arch.read_forecasting_data(bad, "d", "t")
    with pytest.raises(ValueError, match="Missing columns"):
        arch.read_forecasting_data(good, "d", "t", ["absent"])


def test_evaluation_input_checks(frame):
    good = frame([(dt.date(2020, 1, 1), 1.0, 1.0, 2.0), (dt.date(2020, 1, 2), 1.0, 1.0, 2.0)], "date date, TRUE double, a_pred double, b_pred double")
    assert arch.validated(good, "TRUE", "a_pred")[1] == ["a_pred", "b_pred"]
    with pytest.raises(ValueError, match="duplicate_dates"):
        arch.validated(good.withColumn("date", F.lit(dt.date(2020, 1, 1))), "TRUE", "a_pred")
    with pytest.raises(ValueError, match="nonfinite_b_pred"):
        arch.validated(good.withColumn("b_pred", F.lit(float("nan"))), "TRUE", "a_pred")
    with pytest.raises(ValueError, match="nothing to compare"):
        arch.validated(good.drop("b_pred"), "TRUE", "a_pred")
