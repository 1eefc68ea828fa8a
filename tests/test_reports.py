import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.functions import reporting
from paneltide.operators import evaluation as ev, grid, reports as rp

# Published archive values of two report inputs: model, MSE, MAE.
ONE_DAY = [("baseline", 0.000394631861546777, 0.014601044035714283), ("Persistence", 0.00046014415969336346, 0.01622150674991531),
           ("AR1", 0.0004578688766074574, 0.01623142751718592), ("ETS_ANN", 0.0004601447763037068, 0.0162215171530965),
           ("GradientBoostingRegressor", 0.00043806780914026005, 0.01566870830204571), ("PatchTST", 0.0007585480546408339, 0.02037605353422619)]
FIVE_DAY = [("baseline", 0.0018081031416674583, 0.03196474785650887), ("Persistence", 0.002167062467026328, 0.0334592912001546),
            ("AR1", 0.0021075872494044894, 0.033490928168583865), ("ETS_ANN", 0.0021670633873736604, 0.03345929780405472),
            ("GradientBoostingRegressor", 0.002060798339589701, 0.03534458675137249), ("PatchTST", 0.0026512977409333424, 0.03727848190828403)]


@pytest.mark.parametrize("rows, mse, mae, scale", [(ONE_DAY, "9.92%", "6.81%", 1e4), (FIVE_DAY, "12.26%", "4.47%", 1e3)])
def test_improvement_over_best_comparator(frame, rows, mse, mae, scale):
    metrics = frame(rows, "model string, MSE double, MAE double")
    out = rp.best_comparator_improvement(metrics, "baseline", [m for m, *_ in rows[1:]]).withColumn("text", reporting.fixed(F.col("improvement"), 2, suffix="%"))
    got = {r.metric: (r.text, r.best_model) for r in out.collect()}
    assert got == {"MSE": (mse, "GradientBoostingRegressor"), "MAE": (mae, "GradientBoostingRegressor" if scale == 1e4 else "Persistence")}


def test_comparison_table_text(frame):
    table = rp.comparison_table(frame(ONE_DAY, "model string, MSE double, MAE double"), [m for m, *_ in ONE_DAY])
    row = {r.metric: r for r in table.select("metric", *[reporting.fixed(F.col(m), 2, 1e4).alias(m) for m, *_ in ONE_DAY]).collect()}
    assert list(row["MSE"])[1:] == ["3.95", "4.60", "4.58", "4.60", "4.38", "7.59"]


def test_published_comparison(frame):
    got = {r.line: list(r)[1:] for r in rp.published_comparison(frame(ONE_DAY, "model string, MSE double, MAE double"), [m for m, *_ in ONE_DAY], ONE_DAY[0][0]).collect()}
    assert got["MSE"][0] == "3.95e-04" and got["MSE"][-1].endswith("%")
    best = min(x[1] for x in ONE_DAY[1:])
    assert float(got["MSE"][-1][:-1]) == pytest.approx((best - ONE_DAY[0][1]) / best * 100, abs=0.006)


def test_published_tests_need_both_criteria(frame):
    table = frame([("MAD", "M", 10, -2.5, 0.02), ("MSE", "M", 10, 1.0, 0.5)], "criterion string, model string, n long, statistic double, p_value double")
    rows = rp.published_tests({"one": table, "five": table}, ["M"]).collect()
    assert sorted(tuple(r) for r in rows) == [("five", "MAE", "-2.500**"), ("five", "MSE", "1.000"), ("one", "MAE", "-2.500**"), ("one", "MSE", "1.000")]
    with pytest.raises(Exception, match="a criterion has no row"):
        rp.published_tests({"one": table.where("criterion = 'MAD'")}, ["M"]).collect()


def test_bank_block_reduction_and_repair(frame):
    rows = [("中信银行", "不带情绪", 0.0006723716, 0.014447476, 0.025930129), ("中信银行", "带情绪", 0.0005054099, 0.016243925, 0.022481324),
            ("南京银行", "不带情绪", 0.0, 0.14511016, 0.1968773), ("南京银行", "带情绪", 0.026532704, 0.115248874, 0.16288863)]
    df = frame([(*r, 0.5, "test") for r in rows], "bank string, spec string, MSE double, MAE double, RMSE double, R2 double, split string")
    df = rp.recoded(rp.recoded(df, "bank", rp.BANK_CODES, strict=True), "spec", rp.SPEC_NAMES)
    df = df.withColumn("MSE", reporting.repaired_mse(F.col("MSE"), F.col("RMSE")))
    saved = rp.error_reduction(df, base="without sentiment", other="with sentiment").where("spec = 'reduction'")
    got = {r.bank: (r.a, r.b) for r in saved.select("bank", reporting.fixed(F.col("MSE"), 2, 100, "%").alias("a"), reporting.fixed(F.col("MAE"), 2, 100, "%").alias("b")).collect()}
    assert got == {"CNCB": ("24.83%", "-12.43%"), "BON": ("31.55%", "20.58%")}


def test_reduction_without_base(frame):
    df = frame([("a", "with", 1.0, 1.0, 1.0, 0.1, "test"), ("b", "without", 0.0, 2.0, 0.0, 0.1, "test"), ("b", "with", 1.0, 1.0, 1.0, 0.1, "test"),
                ("b", "with", 9.0, 9.0, 9.0, 0.1, "train")], "bank string, spec string, MSE double, MAE double, RMSE double, R2 double, split string")
    got = {r.bank: (r.MSE, r.MAE) for r in rp.error_reduction(df).where("spec = 'reduction'").collect()}
    assert got.get("a", (None, None)) == (None, None) and got["b"] == (None, 0.5)


def test_extremes_mix_runs(frame):
    df = frame([("a", "without", 1.0, 9.0, 0.3, "test"), ("a", "without", 2.0, 8.0, 0.4, "test"), ("a", "with", 1.0, 9.0, 0.3, "test"), ("a", "with", 2.0, 8.0, 0.4, "test")],
               "bank string, spec string, MSE double, MAE double, R2 double, split string")
    got = {r.spec: (r.MSE, r.MAE, r.R2) for r in rp.extreme_metrics(df, values=["MSE", "MAE", "R2"]).collect()}
    assert got == {"without": (2.0, 9.0, 0.3), "with": (1.0, 8.0, 0.4)}


def test_fixed_rounds_the_stored_number(frame):
    cases = [9.915, 0.125, 0.375, 2.675, 1.005, -0.125, -0.001, 0.0, 1234567.895, 26.25, 1e-9, 99.995]
    df = frame([(c,) for c in cases] + [(None,)], "v double").select(reporting.fixed(F.col("v"), 2))
    assert [r[0] for r in df.collect()] == [f"{c:.2f}" for c in cases] + [""]
    rng = np.random.default_rng(0)
    many = [float(x) for x in np.round(rng.uniform(-50, 50, 500), 3)]
    assert [r[0] for r in frame([(c,) for c in many], "v double").select(reporting.fixed(F.col("v"), 2)).collect()] == [f"{c:.2f}" for c in many]


def test_stars_and_blanks(frame):
    p = [.005, .01, .03, .05, .07, .10, .2, None]
    got = frame([(x, None if x == .2 else 0.1) for x in p], "p double, r double").select(reporting.stars(F.col("p")), reporting.starred(F.col("r"), F.col("p"))).collect()
    assert [g[0] for g in got] == ["***", "**", "**", "*", "*", "", "", ""]
    assert got[0][1] == "0.100***" and got[6][1] == ""
    assert frame([("-2.627 ***",)], "s string").select(reporting.squeeze(F.col("s"))).first()[0] == "-2.627***"


def test_lagged_correlation(frame):
    rng = np.random.default_rng(2)
    risk, mood = rng.normal(size=30), rng.normal(size=30)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(risk[i]), None if i == 4 else float(mood[i]), 1.0) for i in range(30)]
    df = frame(rows, "date date, risk double, mood double, flat double")
    got = {r.lagged_variable: r for r in rp.with_correlation_p(rp.lagged_correlation(df, ["risk"], ["mood", "flat"], 1)).collect()}
    keep = [i for i in range(1, 30) if i - 1 != 4]
    want = np.corrcoef(risk[keep], mood[[i - 1 for i in keep]])[0, 1]
    assert (got["mood_lag1"].n, got["mood_lag1"].correlation) == (28, pytest.approx(want))
    assert got["flat_lag1"].correlation is None and got["flat_lag1"].p_value is None
    assert 0 < got["mood_lag1"].p_value < 1


def test_quantiles_with_heavy_ties_and_tails(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([np.full(700, 3.0), rng.lognormal(3, 4, 1299), [1e15]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    probabilities = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for most in (65_536, 40, 1):  # with the small ones the intervals are cut again and again
        got = {r.p: r.q for r in rp.exact_quantiles(df, "v", probabilities, most).collect()}
        for p in probabilities:
            assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert rp.exact_quantiles(df.where("v < 0"), "v").count() == 0
    odd = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, float("inf"), None, float("nan"))], "v double")
    assert {r.p: r.q for r in rp.exact_quantiles(odd, "v", [0, 0.5, 1.0], 1).collect() if r.p == 0.5} == {0.5: 1.0}


def test_quartile_classes_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "v double")
    assert [(r.v, r.risk) for r in rp.quantile_bin(df, "v").orderBy("v").collect()] == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]


def test_monthly_means_keep_empty_months(frame):
    df = frame([(dt.date(2024, 1, 5), 1.0), (dt.date(2024, 1, 31), 3.0), (dt.date(2024, 3, 1), 5.0)], "date date, v double")
    assert [(r.month, r.v) for r in rp.monthly_means(df, ["v"]).orderBy("month").collect()] == [
        (dt.date(2024, 1, 31), 2.0), (dt.date(2024, 2, 29), None), (dt.date(2024, 3, 31), 5.0)]


def test_orders(frame):
    df = frame([("b", 1.0), ("a", 2.0)], "m string, v double")
    order = frame([("a", 0), ("z", 1), ("b", 2)], "m string, ord int")
    assert [tuple(r) for r in rp.fixed_order(df, "m", order).orderBy("ord").collect()] == [(0, "a", 2.0), (1, "z", None), (2, "b", 1.0)]
    seen = frame([(0, "q"), (1, "p"), (2, "q")], "i int, k string")
    assert [r.k for r in rp.first_seen_order(seen, "k", "i").orderBy("first_row").collect()] == ["q", "p"]
    tie = frame([("g", "y", 1.0), ("g", "x", 1.0), ("g", "n", None)], "g string, m string, v double")
    assert tuple(rp.best_model(tie, ["g"], "m", "v").first()) == ("g", "x", 1.0)


def test_grid(spark, frame):
    config = {"common_args": {"d_model": 1024, "seq_len": 1}, "jobs": [
        {"name": "agg", "target_scope": "aggregate", "training_times": 2, "data": "direct", "data_path": "ALL.csv", "predict_col": "ALL_CoVaR",
         "description": "h1_{iteration}", "args": {"seq_len": 5, "lead": 1}},
        {"name": "banks", "target_scope": "banks", "training_times": 3, "variants": [
            {"name": "w", "sentiment_label": "with sentiment", "data": "custom", "data_path": "{bank}_w.csv", "predict_col": "{bank}_CoVaR", "description": "{bank}_{iteration}",
             "args": {"seq_len": 7}}]}]}
    mapping = frame([(0, "A"), (1, "B")], "bank_code long, bank string")
    runs = grid.experiment_grid(grid.job_table(spark, config), mapping).withColumn("setting", grid.setting_name())
    rows = runs.collect()
    assert len(rows) == 2 + 2 * 3
    names = {(r.bank, r.iteration): r.setting for r in rows}
    assert names[("ALL", 2)] == ("informer_direct_ftMS_sl5_ll2_pl1_dm1024_nh8_el2_dl1_df2048_atprob_fc5_ebtimeF_dtTrue_mxTrue_pathALL.csv_h1_2_1_lead1")
    assert names[("B", 3)].startswith("informer_custom_ftMS_sl7_") and names[("B", 3)].endswith("_pathB_w.csv_B_3_1")
    metrics = frame([(names[("A", 1)], 0.5), ("unknown", 1.0)], "setting string, MSE double")
    done = grid.collect_metrics(runs, metrics).collect()
    assert [(r.bank, r.spec, r.iteration, r.MSE) for r in done] == [("A", "with sentiment", 1, 0.5)]


def test_run_metrics_are_found_by_folder(spark, tmp_path):
    for run in ("run_a", "run_b"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.csv").write_text(f"split,MSE\ntest,{len(run)}.5\n", encoding="utf-8")
    got = {r.setting: r.MSE for r in grid.read_run_metrics(spark, str(tmp_path), "split string, MSE double").collect()}
    assert got == {"run_a": 5.5, "run_b": 5.5}


def test_descriptive_statistics(frame):
    got = rp.descriptive_stats(frame([("1",), ("3",), ("x",), (None,)], "v string"), ["v"]).first()
    assert tuple(got) == ("v", 2.0, pytest.approx(np.std([1, 3], ddof=1)), 1.0, 3.0)


def test_correlation_matrix_and_labels(frame):
    table = frame([("ICBC", "s", 0.108, 0.001), ("Sector", "s", -0.018, 0.5)], "sample string, lagged_variable string, r double, p double")
    row = rp.correlation_matrix(table, ["ICBC", "Sector"], reporting.starred(F.col("r"), F.col("p"))).first()
    assert tuple(row) == ("s", "0.108***", "-0.018")
    assert ev.label_metrics(frame([("AR1",), ("other",)], "model string")).collect()[0].model == "AR(1)"
