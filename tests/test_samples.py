import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.operators import forecasting as fc, samples as sm, scaling
from paneltide.operators.panel import session_axis
from paneltide.operators.reports import sorted_rows
from paneltide.timeline import row_index

SESSIONS = [d.date() for d in pd.bdate_range("2020-01-01", periods=100)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(SESSIONS[i], float(i), 2.0 * i) for i in range(60)], "date date, SR double, feature double")


@pytest.fixture(scope="module")
def axis(spark):
    return session_axis(spark.createDataFrame([(d,) for d in SESSIONS[:60]], "date date"))


def prepare(data, axis, lead=5, lags=3, **kw):
    return sm.prepare_samples(data, axis, "SR", ["feature"], lead, lags, **kw)


def test_terminal_labels_and_embargo(data, axis):
    rows = prepare(data, axis).collect()
    assert {r.fit_end for r in rows} == {42}
    assert all(r.target_i == r.i + 5 and r.target == float(r.target_i) for r in rows)
    assert all(r.target_i < 42 for r in rows if r.split == "train")
    assert all(r.i >= 41 for r in rows if r.split == "test")
    assert not {r.i for r in rows} & set(range(37, 41))
    assert all([w[0] for w in r.window] == [r.i - 2, r.i - 1, r.i] and [w[1] for w in r.window] == [2 * (r.i - 2), 2 * (r.i - 1), 2 * r.i] for r in rows)


def test_lead_counts_sessions_and_gapped_history_is_skipped(data, axis):
    rows = {r.origin_date: r for r in prepare(data.where(f"date <> '{SESSIONS[44]}'"), axis).collect()}
    assert rows[SESSIONS[41]].target_date == SESSIONS[46]
    assert SESSIONS[45] not in rows and SESSIONS[46] not in rows
    assert SESSIONS[39] not in rows  # its label, session 44, is missing


def test_unknown_day_is_an_error(data, axis):
    extra = data.unionByName(data.limit(1).withColumn("date", F.lit("2031-01-01").cast("date")))
    with pytest.raises(Exception, match="absent from the trading calendar"):
        prepare(extra, axis).collect()
    assert sm.unknown_dates(extra, axis).count() == 1


def test_blocks_do_not_change_samples(data, axis):
    rows = sm.calendar_position(row_index(data, "date", total="n"), axis)
    whole = {r.pos: r.window for r in sm.lookback_windows(rows, ["SR"], 7).collect()}
    cut = {r.pos: r.window for r in sm.lookback_windows(rows, ["SR"], 7, block_rows=8).collect()}
    assert whole == cut and len(whole) == 54


def test_three_way_split_with_gaps(spark):
    frame = spark.createDataFrame([(SESSIONS[i], 2.0 * i, 100.0 + i) for i in range(100)], "date date, feature double, target double")
    axis = session_axis(frame)
    kw = dict(lead=5, lags=4, ways=3)
    rows = sm.prepare_samples(frame, axis, "target", ["feature"], **kw).collect()
    assert all(r.target == 100 + r.target_i and r.target_i == r.i + 5 for r in rows)
    assert all(r.split == ("train" if r.target_i < 70 else "val" if r.target_i < 80 else "test") for r in rows)
    assert min(r.i for r in rows if r.split == "val") >= 69 and min(r.i for r in rows if r.split == "test") >= 79
    gone = [str(SESSIONS[i]) for i in (20, 23, 31)]
    gapped = {r.origin_date: r.target_date for r in sm.prepare_samples(frame.where(~F.col("date").cast("string").isin(gone)), axis, "target", ["feature"], **kw).collect()}
    place = {d: i for i, d in enumerate(SESSIONS)}
    assert all(place[t] - place[o] == 5 for o, t in gapped.items())
    assert SESSIONS[18] not in gapped and gapped[SESSIONS[19]] == SESSIONS[24]


def test_decoder_input(data, axis):
    row = prepare(data, axis).withColumn("y", sm.decoder_input("window", 2, 2, F.col("target"))).where("i = 10").first()
    assert row.y == [[9.0, 18.0], [10.0, 20.0], [0.0, 15.0]]


def test_future_extremes_leave_scalers_alone(data):
    def stats(frame):
        rows = row_index(frame, "date", total="n").where(F.col("i") < sm.share(F.col("n"), 0.7))
        return tuple(scaling.fit_scaler(rows, ["SR", "feature"]).first())

    changed = data.select("date", *[F.when(F.col("SR") >= 42, 1e9).otherwise(F.col(c)).alias(c) for c in ("SR", "feature")])
    assert stats(data) == stats(changed) == (0.0, 41.0, 0.0, 82.0)


def test_scaler_variants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert tuple(scaling.fit_scaler(df, ["a", "b"], "standard").first()) == (2.0, 1.0, 5.0, 1.0)
    assert scaling.fit_scaler(df, ["b"], zero_range="null").first()["b__scale"] is None
    back = scaling.attach(df, scaling.fit_scaler(df, ["a"])).select(scaling.restored(scaling.transformed("a"), "a")).collect()
    assert [r[0] for r in back] == [1.0, 3.0]
    with pytest.raises(ValueError):
        scaling.fit_scaler(df, ["a"], "robust")


def test_split_borders(spark):
    df = spark.range(90).select(F.col("id").alias("i"), F.lit(90).cast("long").alias("n"))
    got = sm.chrono_split(df, 5).groupBy("segment").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert {r.segment: (r.a, r.b) for r in got} == {"train": (0, 61), "val": (57, 71), "test": (67, 89)}  # int(90 * .7) is 62
    fixed = sm.fixed_split(df, 2, 3).groupBy("segment").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert {r.segment: (r.a, r.b) for r in fixed} == {"train": (0, 35), "val": (34, 47), "test": (46, 59)}


def test_sliding_sample_count(data):
    rows = sm.sliding_samples(row_index(data, "date"), "SR", 6, 3, 2, block_rows=8).collect()
    assert len(rows) == 60 - 6 - 2 + 1
    first = min(rows, key=lambda r: r["sample"])
    assert first.x == [0, 1, 2, 3, 4, 5] and first.y == [3, 4, 5, 6, 7]


def test_future_stamps(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 4),), (dt.date(2024, 1, 5),)], "date date")
    made = lambda f, d=df: [r.date for r in sm.future_stamps(d, f, 1, 3).where("generated").orderBy("date").collect()]
    assert made("d") == [dt.date(2024, 1, 6), dt.date(2024, 1, 7), dt.date(2024, 1, 8)]
    assert made("b") == [dt.date(2024, 1, 8), dt.date(2024, 1, 9), dt.date(2024, 1, 10)]
    stamps = spark.createDataFrame([(dt.datetime(2024, 1, 5, 23, 45),)], "date timestamp_ntz")
    assert made("15min", stamps) == [dt.datetime(2024, 1, 6, 0, 0), dt.datetime(2024, 1, 6, 0, 15), dt.datetime(2024, 1, 6, 0, 30)]
    assert made("w") == [dt.date(2024, 1, 14), dt.date(2024, 1, 21), dt.date(2024, 1, 28)]
    assert made("2m") == [dt.date(2024, 3, 31), dt.date(2024, 5, 31), dt.date(2024, 7, 31)]
    assert made("q") == [dt.date(2024, 6, 30), dt.date(2024, 9, 30), dt.date(2024, 12, 31)]
    assert made("y") == [dt.date(2025, 12, 31), dt.date(2026, 12, 31), dt.date(2027, 12, 31)]
    with pytest.raises(ValueError, match="Unsupported frequency"):
        sm.future_stamps(df, "x", 1, 1)


def test_horizons_are_recovered_or_rejected(spark):
    windows = [(SESSIONS[w + h], w, h + 1) for w in range(6) for h in range(3)]
    archive = spark.createDataFrame([(d,) for d, _, _ in windows], "date date")
    assert sorted(tuple(r) for r in sm.recover_horizons(archive, 3).collect()) == sorted(windows)
    disjoint = spark.createDataFrame([(d,) for d in SESSIONS[:6]], "date date")
    for wrong in (archive.where(f"date <> '{SESSIONS[1]}'"), disjoint):
        with pytest.raises(Exception, match="do not fit"):
            sm.recover_horizons(wrong, 3).collect()


@pytest.mark.parametrize("lead, count", [(3, 6), (1, 5), (5, 2)])
def test_horizons_stay_with_their_rows(spark, lead, count):
    windows = sorted((SESSIONS[w + h], w, h + 1) for w in range(count) for h in range(lead))
    rows = [(place, d, f"{w}/{h}") for place, (d, w, h) in enumerate(windows)]
    archive = spark.createDataFrame(rows, "place long, date date, value string").repartition(4)
    got = sm.recover_horizons(archive, lead, place="place")
    assert got.columns == ["place", "date", "value", "window_id", "horizon"]
    assert all(r.value == f"{r.window_id}/{r.horizon}" for r in got.collect()) and got.count() == len(rows)
    if lead > 1:
        order = list(range(len(rows)))
        order[1], order[-1] = order[-1], order[1]
        moved = spark.createDataFrame([(order[p], d, v) for p, d, v in rows], "place long, date date, value string")
        with pytest.raises(Exception, match="do not fit"):
            sm.recover_horizons(moved, lead, place="place").collect()


def test_calendar_window_frames_match_numpy(data, axis):
    flags = {r.date: r.ok for r in sm.contiguous_history(
        sm.calendar_position(data.where(f"date <> '{SESSIONS[30]}'"), axis), 4, out="ok", block_rows=5).collect()}
    kept = [i for i in range(60) if i != 30]
    want = {SESSIONS[i]: k >= 3 and np.array_equal(kept[k - 3:k + 1], range(i - 3, i + 1)) for k, i in enumerate(kept)}
    assert flags == want


def test_every_window_over_rows_is_cut_into_blocks(data, axis):
    plan = prepare(data, axis)._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"\(([^()]*)\) windowspecdefinition\(([^)]*)", plan)
    # Without blocks: the calendar, which has one row per day, and the total of the table with one row per block.
    whole = [(of, spec) for of, spec in specs if "__block" not in spec]
    assert len(specs) > len(whole) and all(re.match(r"date#\d+ ASC", spec) or of.startswith("__rows") for of, spec in whole)
    assert "Cartesian" not in plan and "Cross" not in plan


def test_parameters_reach_the_rows_without_moving_them(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS k", "cast(id AS double) AS v", "if(id = 5, NULL, 'x') AS text")
    stats = scaling.fit_scaler(rows, ["v"], "standard", ["k"])
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    plan = scaling.scale(rows, stats, ["v"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    made = fc.ar1_forecast(rows.withColumn("x", F.col("v")), spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 1.0), (2, 3.0, 0.0)], "k long, intercept double, slope double"), 2, ["k"])
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 1000


def test_rows_are_numbered_in_the_order_of_their_keys(spark):
    rows = spark.range(500).selectExpr("id", "id * 7919 % 500 AS a", "if(id % 9 = 0, NULL, id % 4) AS b").repartition(6, F.rand(3))
    got = sorted_rows(rows, ["b", "a"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(500))
    assert [(r.b, r.a) for r in got] == sorted(((r.b, r.a) for r in got), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    assert sorted_rows(rows.limit(0), ["a"]).count() == 0
