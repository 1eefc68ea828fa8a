"""Blocked order operations equal their plain counterparts, also when blocks are far smaller than a series."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide import timeline as tl


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    rows = []
    for key, size in (("hot", 180), ("b", 7), ("c", 1)):
        days = sorted(rng.choice(400, size, replace=False))
        for d in days:
            rows.append((key, dt.date(2020, 1, 1) + dt.timedelta(days=int(d)), None if rng.random() < 0.4 else float(rng.integers(100))))
    return pd.DataFrame(rows, columns=["k", "date", "v"])


@pytest.fixture(scope="module")
def df(spark, series):
    return spark.createDataFrame(series.astype(object).where(series.notna(), None).values.tolist(), "k string, date date, v double").repartition(3)


def pandas_of(frame):
    out = frame.toPandas().sort_values(["k", "date"]).reset_index(drop=True)
    return out


@pytest.mark.parametrize("days", [5, 64, 100000])
def test_row_index(df, series, days):
    got = pandas_of(tl.row_index(df, "date", ["k"], "i", "n", block=tl.day_block("date", days)))
    want = series.sort_values(["k", "date"]).reset_index(drop=True)
    assert got.i.tolist() == want.groupby("k").cumcount().tolist()
    assert got.n.tolist() == want.groupby("k").date.transform("size").tolist()


@pytest.mark.parametrize("days", [3, 100000])
def test_forward_fill(df, series, days):
    got = pandas_of(tl.forward_fill(df, ["v"], "date", ["k"], block=tl.day_block("date", days)))
    want = series.sort_values(["k", "date"]).reset_index(drop=True)
    want["v"] = want.groupby("k").v.ffill()
    pd.testing.assert_series_equal(got.v, want.v)


@pytest.mark.parametrize("k", [1, 4, -2])
def test_shift_rows(df, series, k):
    indexed = tl.row_index(df, "date", ["k"])
    got = pandas_of(tl.shift_rows(indexed, {"s": "v"}, k, "i", ["k"], block_rows=4))
    want = series.sort_values(["k", "date"]).reset_index(drop=True)
    pd.testing.assert_series_equal(got.s, want.groupby("k").v.shift(k), check_names=False)


def test_running_total(df, series):
    filled = df.fillna(0.0)
    got = pandas_of(tl.running_total(filled, "v", "date", tl.day_block("date", 10), "t", ["k"]))
    want = series.fillna(0.0).sort_values(["k", "date"]).reset_index(drop=True)
    assert got.t.tolist() == want.groupby("k").v.cumsum().tolist()


def test_no_series_key(spark):
    df = spark.range(50).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("v"))
    got = tl.row_index(df, "date", block=tl.day_block("date", 7)).where("i <> v").count()
    assert got == 0


def test_null_series_keep_their_rows_and_null_dates_stop(frame):
    import datetime as dt

    import pytest

    from paneltide import timeline
    from paneltide.operators.scaling import standardize

    D = [dt.date(2024, 1, k) for k in (1, 2, 3)]
    df = frame([(None, D[0], 1.0), (None, D[1], None), ("a", D[0], 2.0), ("a", D[2], None)], "s string, date date, v double")
    assert sorted((str(r.s), r.i) for r in timeline.row_index(df, "date", ["s"]).collect()) == [("None", 0), ("None", 1), ("a", 0), ("a", 1)]
    assert sorted(r.v for r in timeline.forward_fill(df, ["v"], "date", ["s"]).collect()) == [1.0, 1.0, 2.0, 2.0]
    assert standardize(df, ["v"], ["s"]).count() == 4
    with pytest.raises(Exception, match="NULL in the order column"):
        timeline.row_index(df.withColumn("date", df.date.cast("string").cast("date")).unionByName(frame([("a", None, 1.0)], "s string, date date, v double")), "date", ["s"]).collect()
