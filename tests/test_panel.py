import datetime as dt

import pytest
from pyspark.sql import functions as F

from paneltide.functions import signals
from paneltide.operators import panel, posts
from paneltide.operators.posts import sentiment_for
from paneltide.schema import SENTIMENT_RAW

D = [dt.date(2020, 1, d) for d in range(1, 6)]


def test_credit_spread_sign_and_carry_forward(frame):
    days = frame([(d,) for d in D[:3]], "date date")
    yields = frame([(D[0], 3.0, 4.5, 1.0, 2.0), (D[2], 4.0, 3.5, 1.0, 2.0)],
                   f"date date, `{signals.GOV_10Y}` double, `{signals.CORP_AAA_10Y}` double, `{signals.GOV_3M}` double, `{signals.GOV_6M}` double")
    interbank = frame([(d, 2.0) for d in D[:3]], f"date date, `{signals.INTERBANK_3M}` double")
    market = frame([(d, 0.2, 0.01) for d in D[:3]], "date date, Volatility double, Log_Return double")
    rows = panel.macro_features(days, [yields, interbank, market]).orderBy("date").collect()
    assert [r.CS for r in rows] == [1.5, 1.5, -0.5]
    assert [r.LS for r in rows] == [1.0, 1.0, 1.0]
    assert [(r.VIX, r.Market_Return) for r in rows] == [(0.2, 0.01)] * 3


def test_releases_outside_the_frame_are_lost_and_nothing_is_filled_back(frame):
    days = frame([(D[0],), (D[2],), (D[4],)], "date date")
    source = frame([(D[1], 7.0), (D[2], 1.0)], "date date, s double")
    assert [r.s for r in panel.carry_forward(days, [source]).orderBy("date").collect()] == [None, 1.0, 1.0]


def test_weighted_average_asymmetry(frame):
    mapping = frame([(0, "a"), (1, "b"), (2, "unseen")], "bank_code long, bank string")
    values = frame([(D[0], "a", 1.0), (D[0], "b", 2.0), (D[1], "a", 4.0), (D[1], "b", None), (D[2], "a", None), (D[2], "b", None),
                    (D[3], "a", 5.0), (D[3], "b", 7.0), (D[4], "a", 1.0), (D[4], "other", 99.0)], "date date, bank string, v double")
    caps = frame([(D[0], "a", 1.0), (D[0], "b", 3.0), (D[1], "a", 2.0), (D[1], "b", 2.0), (D[2], "a", None), (D[2], "b", 1.0),
                  (D[3], "a", 0.0), (D[3], "b", None), (D[4], "a", 5.0), (D[0], "other", 9.0), (D[3], "other", 9.0)],
                 "date date, bank string, cap double")
    got = {r.date: r.w for r in panel.cap_weighted_average(values, caps, mapping, {"w": "v"}).collect()}
    assert got[D[0]] is None                      # no lagged weight yet
    assert got[D[1]] == pytest.approx(4 * 1 / 4)  # the missing value keeps its weight below the line
    assert got[D[2]] == 0.0                       # all values missing
    assert got[D[3]] == pytest.approx(7.0)        # weight of a missing
    assert got[D[4]] is None                      # weights sum to zero


def test_lag_uses_panel_sessions_not_rows_of_the_bank(frame):
    rows = frame([(D[0], "a", 1.0), (D[1], "b", 5.0), (D[2], "a", 3.0)], "date date, bank string, cap double")
    got = {(r.date, r.bank): r.lagged for r in panel.lag_panel(rows, "cap", "lagged").collect()}
    assert got[(D[1], "a")] == 1.0 and got[(D[2], "a")] is None and got[(D[2], "b")] == 5.0


def test_entities(frame):
    mapping = frame([(0, "a", 0), (1, "b", 1)], "bank_code long, bank string, ord long")
    assert [r.bank for r in panel.select_entities(mapping, ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="Unknown entities: \\['z'\\]"):
        panel.select_entities(mapping, ["b", "z"], strict=True)
    assert [r.bank for r in panel.select_entities(mapping, ["b", "z"]).collect()] == ["b"]
    other = frame([("q",)], "bank string")
    with pytest.raises(ValueError, match="no mapped entity"):
        panel.common_entities(mapping, other, other, strict=True)


def test_sentiment_of_one_and_all(frame):
    stats = frame([(0, D[0], *[1] * 11), (1, D[0], *[2] * 11)], "bank_code long, pub_day date, " + ", ".join(f"{c} long" for c in SENTIMENT_RAW))
    mapping = frame([(0, "a"), (1, "b")], "bank_code long, bank string")
    assert sentiment_for(stats, mapping, "b").first().Total_Count == 6
    assert sentiment_for(stats, mapping, "all").first().Total_Count == 9
    with pytest.raises(ValueError, match="no entity"):
        sentiment_for(stats, mapping, "zz")


def test_panel_plans_have_no_cartesian_product(frame):
    mapping = frame([(0, "a")], "bank_code long, bank string")
    rows = frame([(D[0], "a", 1.0, 1.0)], "date date, bank string, v double, cap double")
    plan = panel.cap_weighted_average(rows, rows, mapping, {"w": "v"})._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_weighted_tables_equal_one_at_a_time(frame):
    mapping = frame([(0, "a"), (1, "b"), (2, "c")], "bank_code long, bank string")
    caps = frame([(d, b, float(1 + i + 2 * j)) for i, d in enumerate(D) for j, b in enumerate("abc")], "date date, bank string, cap double")
    first = frame([(d, b, float(i * j)) for i, d in enumerate(D) for j, b in enumerate("ab") if (i + j) % 3], "date date, bank string, v double")
    second = frame([(d, "c", float(i)) for i, d in enumerate(D[:3])] + [(D[0], "zz", 4.0)], "date date, bank string, w double")
    both = {r.date: (r.x, r.y) for r in panel.cap_weighted_tables([(first, {"x": "v"}), (second, {"y": "w"})], caps, mapping).collect()}
    one = {r.date: r.x for r in panel.cap_weighted_average(first, caps, mapping, {"x": "v"}).collect()}
    two = {r.date: r.y for r in panel.cap_weighted_average(second, caps, mapping, {"y": "w"}).collect()}
    assert both == {d: (one.get(d), two.get(d)) for d in set(one) | set(two)}


def test_statistics_are_merged_over_all_keys(frame):
    a = frame([(1, 5), (2, 6), (None, 7)], "k int, x int")
    b = frame([(2, 1), (3, 2), (None, None)], "k int, y int")
    got = posts.merge_stats([a, b], ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 5, 0), (2, 6, 1), (3, 0, 2), (None, 7, 0)], key=str)
    with pytest.raises(ValueError, match="named twice"):
        posts.merge_stats([a, a], ["k"])
    with pytest.raises(Exception, match="repeated"):
        posts.merge_stats([a, b.union(b)], ["k"]).collect()
