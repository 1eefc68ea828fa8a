import datetime as dt

import pytest
from pyspark.sql import functions as F

from paneltide.functions import calendar, text
from paneltide.operators import posts
from paneltide.schema import drop_unnamed, numeric_columns, require_columns
from paneltide.sources import records


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def one_column(frame, items, kind="string"):
    return frame([(i,) for i in items], f"v {kind}")


def test_parse_count_edges(frame):
    cases = {None: 0, "": 0, "nan": 0, "--": 0, "None": 0, "1,234": 1234, "1.13万": 11299, "2亿": 200000000, "3万亿": 300000000,
             "56+": 56, "约12.9次": 12, "abc": 0, "-7.9": -7, " 8 ": 8, "１２３": 123}
    df = one_column(frame, list(cases))
    assert values(df, text.parse_count("v")) == list(cases.values())


def test_parse_count_of_numbers(frame):
    df = one_column(frame, [7.9, -7.9, None, float("nan")], "double")
    assert values(df, text.parse_count("v", numeric=True)) == [7, -7, 0, 0]


def test_normalize_label(frame):
    cases = {" Positive ": 1, "+1": 1, "负面": -1, "1.0": 1, "0.5": 0, "-0.9": 0, "NEUTRAL": 0, "-1e0": -1}
    assert values(one_column(frame, list(cases)), text.normalize_label("v")) == list(cases.values())
    assert values(one_column(frame, ["2", None, "good", "1.0d", "inf"]), text.normalize_label("v", on_bad="null")) == [None] * 5


@pytest.mark.parametrize("bad", ["2", None, "good"])
def test_bad_label_stops_the_job(frame, bad):
    with pytest.raises(Exception, match="not a label"):
        one_column(frame, ["1", bad]).select(text.normalize_label("v")).collect()


def test_response_priority(frame):
    df = one_column(frame, ["正面，不，负面", "是正面", "中性", "positive"])
    assert values(df, text.parse_response("v")) == [-1, 1, 0, 1]
    unclear = one_column(frame, ["no idea", None])
    assert values(unclear, text.parse_response("v", default=0)) == [0, 0]
    with pytest.raises(Exception, match="not a label"):
        unclear.select(text.parse_response("v")).collect()


def test_days(frame):
    df = one_column(frame, ["2024-01-05", "2024/1/5", "2024-01-05 10:20:30", "2024/01/05 10:20", "20240105", "soon", None])
    day = dt.date(2024, 1, 5)
    assert values(df, text.to_day("v")) == [day] * 5 + [None, None]


def test_answers(frame):
    df = one_column(frame, ["user\n\nq assistant\n\n 正面 \n", "xassistant\n\n a assistant\n\n b", "none"])
    assert values(df, text.extract_answer("v")) == ["正面", "a", None]
    assert values(df, text.extract_answer("v", "last")) == ["正面", "b", "none"]


def test_prompts(frame):
    rows = frame([("t", "1"), (None, "负面")], "text string, sen string")
    made = records.instruction_records(rows, "text", "sen", "judge").collect()
    assert [tuple(r) for r in made] == [("judge", "t", "正面"), ("judge", "", "负面")]
    pairs = records.chat_pairs(records.instruction_records(rows, "text", "sen", "judge")).collect()
    assert "judge\nt<|eot_id|>" in pairs[0].source and "judge<|eot_id|>" in pairs[1].source
    assert pairs[0].target == "正面<|eot_id|>"


def test_lookup_modes(frame):
    df = one_column(frame, ["a", "z"])
    assert values(df, text.lookup("v", {"a": "b"})) == ["b", "z"]
    assert values(df, text.lookup("v", {"a": "b"}, "null")) == ["b", None]
    with pytest.raises(Exception, match="Unmapped value: z"):
        df.select(text.lookup("v", {"a": "b"}, "raise")).collect()


def test_calendar_features(frame):
    ts = frame([(dt.datetime(2024, 12, 30, 23, 46, 59),)], "t timestamp_ntz")
    assert tuple(ts.select(*calendar.calendar_parts(F.col("t"), "t")).first()) == (12, 30, 0, 23, 3)
    row = ts.select(*calendar.scaled_features(F.col("t"), "S")).first()
    assert row.second == pytest.approx(0.5) and row.hour == pytest.approx(0.5) and row.day_of_week == pytest.approx(-0.5)
    assert row.day_of_year == pytest.approx(364 / 365 - 0.5)
    assert ts.select(*calendar.scaled_features(F.col("t"), "W")).first().week_of_year == pytest.approx(-0.5)
    assert ts.select(*calendar.scaled_features(F.col("t"), "15min")).columns == ["minute", "hour", "day_of_week", "day_of_month", "day_of_year"]
    with pytest.raises(ValueError, match="Unsupported frequency"):
        calendar.scaled_features(F.col("t"), "X")


def test_daily_stats_and_corrections(frame):
    rows = frame([(0, "2024-01-01", 1, "positive", "1.5万", "2"), (1, "bad", 1, "-1", "10", "3"), (2, "2024-01-01", 1, "-1", "--", "1"),
                  (3, "2024-01-01", None, "0", "5", "5")],
                 "k int, pub_date string, bank_code long, predict string, read_num string, comments_num string")
    fixes = frame([(1, "2024-01-01")], "k int, pub_date string")
    stats = posts.daily_sentiment_stats(posts.clean_posts(posts.correct_dates(rows, fixes, "k"))).collect()
    assert len(stats) == 1
    s = stats[0]
    assert (s.Negative_Count, s.Neutral_Count, s.Positive_Count) == (2, 0, 1)
    assert (s.Negative_read_num, s.Positive_read_num, s.read_num, s.Neutral_comments_num, s.comments_num) == (10, 15000, 15010, 0, 6)


def test_custom_column_names_keep_their_values(frame):
    rows = frame([("2024-01-01", 1, "1", "7", "2")], "d string, b long, p string, reads string, c string")
    s = posts.daily_sentiment_stats(posts.clean_posts(rows, "d", "b", "p", "reads", "c")).first()
    assert (s.Positive_read_num, s.read_num, s.comments_num) == (7, 7, 2)


def test_column_checks(frame):
    df = frame([("1", "x")], "a string, b string")
    with pytest.raises(ValueError, match=r"\['c', 'd'\]"):
        require_columns(df, ["a", "d", "c"])
    assert tuple(numeric_columns(df, ["a", "b"]).first()) == (1.0, None)
    assert drop_unnamed(df.withColumnRenamed("b", "Unnamed: 0")).columns == ["a"]
