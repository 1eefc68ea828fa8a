import json

import pytest
from pyspark.sql import functions as F

from paneltide.operators import classify, sampling
from paneltide.plans import daily_sentiment
from paneltide.session import cut_lineage, drop_stage
from paneltide.sources import csv_records, panels, records, tables


@pytest.fixture
def files(tmp_path):
    def write(name, text, encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode(encoding))
        return str(path)

    return write


def test_encodings_are_detected(spark, files):
    text = "名称,v\n工商银行,1\n中国银行,2\n"
    for encoding in ("utf-8", "utf-8-sig", "gb18030", "gbk"):
        path = files(f"{encoding}.csv", text, encoding)
        assert [tuple(r) for r in tables.read_csv_auto(spark, path).orderBy("v").collect()] == [("工商银行", "1"), ("中国银行", "2")]


def test_mixed_files_are_united_by_name(spark, files, tmp_path):
    files("in/a.csv", "bank,v\n工商,1\n", "gbk")
    files("in/b.csv", "v,bank,extra\n2,中国,x\n", "utf-8-sig")
    rows = sorted(tuple(r) for r in tables.merge_prediction_files(spark, f"{tmp_path}/in/*.csv").select("bank", "v", "extra").collect())
    assert rows == [("中国", "2", "x"), ("工商", "1", None)]
    audit = {r.name: r for r in tables.audit_inputs(spark, {"in": f"{tmp_path}/in/*.csv", "gone": f"{tmp_path}/gone/*.csv"}).collect()}
    assert audit["in"].exists and audit["in"].size_bytes > 30 and audit["in"].records == 2 and not audit["gone"].exists
    with pytest.raises(FileNotFoundError):
        tables.merge_prediction_files(spark, f"{tmp_path}/none/*.csv")


def test_written_csv_starts_with_a_byte_order_mark(spark, tmp_path, frame):
    path = tables.write_csv(frame([("a,b", 1), ('q"q', 2)], "name string, v int").coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfname,v")
    assert sorted(r.name for r in tables.read_csv_auto(spark, path).collect()) == ["a,b", 'q"q']


def test_price_panel_with_three_header_rows(spark, files):
    path = files("price.csv", "date,g,g,g,g\ndate,工商,工商,银行金融指数,中国\ndate,总市值(元),市盈率,总市值(元),总市值(元)\n2020-01-01,10,5.5,99,--\n2020/1/2,11,,98,7\n")
    panel = panels.read_price_panel(spark, path)
    caps = panels.without_index_series(panels.select_indicator(panel, "总市值(元)"))
    got = {(str(r.date), r.bank): r.value for r in caps.collect()}
    assert got == {("2020-01-01", "工商"): 10.0, ("2020-01-02", "工商"): 11.0, ("2020-01-01", "中国"): None, ("2020-01-02", "中国"): 7.0}
    assert panels.select_indicator(panel, "市盈率").count() == 2


def test_wide_panels(spark, frame):
    wide = frame([("2020-01-01", "1", "x", "3")], "date_suffix string, a string, b string, other string")
    mapping = frame([(0, "b"), (1, "a")], "bank_code long, bank string")
    assert sorted(tuple(r)[1:] for r in panels.unpivot_panel(wide, "date_suffix", mapping).collect()) == [("a", 1.0), ("b", None)]
    assert panels.select_entity(wide, "date_suffix", "a", "from_a").first().from_a == 1.0
    with pytest.raises(ValueError, match="z not found"):
        panels.select_entity(wide, "date_suffix", "z", "v")


def test_mapping_keeps_file_order(spark, files):
    got = panels.read_mapping(spark, files("map.csv", "bank_code,bank\n5,z\n2,a\n9,m\n")).orderBy("ord").collect()
    assert [(r.bank_code, r.bank) for r in got] == [(5, "z"), (2, "a"), (9, "m")]
    with pytest.raises(ValueError, match="bank_code"):
        panels.read_mapping(spark, files("bad.csv", "code,bank\n1,a\n"))


def test_instruction_files(spark, files, tmp_path, frame):
    array = files("a.json", json.dumps([{"instruction": "i", "input": "x", "output": "正面"}], ensure_ascii=False, indent=2))
    assert tuple(records.read_instructions(spark, [array], multi_line=True).first()) == ("i", "x", "正面")
    df = frame([(i, f"t{i}", "1" if i % 4 else "负面") for i in range(40)], "id long, text string, sen string")
    flagged = sampling.stratified_split(df, "sen", "id", 0.1)
    out = records.write_split(flagged, "text", "sen", "is_val", str(tmp_path / "split"), "judge")
    val, train = (records.read_instructions(spark, out[f"{p}_json"]) for p in ("val", "train"))
    assert (val.count(), train.count()) == (4, 36) and {r.output for r in val.collect()} == {"正面", "负面"}


def test_split_sizes_and_determinism(spark):
    df = spark.range(1005).select("id", F.when(F.col("id") < 1000, "hot").when(F.col("id") < 1004, "few").otherwise("one").alias("y"))
    def chosen(frame):
        return {r.id for r in sampling.stratified_split(frame, "y", "id", 0.25, seed=3).where("is_val").collect()}
    first = chosen(df)
    assert first == chosen(df.repartition(7))
    assert (len([i for i in first if i < 1000]), len([i for i in first if 1000 <= i < 1004]), 1004 in first) == (250, 1, True)
    assert len(first ^ {r.id for r in sampling.stratified_split(df, "y", "id", 0.25, seed=4).where("is_val").collect()}) > 0
    half = spark.range(10).select("id", F.lit("a").alias("y"))
    assert sampling.stratified_split(half, "y", "id", 0.25).where("is_val").count() == 2  # 2.5 rounds to even
    flagged = sampling.random_split(spark.range(50), "id", 0.3)
    rest = sampling.rest_of(spark.range(50), flagged.where("is_val"), "id")
    assert (flagged.count(), flagged.where("is_val").count(), rest.count()) == (50, 15, 35)


def test_split_ranks_inside_the_cut_bucket(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_DIGITS", 1)
    df = spark.range(300).select("id", F.lit("a").alias("y"))
    got = {r.id for r in sampling.stratified_split(df, "y", "id", 0.33).where("is_val").collect()}
    hashes = {r.id: r.h for r in df.select("id", sampling.sample_hash(42, F.col("id")).alias("h")).collect()}
    assert got == set(sorted(hashes, key=hashes.get)[:99])


def test_scoring_carries_columns_and_fills_missing_text(frame):
    class Length:
        def __call__(self, texts):
            return texts.str.len().astype(str)

    rows = classify.score_text(frame([(1, "ab"), (2, None)], "id int, t string"), "t", Length).collect()
    assert [(r.id, r.t, r.Output) for r in rows] == [(1, "ab", "2"), (2, None, "0")]


def test_a_predictor_sees_few_texts_at_a_time(frame):
    class Seen:
        def __call__(self, texts):
            return texts.map(lambda t: f"{len(texts)} {texts.str.len().sum()} {t[:1]}")

    rows = [(i, "a") for i in range(1500)] + [(i, "b" * 700_000) for i in range(1500, 1504)] + [(1504, None)]
    found = classify.score_text(frame(rows, "id int, t string").coalesce(1), "t", Seen).select("id", "Output").collect()
    assert sorted(r.id for r in found) == list(range(1505))
    assert all(r.Output.split(" ")[2] == ("a" if r.id < 1500 else "b" if r.id < 1504 else "") for r in found)
    assert max(int(r.Output.split(" ")[0]) for r in found) == classify.SLICE_ROWS and max(int(r.Output.split(" ")[1]) for r in found) <= classify.SLICE_BYTES


def test_scored_texts_do_not_pile_up(frame):
    class Alive:
        def __init__(self):
            import weakref

            self.given, self.ref = [], weakref.ref

        def __call__(self, texts):
            texts.str.len()  # the accessor is kept on the Series and refers to it
            self.given = [g for g in self.given if g() is not None] + [self.ref(texts)]
            return texts.map(lambda t: str(len(self.given)))

    rows = [(i, "b" * 600_000) for i in range(30)]
    found = classify.score_text(frame(rows, "id int, t string").coalesce(1), "t", Alive).select("id", "Output").collect()
    assert len(found) == 30 and max(int(r.Output) for r in found) == 1


def test_scored_texts_do_not_pile_up_beside_many_objects(frame):
    class Tokens:
        def __init__(self):
            import gc
            import weakref

            self.given, self.ref, self.frozen = [], weakref.ref, gc.get_freeze_count()

        def __call__(self, texts):
            spans = [(at, at + 1) for at in range(60_000)]  # so many that Python takes the Series for an old object meanwhile
            texts.str.len()
            spans += [(at, at + 1) for at in range(60_000)]
            self.given = [g for g in self.given if g() is not None] + [self.ref(texts)]
            return texts.map(lambda t: f"{len(self.given)} {len(spans)} {self.frozen}")

    rows = [(i, "b" * 600_000) for i in range(30)]
    for _ in range(2):  # the second time in a worker that has scored before
        found = classify.score_text(frame(rows, "id int, t string").coalesce(1), "t", Tokens).select("id", "Output").collect()
        assert sorted(r.id for r in found) == list(range(30)) and {r.Output for r in found} == {"1 120000 0"}


def test_scoring_goes_on_where_it_ended(spark, frame, tmp_path):
    log = tmp_path / "log"

    class Length:
        def __call__(self, texts):
            with open(log, "a") as seen:
                seen.writelines(f"{t}\n" for t in texts)
            return texts.str.len().astype(str)

    path = str(tmp_path / "ledger")
    first = frame([(1, "ab"), (2, None), (3, "ab"), (4, "")], "id int, t string")
    ledger = classify.score_new_texts(first, "t", Length, path)
    assert sorted(r.Output for r in ledger.collect()) == ["0", "2"] and sorted(log.read_text().split("\n")[:-1]) == ["", "ab"]
    grown = first.unionByName(frame([(5, "abc"), (6, "ab")], "id int, t string"))
    with pytest.raises(Exception, match="no score"):
        classify.scores_to_rows(grown, "t", ledger).collect()
    ledger = classify.score_new_texts(grown, "t", Length, path)
    assert sorted(log.read_text().split("\n")[:-1]) == ["", "ab", "abc"]  # the second run scored the new text alone
    rows = classify.scores_to_rows(grown, "t", ledger).orderBy("id").collect()
    assert [(r.id, r.t, r.Output) for r in rows] == [(1, "ab", "2"), (2, None, "0"), (3, "ab", "2"), (4, "", "0"), (5, "abc", "3"), (6, "ab", "2")]
    assert classify.score_new_texts(grown.limit(0), "t", Length, path).count() == 3


def test_stage_run(spark, files, tmp_path):
    files("p/a.csv", "pub_date,bank_code,predict,read_num,comments_num\n2024-01-01,1,正面,1万,2\n2024-01-01,1,-1,3,\n")
    assert daily_sentiment.run(spark, f"{tmp_path}/p/*.csv", "", "audit").count() == 1
    row = daily_sentiment.run(spark, f"{tmp_path}/p/*.csv", str(tmp_path / "out")).first()
    assert daily_sentiment.run(spark, f"{tmp_path}/p/*.csv", str(tmp_path / "known"), encoding="UTF-8").first() == row
    assert (row.Positive_read_num, row.Negative_read_num, row.Positive_comments_num, row.comments_num) == (10000, 3, 2, 2)


def test_cut_lineage(spark):
    import os

    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3
    folder = os.path.dirname(kept.inputFiles()[0]).removeprefix("file://")
    drop_stage(kept)
    assert not os.path.exists(folder)


def test_quoted_line_breaks_survive(spark, tmp_path, frame):
    rows = [(1, "a\nb", "正面"), (2, "plain", "负面"), (3, ' "q",\r\n\\x ', None), (4, None, "中性"), (5, None, "x")]
    path = tables.write_csv(frame(rows, "id int, text string, label string").coalesce(1), str(tmp_path / "broken"))
    back = tables.read_csv_auto(spark, path)
    assert sorted((int(r.id), r.text, r.label) for r in back.collect()) == rows
    assert sorted((int(r.id), r.text, r.label) for r in tables.read_csv_auto(spark, path, encoding="UTF-8").collect()) == rows


def test_header_with_a_line_break(spark, files):
    got = tables.read_csv_auto(spark, [files("h/a.csv", 'id,"long\nname"\n1,x\n', "gbk"), files("h/b.csv", '"long\nname",id\ny,2\n')])
    assert sorted(tuple(r) for r in got.select("id", "`long\nname`").collect()) == [("1", "x"), ("2", "y")]


def test_split_files_must_have_the_declared_width(spark, files):
    schema = "a string, b string"
    good, bad = files("w/good.csv", "a,b\n1,2\n"), files("w/bad.csv", "a,b\n1,2\n3\n")
    assert tables.read_csv_auto(spark, good, schema=schema, encoding="UTF-8", one_line=True).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_csv_auto(spark, bad, schema=schema, encoding="UTF-8", one_line=True).collect()


def torn_file(end, n=60):
    """Cells with breaks, quotes and commas, some longer than a byte range, and blank lines."""
    rows = [(str(i), [f"工商银行 {i}", f"a\nb {i}", f'say "{i}", ok{end}next', "q", "long\n" * (i % 40) + "."][i % 5], "x" * (i % 7) or None) for i in range(n)]
    quoted = [(a, b.replace('"', '""'), c or "") for a, b, c in rows]
    return f"id,text,tail{end}" + "".join(f'{a},"{b}",{c}{end}' + (end if a.endswith("9") else "") for a, b, c in quoted), rows


@pytest.mark.parametrize("encoding, end", [("utf-8-sig", "\r\n"), ("gb18030", "\n")])
def test_one_file_is_read_by_many_tasks(spark, files, encoding, end):
    text, rows = torn_file(end)
    path = files("torn/a.csv", text, encoding)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    if end == "\n":  # Spark's own reader would make Windows line ends inside of cells plain ones
        whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
        assert sorted(map(tuple, whole.collect()), key=lambda r: int(r[0])) == rows
    for size in ("100", "700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size != "128m" else "4m")
        try:
            found = csv_records.CsvRecords(spark, path)
            assert found.torn == (size != "128m") and found.ranges.count() > (5 if size != "128m" else 0)
            got = found.cells(numbered="at").orderBy("at").collect()
            shuffled = csv_records.CsvRecords(spark, path, broadcast_ranges=0)
            assert not shuffled.few and shuffled.cells(numbered="at").orderBy("at").collect() == got
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [tuple(r) for r in got] == [(*r, i) for i, r in enumerate(rows)]


def test_open_quotes_and_odd_headers(spark, files):
    path = files("odd/a.csv", 'id,,id\n1,2,"open to\nthe end\n')
    assert [tuple(r) for r in tables.read_csv_auto(spark, path).collect()] == [("1", "2", "open to\nthe end")]
    assert tables.read_csv_auto(spark, path).columns == ["id0", "_c1", "id2"]
    with pytest.raises(ValueError, match="No encoding"):
        tables.read_csv_auto(spark, files("odd/b.csv", "银行,b\n1,2\n", "gb18030"), encoding="UTF-8")
    with pytest.raises(ValueError, match="header"):
        tables.read_csv_auto(spark, path, schema="a int, b int")
    assert tables.read_csv_auto(spark, files("odd/c.csv", "a,b\n1,x\n"), schema="a int, b string").first() == (1, "x")


def test_many_files_reach_the_driver_as_layouts(spark, files, tmp_path):
    for i in range(60):
        files(f"many/{i:02d}.csv", ["id,bank\n{},工商\n", "bank,id\n工商,{}\n"][i % 2].format(i), ["utf-8", "gb18030", "utf-8-sig"][i % 3])
    found = csv_records.CsvRecords(spark, f"{tmp_path}/many/*.csv")
    assert len(found.layouts) == 4 and found.layouts[0].names == ["id", "bank"]
    rows = found.cells(numbered="at").orderBy("at").select("at", "id", "bank").collect()
    assert [tuple(r) for r in rows] == [(i, str(i), "工商") for i in range(60)]


def test_unreadable_dates_stop_the_panel(spark, files):
    head = "date,g\ndate,a\ndate,总市值(元)\n"
    assert panels.read_price_panel(spark, files("d/a.csv", head + "2020-01-01,1\n,2\n")).count() == 1
    with pytest.raises(Exception, match="unreadable date soon"):
        panels.read_price_panel(spark, files("d/b.csv", head + "soon,1\n")).collect()


def test_unreadable_dates_stop_a_daily_table(spark, files):
    from paneltide.plans.datasets import read_daily_series

    assert [r.v for r in read_daily_series(spark, files("e/a.csv", "day,v\n2020/1/2,1\n,5\n20200103,x\n")).orderBy("date").collect()] == [1.0, None]
    with pytest.raises(Exception, match="unreadable date soon"):
        read_daily_series(spark, files("e/b.csv", "day,v\nsoon,1\n")).collect()


def test_mapping_and_prices_in_gb18030_over_two_files(spark, files, tmp_path):
    files("m/a.csv", "bank_code,bank\n5,工商银行\n2,中国银行\n", "gb18030")
    files("m/b.csv", "bank_code,bank\n9,建设银行\n", "gb18030")
    got = panels.read_mapping(spark, f"{tmp_path}/m/*.csv").orderBy("ord").collect()
    assert [(r.bank_code, r.bank, r.ord) for r in got] == [(5, "工商银行", 0), (2, "中国银行", 1), (9, "建设银行", 2)]
    path = files("price.csv", "date,g,g\ndate,工商银行,中国银行\ndate,总市值(元),总市值(元)\n2020-01-01,10,5.5\n", "gb18030")
    assert {(r.bank, r.value) for r in panels.select_indicator(panels.read_price_panel(spark, path), "总市值(元)").collect()} == {("工商银行", 10.0), ("中国银行", 5.5)}


def test_rows_without_label_or_key_stay_in_training(frame):
    df = frame([(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, None, "x"), (None, "a", "x")], "id int, y string, text string")
    for split in (sampling.stratified_split(df, "y", "id", 0.5), sampling.random_split(df, "id", 0.5)):
        rows = split.collect()
        assert len(rows) == 5 and not any(r.is_val for r in rows if r.id is None)
    assert sum(r.is_val for r in sampling.stratified_split(df, "y", "id", 0.5).collect()) == 1
    assert not any(r.is_val for r in sampling.stratified_split(df, "y", "id", 0.5).collect() if r.y is None)


def test_splits_do_not_move_the_text(frame):
    df = frame([(i, "ab"[i % 2], "text") for i in range(50)], "id int, y string, text string")
    plan = sampling.stratified_split(df, "y", "id", 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "hashpartitioning" not in plan


def test_label_split_ignores_partitioning(spark, files, tmp_path):
    from paneltide.plans import label_split

    lines = [f'"text {i % 30}\n more",{(i % 30) % 3 - 1}' for i in range(60)]
    one = files("s1/a.csv", "text,sen\n" + "\n".join(lines) + "\n")
    two = [files("s2/a.csv", "text,sen\n" + "\n".join(lines[30:]) + "\n"), files("s2/b.csv", "text,sen\n" + "\n".join(lines[:30]) + "\n")]
    picked = []
    for k, path in enumerate((one, two)):
        out = label_split.run(spark, path, str(tmp_path / f"out{k}"))
        picked.append(sorted(r.input for r in records.read_instructions(spark, out["val_json"]).collect()))
    assert picked[0] == picked[1] and len(picked[0]) == 6
