"""File-to-file runs of the stages."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from paneltide.functions import signals
from paneltide.plans import datasets, label_split
from paneltide.schema import SENTIMENT_RAW
from paneltide.sources.records import read_instructions

DAYS = [dt.date(2020, 1, d) for d in (1, 2, 3, 6, 7)]


@pytest.fixture(scope="module")
def config(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")

    def table(name, header, rows):
        (root / name).write_text("\n".join([",".join(header), *[",".join(map(str, r)) for r in rows]]) + "\n", encoding="utf-8-sig")
        return str(root / name)

    def wide(name, date, factor, suffix=""):
        return table(name, [date, f"甲{suffix}", f"乙{suffix}", f"丙{suffix}"], [[d, factor * (i + 1), factor * 10 * (i + 1), factor] for i, d in enumerate(DAYS)])

    names = ["总市值(元)", "市盈率", "市净率", "市销率", "市现率"]
    stacked = [["date"] + ["g"] * 10, ["date"] + ["甲"] * 5 + ["乙"] * 5, ["date"] + names * 2]
    body = [[d] + [100 * (i + 1), 1, 2, 3, 4] + [300, 5, 6, 7, 8] for i, d in enumerate(DAYS)]
    (root / "price.csv").write_text("\n".join(",".join(map(str, r)) for r in stacked + body) + "\n", encoding="utf-8")
    stats = spark.createDataFrame([(5, d, *[k + 1] * 11) for k, d in enumerate(DAYS[1:4])] + [(6, DAYS[1], *[7] * 11)],
                                  "bank_code long, pub_day date, " + ", ".join(f"{c} long" for c in SENTIMENT_RAW))
    stats.write.parquet(str(root / "stats"))
    return {
        "bank_mapping_csv": table("map.csv", ["bank_code", "bank"], [[5, "甲"], [6, "乙"]]), "price_csv": str(root / "price.csv"),
        "covar_csv": wide("covar.csv", "date", -0.01, "_CoVaR"), "connectedness_from_csv": wide("from.csv", "date_suffix", 1.0),
        "connectedness_to_csv": wide("to.csv", "date_suffix", 2.0), "connectedness_net_csv": wide("net.csv", "date_suffix", 3.0),
        "macro_csv": table("macro.csv", ["date", signals.GOV_3M, signals.GOV_6M, signals.GOV_10Y, signals.CORP_AAA_10Y], [[DAYS[0], 1, 2, 3, 4.5], [DAYS[3], 1, 2, 4, 3.5]]),
        "credit_csv": table("credit.csv", ["date", signals.INTERBANK_3M], [[d, 2.0] for d in DAYS]),
        "volatility_csv": table("vol.csv", ["date", "Volatility", "Log_Return"], [[d, 0.2, 0.01] for d in DAYS]),
        "final_stats": str(root / "stats"), "output_dir": str(root / "out"),
    }


def test_datasets_from_files(spark, config):
    out = spark.read.parquet(datasets.run(spark, config))
    sizes = {(r.bank, r.variant): r["count"] for r in out.groupBy("bank", "variant").count().collect()}
    assert sizes == {("甲", "without"): 5, ("乙", "without"): 5, ("甲", "with"): 3, ("乙", "with"): 1, ("ALL", "without"): 4, ("ALL", "with"): 3,
                     ("ALL", "legacy_without"): 4, ("ALL", "legacy_with"): 3}
    one = {r.date: r for r in out.where("bank = '甲' and variant = 'without'").collect()}
    assert one[DAYS[2]].target == pytest.approx(3.0) and one[DAYS[2]].CS == 1.5 and one[DAYS[3]].CS == -0.5
    assert (one[DAYS[0]]["市盈率"], one[DAYS[0]].risk_spillover) == (1.0, 2.0)
    # Day 2 of the system: weights are the market values of day 1, the unmapped entity stays out.
    system = {r.date: r for r in out.where("bank = 'ALL' and variant = 'without'").collect()}
    assert DAYS[0] not in system
    assert system[DAYS[1]].target == pytest.approx((2.0 * 100 + 20.0 * 300) / 400)
    assert system[DAYS[1]]["市现率"] == pytest.approx((4 * 100 + 8 * 300) / 400)
    merged = out.where("bank = 'ALL' and variant = 'with'").orderBy("date").collect()
    assert [r.Total_Count for r in merged] == [3 * 8, 6, 9]


def test_label_split_from_file(spark, tmp_path):
    (tmp_path / "in.csv").write_text("text,sen\n" + "".join(f"t{i},{'正面' if i % 3 else -1}\n" for i in range(60)), encoding="gb18030")
    out = label_split.run(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), fraction=0.2)
    val, train = (read_instructions(spark, out[f"{p}_json"]) for p in ("val", "train"))
    assert (val.count(), train.count()) == (12, 48)
    assert {r.output: r["count"] for r in val.groupBy("output").count().collect()} == {"正面": 8, "负面": 4}
    assert val.join(train, "input").isEmpty()
    half = label_split.run(spark, str(tmp_path / "in.csv"), str(tmp_path / "half"), fraction=0.5, stratify=False)
    assert spark.read.csv(half["val_csv"], header=True).where(F.col("text").startswith("t")).count() == 30
