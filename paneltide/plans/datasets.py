"""All forecasting datasets in one long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.signals import scaled
from ..functions.text import to_day
from ..operators.panel import assemble_entity_panel, cap_weighted_tables, macro_features, merge_sentiment
from ..operators.posts import entity_sentiment, sentiment_for
from ..schema import MARKET_CAP, SENTIMENT_FEATURES, VALUATION, number_or_null, rows_complete, required
from ..session import cut_lineage
from ..sources.panels import read_mapping, read_price_panel, select_indicator, unpivot_panel, without_index_series
from ..sources.tables import read_csv_auto


def forecasting_datasets(target: DataFrame, predictors: Sequence[DataFrame], caps: DataFrame, mapping: DataFrame,
                         sentiment_stats: DataFrame, macro_sources: Sequence[DataFrame], scale: float = -100.0,
                         macro_names: Mapping[str, str] | None = None, legacy: bool = True) -> DataFrame:
    """Every entity and the system, each without and with sentiment; ``variant`` tells them apart.

    ``target`` is ``(date, bank, target)``, ``caps`` is ``(date, bank, cap)``, predictor tables are long by
    ``(date, bank)`` with any number of value columns. Entities share one plan instead of one job each; system rows
    carry ``bank = 'ALL'``, and ``legacy_*`` variants hold the target only. The three inputs several variants share,
    one row per day or per bank and day, are written to the shared folder once.
    """
    macro = cut_lineage(macro_features(target.select("date").distinct(), macro_sources, macro_names), "macro")
    stats = cut_lineage(sentiment_stats, "sentiment")
    owned = [[c for c in table.columns if c not in ("date", "bank")] for table in predictors]
    names = [c for own in owned for c in own]
    tables = [(target.withColumn("target", scaled(F.col("target"), scale)), {"target": "target"}), *[(t, {c: c for c in own}) for t, own in zip(predictors, owned)]]
    days = target.select("date").distinct()
    weighted = cut_lineage(cap_weighted_tables(tables, caps, mapping).join(days, "date", "left_semi"), "weighted")

    known = target.join(mapping.select("bank"), "bank", "left_semi")
    entity = assemble_entity_panel(known, predictors, macro, "target", scale)
    system = rows_complete(weighted.join(macro, "date", "left")).withColumn("bank", F.lit("ALL"))
    by_entity, overall = entity_sentiment(stats, mapping), sentiment_for(stats, mapping, "ALL")
    parts = [
        ("without", entity), ("with", merge_sentiment(entity, by_entity, ["date", "bank"])),
        ("without", system), ("with", merge_sentiment(system, overall)),
    ]
    if legacy:
        target_only = rows_complete(weighted.select("date", "target")).withColumn("bank", F.lit("ALL"))
        parts += [("legacy_without", target_only), ("legacy_with", merge_sentiment(target_only, overall))]
    columns = ["date", "target", *names, *[c for c in macro.columns if c != "date"], *SENTIMENT_FEATURES]
    return reduce(lambda a, b: a.unionByName(b), [
        part.select(F.lit(variant).alias("variant"), "bank", *[
            F.col(f"`{c}`") if c in part.columns else F.lit(None).cast("double").alias(c) for c in columns])
        for variant, part in parts])


def read_daily_series(spark: SparkSession, path: str) -> DataFrame:
    """Daily table whose first column is the date and whose other columns are numbers. A row without a date is dropped, one whose
    date cannot be read stops the job."""
    raw = read_csv_auto(spark, path)
    first, *values = raw.columns
    dated = raw.where(F.trim(f"`{first}`") != "")
    day = required(to_day(f"`{first}`"), F.concat(F.lit(f"{path}: unreadable date "), F.col(f"`{first}`")))
    return dated.select(day.alias("date"), *[number_or_null(raw, c).alias(c) for c in values])


def read_wide(spark: SparkSession, path: str, value: str, suffix: str = "") -> DataFrame:
    """Wide daily panel, one column per entity, as ``(date, bank, value)``."""
    wide = read_daily_series(spark, path)
    return unpivot_panel(wide, "date", value=value, suffix=suffix)


def run(spark: SparkSession, config: Mapping[str, object]) -> str:
    """Build all datasets from the files a configuration names and write them, partitioned by bank and variant."""
    mapping = read_mapping(spark, config["bank_mapping_csv"])
    prices = cut_lineage(without_index_series(read_price_panel(spark, config["price_csv"])), "prices")  # read for five indicators
    caps = select_indicator(prices, MARKET_CAP).withColumnRenamed("value", "cap")
    links = {"risk_receiving": "connectedness_from_csv", "risk_spillover": "connectedness_to_csv", "net_risk_value": "connectedness_net_csv"}
    predictors = [read_wide(spark, config[key], name) for name, key in links.items()]
    predictors += [select_indicator(prices, name).withColumnRenamed("value", name) for name in VALUATION]
    stats = spark.read.parquet(config["final_stats"])
    macro = [read_daily_series(spark, config[key]) for key in ("macro_csv", "credit_csv", "volatility_csv")]
    made = forecasting_datasets(read_wide(spark, config["covar_csv"], "target", "_CoVaR"), predictors, caps, mapping, stats, macro,
                                float(config.get("target_scale", -100.0)), legacy=bool(config.get("build_legacy_system", True)))
    return write_datasets(made, config["output_dir"])


def write_datasets(datasets: DataFrame, path: str) -> str:
    """Partitioned by bank and variant, so a model job reads its own series only.

    The rebalance hint gathers each bank's rows into few files and still splits a bank that holds most of them.
    """
    datasets.hint("rebalance", "bank", "variant").write.mode("overwrite").partitionBy("bank", "variant").parquet(path)
    return path
