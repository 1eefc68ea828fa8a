"""Lead-specific model comparison: data and archive to forecasts, metrics and tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.archive import load_archive, merge_one_to_one, read_forecasting_data, require_contained, validated
from ..operators.evaluation import dm_tests, error_metrics, label_metrics, long_predictions
from ..operators.forecasting import (
    ar1_forecast, ets_forecast, fit_ar1, gbr_forecast, output_columns, persistence, training_rows,
)
from ..operators.samples import prepare_samples, require_segments, share
from ..operators.scaling import fit_scaler
from ..session import cut_lineage
from ..timeline import row_index

KEYS = ["origin_date", "date", "lead"]


def simple_forecasts(data: DataFrame, samples: DataFrame, target: str, lead: int, models: Sequence[str],
                     series: Sequence[str] = (), train_ratio: float = 0.7, ets_alpha: float | None = None) -> DataFrame:
    """Test samples with a column for each of the per-series models asked for."""
    rows = training_rows(data, target, series, train_ratio)
    out = samples.where("split = 'test'")
    if "Persistence" in models:
        out = persistence(out)
    if "AR(1)" in models:
        out = ar1_forecast(out, fit_ar1(rows, target, series), lead, series)
    if "ETS" in models:
        out = ets_forecast(out, rows, target, series, ets_alpha)
    return out


def forecasts(data: DataFrame, samples: DataFrame, target: str, features: Sequence[str], lead: int,
              models: Sequence[str], train_ratio: float = 0.7, normalization: str = "minmax",
              settings: Mapping[str, Mapping] | None = None, ets_alpha: float | None = None, series: Sequence[str] = ()) -> DataFrame:
    """Forecasts of the selected models for every test origin of the samples; boosting needs their windows. With ``series``
    every model is fitted to each series, all of them in the same jobs."""
    columns = output_columns(models)
    out = simple_forecasts(data, samples, target, lead, models, series, train_ratio, ets_alpha)
    if "GBR" in models:
        channels = [target, *[f for f in features if f != target]]
        rows = row_index(data.select(*series, "date", *channels), "date", series, "i", total="n")
        stats = fit_scaler(rows.where(F.col("i") < share(F.col("n"), train_ratio)), channels, normalization, series)
        options = {"rounds": "n_estimators", "rate": "learning_rate", "depth": "max_depth", "bins": "max_bins"}
        given = (settings or {}).get("GBR", {})
        fitted = gbr_forecast(samples, stats, channels, target, series=series, **{k: given[v] for k, v in options.items() if v in given})
        out = out.join(fitted.select(*series, "i", columns["GBR"]), [*series, "i"])
    return out.select(*series, "origin_date", F.col("target_date").alias("date"), F.lit(lead).alias("lead"), F.col("target").alias("TRUE"),
                      *columns.values())


def run_comparison(raw: DataFrame, archive: DataFrame, axis: DataFrame, target: str, lead: int, lags: int, models: Sequence[str],
                   features: Sequence[str] | None = None, provenance: str = "", date: str = "date", train_ratio: float = 0.7,
                   normalization: str = "minmax", settings: Mapping[str, Mapping] | None = None,
                   ets_alpha: float | None = None, series: Sequence[str] = ()) -> DataFrame:
    """Checked data and archive, one forecast per origin and model, exported in the archive's layout.

    The archive is audited, and must lie inside the valid test origins, before any model is fitted. The samples feed
    that check and every model, so they are written to the shared folder once. ``series`` names the columns that tell
    series (banks, say) apart: data and archive then hold many, and one plan compares them all.
    """
    columns, keys = output_columns(models), [*series, *KEYS]
    data = read_forecasting_data(raw, date, target, features, series).withColumnRenamed(date, "date")
    result = load_archive(archive, data, axis, lead, target, provenance, series)
    used = [c for c in data.columns if c not in ("date", target, *series)]
    samples = cut_lineage(prepare_samples(data, axis, target, used, lead, lags, train_ratio, series, windows="GBR" in models), "samples")
    require_segments(samples, lags, series)
    valid = samples.where("split = 'test'").select(*series, "origin_date", F.col("target_date").alias("date"), F.lit(lead).alias("lead"))
    require_contained(result, valid, keys)
    if models:
        made = forecasts(data, samples, target, used, lead, models, train_ratio, normalization, settings, ets_alpha, series)
        for model, column in columns.items():
            result = merge_one_to_one(result, made, keys, column, model)
    return result.select(
        *series, "origin_date", "date", F.col("date").alias("target_date"), "lead", F.lit(lead).alias("horizon"), F.lit("direct").alias("forecast_mode"),
        "TRUE", "Informer_pred", *columns.values())


def evaluate(predictions: DataFrame, actual: str = "TRUE", baseline: str = "Informer_pred", date: str = "date",
             series: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Error metrics per model (and series) and Diebold-Mariano tests against the baseline; equal forecasts stop the tests."""
    data, columns = validated(predictions, actual, baseline, date, series)
    metrics = label_metrics(error_metrics(long_predictions(data, actual, columns, series), [*series, "model"]))
    tests = dm_tests(data, actual, baseline, [c for c in columns if c != baseline], series, strict=True)
    return metrics, tests
