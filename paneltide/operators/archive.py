"""Forecast archives: loading contract, audits and key-exact merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import fail_if, number_or_null, require_columns, resolve_names

# Accepted names of each archive column, in order of preference, and accepted provenance marks.
DATE_NAMES = ["date", "target_date"]
ORIGIN_NAMES = ["origin_date", "origin"]
LEAD_NAMES = ["lead", "horizon"]
ACTUAL_NAMES = ["actual_SR", "true", "TRUE", "actual"]
PREDICTION_NAMES = ["predicted_SR", "pred", "Informer_pred", "baseline_pred"]
FORECAST_MODES = ["direct", "direct_terminal_target"]
PROVENANCE = "direct_terminal_target"
# Canonical column -> its type.
CANONICAL = {"origin_date": "date", "date": "date", "lead": "int", "TRUE": "double", "Informer_pred": "double"}


def accepted_names(target: str | None = None) -> dict[str, list[str]]:
    """Canonical column -> accepted names; the actual value may also carry the target's own name."""
    return {"origin_date": ORIGIN_NAMES, "date": DATE_NAMES, "lead": LEAD_NAMES, "TRUE": ACTUAL_NAMES + ([target] if target else []), "Informer_pred": PREDICTION_NAMES}


def resolve_aliases(raw: DataFrame, target: str | None = None, series: Sequence[str] = ()) -> DataFrame:
    """Archive columns under their canonical names ``origin_date, date, lead, TRUE, Informer_pred``, after those of its series."""
    names = resolve_names(raw, accepted_names(target), "archive")
    return raw.select(*series, *[F.col(names[n]).cast(kind).alias(n) for n, kind in CANONICAL.items()])


def close(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def actuals_within_tolerance(archive: DataFrame, data: DataFrame, target: str, rtol: float = 1e-6, atol: float = 1e-8) -> DataFrame:
    """Archive rows with the value of the data on their target day and whether both agree."""
    joined = archive.join(data.select(F.col("date"), F.col(target).alias("data_value")), "date", "left")
    return joined.withColumn("within", F.coalesce(close(F.col("data_value"), F.col("TRUE"), rtol, atol), F.lit(False)))


def audit_rules(raw: DataFrame, data: DataFrame, axis: DataFrame, lead: int, target: str, series: Sequence[str] = ()) -> DataFrame:
    """One row per rule with the number of rows that break it; everything zero means the archive is sound. With ``series``,
    data and archive hold many series, and days are unique in each."""
    require_columns(raw, ["forecast_mode", *series], "archive")
    names, c = resolve_names(raw, accepted_names(target), "archive"), F.col
    target_day, origin_day = c(names["date"]).cast("date"), c(names["origin_date"]).cast("date")
    flags: dict[str, Column] = {}
    flags["forecast_mode"] = ~F.coalesce(c("forecast_mode").isin(FORECAST_MODES), F.lit(False))
    for name in LEAD_NAMES:
        if name in raw.columns:
            flags[f"{name}_matches"] = ~F.coalesce(c(name).cast("int") == lead, F.lit(False))
    for name in ("target_mode", "provenance"):
        if name in raw.columns:
            flags[name] = ~F.coalesce(c(name) == PROVENANCE, F.lit(False))
    given = [n for n in DATE_NAMES if n in raw.columns]
    flags["date_alias_conflict"] = reduce(lambda a, b: a | b, [~c(n).cast("date").eqNullSafe(target_day) for n in given])
    origins = [n for n in ORIGIN_NAMES if n in raw.columns]
    flags["origin_on_calendar"] = reduce(lambda a, b: a | b, [~F.coalesce(c(n).cast("date") == c("__expected_origin"), F.lit(False)) for n in origins])
    actual, predicted = names["TRUE"], names["Informer_pred"]
    finite = lambda n: F.coalesce(F.abs(number_or_null(raw, n)) != float("inf"), F.lit(False))
    flags["finite_values"] = ~(finite(actual) & finite(predicted))
    flags["target_on_calendar"] = c("__target_pos").isNull() | (c("__target_pos") < lead)
    flags["target_in_data"] = c("__data_value").isNull()
    flags["origin_in_data"] = c("__origin_value").isNull()
    flags["actual_matches_data"] = c("__data_value").isNotNull() & ~F.coalesce(close(c("__data_value"), number_or_null(raw, actual)), F.lit(False))

    days = axis.select(c("date").alias("__d"), c("pos").alias("__target_pos"))
    back = axis.select(c("date").alias("__expected_origin"), (c("pos") + lead).alias("__target_pos"))
    values = data.select(*series, c("date").cast("date").alias("__d"), c(target).alias("__data_value"))
    at_origin = data.select(*series, c("date").cast("date").alias("__expected_origin"), c(target).alias("__origin_value"))
    rows = (raw.withColumn("__d", target_day)
            .join(days, "__d", "left").join(back, "__target_pos", "left")
            .join(values, [*series, "__d"], "left").join(at_origin, [*series, "__expected_origin"], "left"))
    repeats = {"unique_origin": "origin_date", "unique_target": "date"}
    in_series = lambda day: F.when(day.isNotNull(), F.struct(*series, day)) if series else day
    checked = rows.select(*[f.alias(n) for n, f in flags.items()], in_series(origin_day).alias("origin_date"), in_series(target_day).alias("date"))
    counted = checked.agg(
        *[F.count_if(n).alias(n) for n in flags],
        *[(F.count(k) - F.count_distinct(k)).alias(rule) for rule, k in repeats.items()],
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("not_empty"))
    return counted.unpivot([], counted.columns, "rule", "violations")


def load_archive(raw: DataFrame, data: DataFrame, axis: DataFrame, lead: int, target: str, provenance: str, series: Sequence[str] = ()) -> DataFrame:
    """Audited archive under canonical names; the first broken rule is an error."""
    if provenance != PROVENANCE:
        raise ValueError(f"the archive's provenance is {provenance!r}; only {PROVENANCE!r} can be compared lead by lead")
    if lead < 1:
        raise ValueError("lead must be positive")
    broken = audit_rules(raw, data, axis, lead, target, series).where("violations > 0").collect()
    if broken:
        raise ValueError("Archive rejected: " + ", ".join(f"{r.rule} ({r.violations} rows)" for r in broken))
    return resolve_aliases(raw, target if target in raw.columns else None, series)


def merge_one_to_one(left: DataFrame, addition: DataFrame, keys: Sequence[str], column: str, model: str) -> DataFrame:
    """Add a model's forecasts. Duplicate keys, or a left row without forecast, stop the job naming the key."""
    one = addition.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.first(column).alias("__value"))
    label = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    value = fail_if(F.col("__rows") > 1, F.concat(F.lit(f"two forecasts of {model} for "), label),
                    fail_if(F.col("__value").isNull(), F.concat(F.lit(f"no forecast of {model} for "), label), F.col("__value")))
    return left.join(one, list(keys), "left").select(*left.columns, value.alias(column))


def merge_report(left: DataFrame, addition: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate and unmatched keys a one-to-one merge would stop at."""
    doubled = addition.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate").alias("problem"))
    missing = left.select(*keys).join(addition.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("unmatched"))
    return doubled.unionByName(missing)


def keys_outside(archive: DataFrame, valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return archive.select(*keys).join(valid.select(*keys), list(keys), "left_anti")


def require_contained(archive: DataFrame, valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    outside = keys_outside(archive, valid, keys).limit(3).collect()
    if outside:
        raise ValueError(f"archive rows that no test sample covers, for example {outside}")
    return archive


def prediction_columns(df: DataFrame, suffix: str = "_pred") -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def series_report(df: DataFrame, date: str, actual: str, predictions: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Violations of the evaluation contract: repeated or missing days, values that are not finite numbers."""
    per_day = df.groupBy(*series, date).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.coalesce(F.abs(number_or_null(df, c)) == float("inf"), F.lit(True))).alias(c) for c in [actual, *predictions]])
    counted = per_day.agg(
        F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("duplicate_dates"),
        F.count_if(F.col(date).isNull()).alias("missing_dates"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"nonfinite_{c}") for c in [actual, *predictions]])
    return counted.unpivot([], counted.columns, "rule", "violations")


def unsorted_dates(df: DataFrame, date: str, index: str, series: Sequence[str] = ()) -> DataFrame:
    """Rows whose day is not after the day of the row before, in the order ``index`` gives."""
    from ..timeline import shift_rows

    return shift_rows(df, {"__before": date}, 1, index, series).where(F.col(date) <= F.col("__before")).drop("__before")


def validated(df: DataFrame, actual: str, baseline: str, date: str = "date", series: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Checked frame and its prediction columns; one action."""
    require_columns(df, [*series, date, actual, baseline], "predictions")
    predictions = prediction_columns(df)
    if baseline not in predictions or len(predictions) < 2:
        raise ValueError(f"nothing to compare: {baseline!r} and another *_pred column are needed, found {predictions}")
    broken = series_report(df, date, actual, predictions, series).where("violations > 0").collect()
    if broken:
        raise ValueError("Evaluation input rejected: " + ", ".join(f"{r.rule} ({r.violations})" for r in broken))
    return df.withColumns({c: F.col(c).cast("double") for c in [actual, *predictions]}), predictions


def read_forecasting_data(df: DataFrame, date: str, target: str, features: Sequence[str] | None = None, series: Sequence[str] = ()) -> DataFrame:
    """Series, date, target and requested features, typed; wholly non-numeric columns are dropped, other gaps are errors."""
    require_columns(df, [*series, date, target], "forecasting data")
    if features is not None:
        wanted = list(dict.fromkeys([target, *features]))
        require_columns(df, wanted, "forecasting data")
        df = df.select(*series, date, *wanted)
    numeric = [c for c in df.columns if c != date and c not in series]
    typed = df.select(*series, F.col(date).cast("date").alias(date), *[number_or_null(df, c).alias(c) for c in numeric])
    per_day = typed.groupBy(*series, date).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(c).alias(f"n_{c}") for c in numeric],
        *[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"inf_{c}") for c in numeric])
    facts = per_day.agg(
        F.sum("__rows").alias("rows"), F.max("__rows").alias("most"), F.count_if(F.col(date).isNull()).alias("undated"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in numeric], *[F.sum(f"inf_{c}").alias(f"inf_{c}") for c in numeric]).first()
    if facts["rows"] and (facts["most"] > 1 or facts["undated"]):
        raise ValueError(f"every row needs a date of its own: {facts['undated']} days without date, up to {facts['most']} rows on one day")
    kept = [c for c in numeric if facts[f"n_{c}"]]
    gaps = [c for c in kept if facts[f"n_{c}"] < facts["rows"]]
    if gaps:
        raise ValueError(f"columns with gaps or text among their numbers: {gaps}")
    if any(facts[f"inf_{c}"] for c in kept):
        raise ValueError("infinite values among the series")
    return typed.select(*series, date, *kept)
