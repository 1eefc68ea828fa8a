"""Per-column scaling whose parameters come from training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage


def attach(df: DataFrame, stats: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Bring parameters to the rows: by key (a NULL is a key like any other), or as a scalar subquery when there is one
    row for all.

    Parameters, one row per series, are written first, so Spark knows their size when it plans: below its broadcast threshold
    they go to the rows and no row is shuffled. Beyond it rows and parameters meet by series, where skewed series are split.
    """
    if series:
        keyed = stats.select(F.struct(*series).alias("__series"), *[c for c in stats.columns if c not in series])
        return df.withColumn("__series", F.struct(*series)).join(cut_lineage(keyed, "parameters"), "__series").drop("__series")
    one = stats.select(F.struct("*").alias("s")).scalar()
    return df.select("*", *[one[c].alias(c) for c in stats.columns])


def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str = "minmax", series: Sequence[str] = (),
               zero_range: str = "one") -> DataFrame:
    """Centre and scale of every column. A constant column is divided by 1, or gives NULL with ``zero_range="null"``."""
    if kind not in {"minmax", "standard"}:
        raise ValueError("kind must be 'minmax' or 'standard'")
    aggregates = []
    for c in columns:
        if kind == "minmax":
            centre, scale = F.min(c), F.max(c) - F.min(c)
        else:
            centre, scale = F.avg(c), F.stddev_pop(c)
        scale = F.when(scale != 0, scale).otherwise(F.lit(1.0 if zero_range == "one" else None).cast("double"))
        aggregates += [centre.cast("double").alias(f"{c}__centre"), scale.alias(f"{c}__scale")]
    return train.groupBy(*series).agg(*aggregates)


def transformed(column: str) -> Column:
    return (F.col(column) - F.col(f"{column}__centre")) / F.col(f"{column}__scale")


def restored(value: Column, column: str) -> Column:
    """Scaled value back on the original scale of ``column``."""
    return value * F.col(f"{column}__scale") + F.col(f"{column}__centre")


def scale(df: DataFrame, stats: DataFrame, columns: Sequence[str], series: Sequence[str] = (),
          suffix: str = "_scaled") -> DataFrame:
    wide = attach(df, stats, series)
    return wide.select(*df.columns, *[transformed(c).alias(f"{c}{suffix}") for c in columns])


def standardize(df: DataFrame, columns: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / sample standard deviation over the whole series, in place."""
    stats = df.groupBy(*series).agg(*[f(c).alias(f"{c}__{n}") for c in columns
                                      for n, f in (("centre", F.avg), ("scale", F.stddev_samp))])
    wide = attach(df, stats, series)
    wanted = set(columns)
    return wide.select(*[
        F.try_divide(F.col(c) - F.col(f"{c}__centre"), F.col(f"{c}__scale")).alias(c) if c in wanted else F.col(c)
        for c in df.columns])
