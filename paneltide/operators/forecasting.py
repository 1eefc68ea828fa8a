"""Per-series forecasts on prepared samples, all series in parallel."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import fail_if
from ..session import cut_lineage
from ..timeline import BLOCK_ROWS, row_index, shift_rows
from .boosting import boosted
from .samples import share
from .scaling import attach, restored

# Output column of each model.
MODEL_COLUMNS = {"Persistence": "Persistence_pred", "AR(1)": "AR1_pred", "ETS": "ETS_pred", "GBR": "GBR_pred"}


def training_rows(df: DataFrame, value: str, series: Sequence[str] = (), train_ratio: float = 0.7) -> DataFrame:
    """Every observed row with its index and the end of its training segment."""
    indexed = row_index(df.select(*series, "date", value), "date", series, "i", total="n")
    return indexed.withColumn("fit_end", share(F.col("n"), train_ratio))


def persistence(samples: DataFrame, out: str = "Persistence_pred") -> DataFrame:
    return samples.withColumn(out, F.col("x"))


def fit_ar1(rows: DataFrame, value: str, series: Sequence[str] = ()) -> DataFrame:
    """Least-squares intercept and slope of each row on the row before it, training rows only.

    A constant series has no slope; the minimum-norm solution takes its place.
    """
    pairs = shift_rows(rows.where("i < fit_end"), {"__before": value}, 1, "i", series).where("__before is not null")
    y, x = F.col(value), F.col("__before")
    fitted = pairs.groupBy(*series).agg(
        F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("c"), F.avg(y).alias("my"), F.avg(x).alias("mx"))
    norm = 1 + F.col("mx") * F.col("mx")
    return fitted.select(*series,
                         F.coalesce("c", F.col("my") / norm).alias("intercept"),
                         F.coalesce("s", F.col("mx") * F.col("my") / norm).alias("slope"))


def ar1_forecast(samples: DataFrame, parameters: DataFrame, lead: int, series: Sequence[str] = (),
                 out: str = "AR1_pred") -> DataFrame:
    wide = attach(samples, parameters, series)
    path = F.aggregate(F.sequence(F.lit(1), F.lit(lead)), F.col("x"),
                       lambda level, _: F.col("intercept") + F.col("slope") * level)
    return wide.withColumn(out, path).drop("intercept", "slope")


# Exponential smoothing. The level is a linear recurrence: over a block, level_end = carry + power * (level_start - first),
# and the squared errors are a quadratic in level_start. A block is summarised without knowing where it starts, and the
# summaries are chained per series, so neither fitting nor updating puts a whole series into one task.

def _value_blocks(rows: DataFrame, value: str, series: Sequence[str], block_rows: int) -> DataFrame:
    """Consecutive values as arrays of at most ``block_rows``."""
    return rows.groupBy(*series, F.floor(F.col("i") / block_rows).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("i", F.col(value).cast("double").alias("v")))).alias("cells"))


def _summary(cells: str, alpha: str):
    first = F.col(cells)[0]["v"]
    a, q = F.col(alpha), 1 - F.col(alpha)
    zero = F.lit(0.0)
    start = F.struct(first.alias("carry"), F.lit(1.0).alias("power"), zero.alias("dd"), zero.alias("dp"), zero.alias("pp"))

    def step(s, cell):
        d = cell["v"] - s["carry"]
        return F.struct(
            (a * cell["v"] + q * s["carry"]).alias("carry"), (q * s["power"]).alias("power"),
            (s["dd"] + d * d).alias("dd"), (s["dp"] + d * s["power"]).alias("dp"), (s["pp"] + s["power"] * s["power"]).alias("pp"))

    return F.struct(first.alias("first"), F.aggregate(cells, start, step).alias("s"))


def _composed(chain: str) -> Column:
    """Two summaries in a row are one again: the second starts where the first ends. With g the gap between a level and the
    first value of the first part, the second part's gap is ``carry + power * g - first`` of its own."""
    start = F.struct(F.lit(0.0).alias("carry"), F.lit(1.0).alias("power"), F.lit(0.0).alias("dd"), F.lit(0.0).alias("dp"), F.lit(0.0).alias("pp"), F.lit(True).alias("none"), F.lit(0.0).alias("first"))

    def link(state, part):
        b, t = part["b"], part["b"]["s"]
        gap = F.when(state["none"], F.lit(0.0)).otherwise(state["carry"] - b["first"])
        return F.struct(
            (t["carry"] + t["power"] * gap).alias("carry"), (state["power"] * t["power"]).alias("power"),
            (state["dd"] + t["dd"] - 2 * gap * t["dp"] + gap * gap * t["pp"]).alias("dd"),
            (state["dp"] + state["power"] * (t["dp"] - gap * t["pp"])).alias("dp"), (state["pp"] + state["power"] * state["power"] * t["pp"]).alias("pp"),
            F.lit(False).alias("none"), F.when(state["none"], b["first"]).otherwise(state["first"]).alias("first"))

    done = F.aggregate(chain, start, link)
    return F.struct(done["first"].alias("first"), F.struct(*[done[c].alias(c) for c in ("carry", "power", "dd", "dp", "pp")]).alias("s"))


def _chained_sse(blocks: DataFrame, grid: DataFrame, series: Sequence[str], fan: int = 256) -> DataFrame:
    """One-step squared errors of every series and candidate smoothing weight. ``fan`` neighbouring summaries at a time become
    one, in a tree, so no array outgrows ``fan``, however long a series is; it is as deep as the longest series needs."""
    trial = attach(blocks, grid, series).select(*series, "block", "cells", F.inline("candidates"))
    parts = trial.select(*series, "alpha", "step", "block", _summary("cells", "alpha").alias("b"))
    longest = blocks.agg(F.max("block").alias("b")).first()["b"] or 0
    while True:
        parts = parts.withColumn("block", F.col("block").cast("long"))
        chain = parts.groupBy(*series, "alpha", "step", F.floor(F.col("block") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "b"))).alias("chain"))
        parts = chain.select(*series, "alpha", "step", F.col("up").alias("block"), _composed("chain").alias("b"))
        longest //= fan
        if not longest:
            return parts.select(*series, "alpha", "step", F.col("b.s.dd").alias("sse"))  # the first level is the first value


def squared_errors(rows: DataFrame, value: str, weights: DataFrame, series: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One-step squared error on the training rows for each given weight: ``(series, alpha, sse)``."""
    grid = weights.groupBy(*series).agg(F.collect_list(F.struct("alpha", F.lit(0.0).alias("step"))).alias("candidates"))
    return _chained_sse(_value_blocks(rows.where("i < fit_end"), value, series, block_rows), grid, series).drop("step")


def fit_ets(rows: DataFrame, value: str, series: Sequence[str] = (), points: int = 32, rounds: int = 4,
            low: float = 1e-6, high: float = 1 - 1e-6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Smoothing weight with the least one-step squared error on the training rows, to about 1e-5.

    Each round lays a grid over the bracket around the best weight of the round before.
    """
    blocks = cut_lineage(_value_blocks(rows.where("i < fit_end"), value, series, block_rows), "blocks")  # read in every round
    return _fit(blocks, series, points, rounds, low, high)


def _fit(blocks: DataFrame, series: Sequence[str], points: int = 32, rounds: int = 4, low: float = 1e-6, high: float = 1 - 1e-6) -> DataFrame:
    bounds = blocks.groupBy(*series).agg(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    for _ in range(rounds):
        step = (F.col("hi") - F.col("lo")) / points
        grid = bounds.select(*series, F.transform(
            F.sequence(F.lit(0), F.lit(points)),
            lambda k: F.struct((F.col("lo") + step * k).alias("alpha"), step.alias("step"))).alias("candidates"))
        best = _chained_sse(blocks, grid, series).groupBy(*series).agg(
            F.min_by(F.struct("alpha", "step"), F.struct("sse", "alpha")).alias("best")).select(*series, "best.*")
        bounds = best.select(*series, "alpha", F.greatest(F.lit(low), F.col("alpha") - F.col("step")).alias("lo"),
                             F.least(F.lit(high), F.col("alpha") + F.col("step")).alias("hi"))
    return bounds.select(*series, "alpha")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _level_path(values: pd.Series, start: pd.Series, alpha: pd.Series) -> pd.Series:
    """Recurrence along the blocks, many blocks side by side."""
    out: list[np.ndarray] = []
    for at in range(0, len(values), 256):
        part = [np.asarray(v, float) for v in values[at:at + 256]]
        sizes = [len(v) for v in part]
        grid = np.zeros((len(part), max(sizes)))
        for row, v in zip(grid, part):
            row[:len(v)] = v
        level, a = start[at:at + 256].to_numpy(float), alpha[at:at + 256].to_numpy(float)
        for k in range(grid.shape[1]):
            level = a * grid[:, k] + (1 - a) * level
            grid[:, k] = level
        out += [row[:n] for row, n in zip(grid, sizes)]
    return pd.Series(out)


def ets_levels(rows: DataFrame, weights: DataFrame | float, value: str, series: Sequence[str] = (),
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Level after every observed row, ``(series, i, level)``; the first level is the first value.

    ``weights`` is one smoothing weight for all, or a table with ``alpha`` per series.
    """
    return _levels(_value_blocks(rows, value, series, block_rows), weights, series)


CHAIN = 512  # blocks in a link of the chain


def _starts(links: DataFrame, series: Sequence[str], place: str) -> DataFrame:
    """Level before each link. A link turns a level into ``power * level + shift``; the first level is that of link 0."""
    chain = links.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct(place, "power", "shift"))).alias("chain"), F.min_by("level", place).alias("level"))
    first = F.struct(F.col("level"), F.array().cast(f"array<struct<{place}:bigint,start:double>>").alias("starts"))

    def step(state, link):
        here = F.struct(link[place].alias(place), state["level"].alias("start"))
        return F.struct((link["power"] * state["level"] + link["shift"]).alias("level"), F.array_append(state["starts"], here).alias("starts"))

    return chain.select(*series, F.inline(F.aggregate("chain", first, step)["starts"]))


def _levels(blocks: DataFrame, weights: DataFrame | float, series: Sequence[str]) -> DataFrame:
    """The chain has two levels, so no array outgrows ``CHAIN`` blocks or one link per ``CHAIN`` blocks of a series."""
    known = attach(blocks, weights, series) if isinstance(weights, DataFrame) else blocks.withColumn("alpha", F.lit(float(weights)))
    summed = known.select(*series, "block", F.floor(F.col("block") / CHAIN).alias("part"), _summary("cells", "alpha").alias("b")).select(
        *series, "block", "part", F.col("b.first").alias("level"), F.col("b.s.power").alias("power"),
        (F.col("b.s.carry") - F.col("b.s.power") * F.col("b.first")).alias("shift"))
    held = summed.groupBy(*series, "part").agg(F.array_sort(F.collect_list(F.struct("block", "power", "shift"))).alias("inner"), F.min_by("level", "block").alias("level"))
    whole = F.aggregate("inner", F.struct(F.lit(1.0).alias("power"), F.lit(0.0).alias("shift")), lambda s, b: F.struct(
        (b["power"] * s["power"]).alias("power"), (b["power"] * s["shift"] + b["shift"]).alias("shift")))
    outer = _starts(held.select(*series, "part", "level", whole.alias("w")).select(*series, "part", "level", "w.power", "w.shift"), series, "part")
    at_part = summed.drop("level").join(outer.withColumnRenamed("start", "level"), [*series, "part"])
    starts = _starts(at_part, [*series, "part"], "block").drop("part")
    levelled = known.join(starts, [*series, "block"]).select(
        *series, "cells", _level_path(F.col("cells.v"), F.col("start"), F.col("alpha")).alias("levels"))
    return levelled.select(*series, F.inline(F.arrays_zip(F.col("cells.i").alias("i"), F.col("levels").alias("level"))))


def ets_forecast(samples: DataFrame, rows: DataFrame, value: str, series: Sequence[str] = (), alpha: float | DataFrame | None = None,
                 out: str = "ETS_pred", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Level at each origin. All rows up to the origin count, also those that are no sample origin themselves. ``alpha`` is
    one weight, a table of weights as ``fit_ets`` gives it, or None to fit them here."""
    if alpha is None:  # every round of the search and the levels read the blocks, so they are written once
        blocks = cut_lineage(_value_blocks(rows, value, series, block_rows), "blocks")
        ends = rows.groupBy(*series).agg(F.max("fit_end").alias("fit_end"))
        training = attach(blocks, ends, series).withColumn("cells", F.filter("cells", lambda c: c["i"] < F.col("fit_end"))).where("size(cells) > 0")
        weights = cut_lineage(_fit(training.drop("fit_end"), series), "weights")
        levels = _levels(blocks, weights, series)
    else:
        levels = ets_levels(rows, alpha, value, series, block_rows)
    return samples.join(levels.withColumnRenamed("level", out), [*series, "i"])


def gbr_forecast(samples: DataFrame, stats: DataFrame, channels: Sequence[str], target: str, rounds: int = 100,
                 rate: float = 0.1, depth: int = 3, out: str = "GBR_pred", series: Sequence[str] = (), bins: int = 64,
                 every: bool = False) -> DataFrame:
    """Gradient boosting on the flattened scaled window, learnt from the training samples of each series.

    ``window`` holds the raw channels in the order of ``channels``; ``stats`` their training scales. The forecast is
    returned on the original scale for the test samples, with ``every`` for all.
    """
    wide = attach(samples, stats, series)
    row = lambda r: F.array(*[(r[k] - F.col(f"{c}__centre")) / F.col(f"{c}__scale") for k, c in enumerate(channels)])
    ready = wide.withColumns({
        "features": F.flatten(F.transform("window", row)),
        "label": (F.col("target") - F.col(f"{target}__centre")) / F.col(f"{target}__scale"),
        "train": F.col("split") == "train",
    })
    scales = {f"{target}__centre", f"{target}__scale"}
    kept = [c for c in samples.columns if c != "window"]
    scored = boosted(ready.select(*kept, "features", "label", "train", *scales), "features", "label", "train", "scaled", series, rounds, rate, depth, bins)
    return (scored if every else scored.where("split = 'test'")).withColumn(out, restored(F.col("scaled"), target)).select(*kept, out)


def prediction_frame(scored: DataFrame, scaled_prediction: str, target: str, lead: int, out: str,
                     series: Sequence[str] = (), actual: str | None = None) -> DataFrame:
    """Scaled scalar forecasts to the original scale, keyed by origin, target day and lead.

    An array-valued (joint) output is rejected while planning; an origin on or after its target stops the job.
    """
    kind = scored.schema[scaled_prediction].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{out} needs a single number per origin, not {kind.simpleString()}")
    origin = fail_if(F.col("origin_date") >= F.col("target_date"), "a forecast's origin is not before its target day", F.col("origin_date"))
    return scored.select(*series, origin.alias("origin_date"), F.col("target_date").alias("date"), F.lit(int(lead)).alias("lead"),
                         restored(F.col(scaled_prediction), target).alias(out), *([actual] if actual else []))


def direct_result_frame(preds: DataFrame, lead: int) -> DataFrame:
    """Export rows of scalar direct forecasts from ``origin_date, target_date, actual, pred``."""
    per_origin = preds.groupBy("origin_date").agg(
        F.count(F.lit(1)).alias("__rows"), *[F.first(c).alias(c) for c in ("target_date", "actual", "pred")])
    bad = (F.col("__rows") > 1) | (F.col("origin_date") >= F.col("target_date"))
    origin = fail_if(bad, "an origin is repeated or not before its target day", F.col("origin_date"))
    return per_origin.select(
        origin.alias("origin"), origin.alias("origin_date"), "target_date", F.lit("direct").alias("forecast_mode"),
        F.col("target_date").alias("date"), F.lit(lead).alias("horizon"), F.lit(lead).alias("lead"), "actual",
        F.col("actual").alias("true"), "pred")


def output_columns(models: Sequence[str], known: Mapping[str, str] = MODEL_COLUMNS) -> dict[str, str]:
    """Model -> output column, in the order asked for; whatever is wrong with the request is reported at once."""
    asked = Counter(models)
    wrong = [f"{m}: no such model" for m in asked if m not in known] + [f"{m}: asked for {n} times" for m, n in asked.items() if n > 1]
    if wrong:
        raise ValueError(f"{'; '.join(wrong)} (there are {', '.join(known)})")
    return {m: known[m] for m in models}
