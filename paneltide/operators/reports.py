"""Descriptive statistics, comparison tables and figure data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.reporting import fixed, scientific
from ..functions.student_t import t_test_p
from ..functions.text import lookup
from ..schema import number_or_null
from ..session import cut_lineage
from ..timeline import row_index, running_offsets, shift_rows
from .evaluation import average_over_iterations, dm_table, test_rows
from .scaling import standardize

# Short names of the banks and the published names of the specifications.
BANK_CODES = {
    "中信银行": "CNCB", "中国银行": "BOC", "交通银行": "BCM", "兴业银行": "CIB", "北京银行": "BOB", "华夏银行": "HB", "南京银行": "BON",
    "宁波银行": "NBCB", "工商银行": "ICBC", "平安银行": "PAB", "建设银行": "CCB", "招商银行": "CMB", "民生银行": "CMBC", "浦发银行": "SPDB",
}
SPEC_NAMES = {"不带情绪": "without sentiment", "带情绪": "with sentiment"}


def descriptive_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of every indicator."""
    cells = [F.struct(F.lit(c).alias("indicator"), number_or_null(df, c).alias("v")) for c in columns]
    return df.select(*by, F.inline(F.array(*cells))).groupBy(*by, "indicator").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def lag_feature(df: DataFrame, columns: Sequence[str], lag: int = 1, order: str = "date", series: Sequence[str] = ()) -> DataFrame:
    """Columns ``lag`` rows earlier, in row order."""
    indexed = row_index(df, order, series, "__i")
    return shift_rows(indexed, {f"{c}_lag{lag}": c for c in columns}, lag, "__i", series).drop("__i")


def lagged_correlation(df: DataFrame, risks: Sequence[str], signals: Sequence[str], lag: int = 1, order: str = "date",
                       series: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each risk with each lagged signal over complete pairs.

    NULL with fewer than three pairs or a constant side. Means are taken first, so the sums of the second pass are
    centred.
    """
    typed = df.select(*series, order, *[number_or_null(df, c).alias(c) for c in [*risks, *signals]])
    lagged = lag_feature(typed, signals, lag, order, series)
    cells = [F.struct(F.lit(r).alias("risk_variable"), F.lit(f"{s}_lag{lag}").alias("lagged_variable"),
                      F.col(r).alias("a"), F.col(f"{s}_lag{lag}").alias("b")) for r in risks for s in signals]
    pairs = lagged.select(*series, F.inline(F.array(*cells))).where("a is not null and b is not null")
    keys = [*series, "risk_variable", "lagged_variable"]
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("__ab"), F.var_pop("a").alias("__aa"), F.var_pop("b").alias("__bb"),
        (F.min("a") < F.max("a")).alias("__va"), (F.min("b") < F.max("b")).alias("__vb"))
    usable = (F.col("n") >= 3) & F.col("__va") & F.col("__vb")
    r = F.when(usable, F.try_divide(F.col("__ab"), F.sqrt(F.col("__aa") * F.col("__bb"))))
    return out.select(*keys, "n", r.alias("correlation"))


def with_correlation_p(table: DataFrame) -> DataFrame:
    """Two-sided p-value of a correlation, n - 2 degrees of freedom."""
    r, df = F.col("correlation"), F.col("n").cast("double") - 2
    t = F.when(F.abs(r) < 1, r * F.sqrt(df / (1 - r * r))).otherwise(F.when(r.isNotNull() & (df > 0), F.lit(1e300)))
    return table.withColumn("p_value", t_test_p(t, df))


def correlation_matrix(table: DataFrame, samples: Sequence[str], text: Column, by: str = "sample") -> DataFrame:
    """One row per signal, one column per sample."""
    return table.withColumn("cell", text).groupBy("lagged_variable").pivot(by, list(samples)).agg(F.first("cell"))


def error_reduction(metrics: DataFrame, base: str = "without", other: str = "with", split: str = "split") -> DataFrame:
    """Both specifications of every bank and the share of error the second one saves."""
    avg = average_over_iterations(metrics, split=split)
    side = lambda name, m: F.max(F.when(F.col("spec") == name, F.col(m)))
    saved = lambda m: F.try_divide(side(base, m) - side(other, m), side(base, m)).alias(m)
    empty = F.lit(None).cast("double")
    # A bank has one averaged row per specification, so the list is as short as the list of specifications.
    blocks = avg.groupBy("bank").agg(
        F.collect_list(F.struct("spec", "MSE", "MAE", "RMSE", "R2")).alias("specs"),
        F.struct(F.lit("reduction").alias("spec"), saved("MSE"), saved("MAE"), empty.alias("RMSE"), empty.alias("R2")).alias("reduction"))
    return blocks.select("bank", F.inline(F.concat("specs", F.array("reduction"))))


def extreme_metrics(metrics: DataFrame, base: str = "without", other: str = "with",
                    values: Sequence[str] = ("MSE", "MAE", "RMSE", "R2", "MAPE", "MSPE"), split: str = "split") -> DataFrame:
    """Worst run of the base and best run of the other specification, each metric for itself; metrics the table lacks are left out."""
    values = [v for v in values if v in metrics.columns]
    def pick(m):
        worst, best = (F.min(m), F.max(m)) if m == "R2" else (F.max(m), F.min(m))
        return F.when(F.col("spec") == base, worst).otherwise(best).alias(m)

    chosen = test_rows(metrics, split).where(F.col("spec").isin(base, other) & F.col("bank").isNotNull())
    return chosen.groupBy("bank", "spec").agg(*[pick(m) for m in values])


def best_comparator_improvement(metrics: DataFrame, baseline: str, comparators: Sequence[str], by: Sequence[str] = (),
                                values: Sequence[str] = ("MSE", "MAE")) -> DataFrame:
    """Best comparator per metric and the baseline's improvement on it, in percent."""
    model = F.col("model")
    cells = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values]
    long = metrics.where(model.isin(baseline, *comparators)).select(*by, "model", F.inline(F.array(*cells)))
    rival = F.when(F.col("model") != baseline, F.col("v"))
    out = long.groupBy(*by, "metric").agg(
        F.max(F.when(F.col("model") == baseline, F.col("v"))).alias("baseline"), F.min(rival).alias("best"),
        F.min_by("model", F.when(rival.isNotNull(), F.struct(rival, "model"))).alias("best_model"))
    return out.withColumn("improvement", F.try_divide(F.col("best") - F.col("baseline"), F.col("best")) * 100)


def fixed_order(df: DataFrame, key: str, order: DataFrame, position: str = "ord") -> DataFrame:
    """Every listed key, in the listed order's number; keys without a row give NULLs."""
    return order.join(df, key, "left").select(position, *df.columns)


def first_seen_order(df: DataFrame, key: str, row: str) -> DataFrame:
    """Distinct keys with the first row each appears in; sort by it at the sink."""
    return df.groupBy(key).agg(F.min(row).alias("first_row"))


def sorted_rows(df: DataFrame, keys: Sequence[str], out: str = "place") -> DataFrame:
    """Number the rows, 0 to n - 1, in the order of ``keys`` (which must tell rows apart): a table has no order of its own, so
    the place is a column, and a sink that ranges by it writes the files in order. Every task sorts its range only."""
    return running_offsets(df.withColumn("__one", F.lit(1)), "__one", keys, out).drop("__one").withColumn(out, F.col(out).cast("bigint"))


def best_model(metrics: DataFrame, by: Sequence[str], model: str, value: str) -> DataFrame:
    """Model with the smallest value; the alphabetically first of equals."""
    return metrics.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min_by(model, F.struct(value, model)).alias(model), F.min(value).alias(value))


EDGES = 256
SORTED = 65_536  # distinct values that one task may order


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float] = (0, 0.25, 0.5, 0.75, 1.0), sorted_values: int = SORTED) -> DataFrame:
    """Linearly interpolated quantiles, one row ``(p, q)`` each; none without a value.

    Equal values are counted before anything is ordered, and the counts written to the shared folder. Then, as often as needed, a
    sketch cuts the intervals that hold a wanted rank into bins, rows are counted per bin, and the bins that hold one are
    the next intervals: each round divides them by about ``EDGES``. No task orders more than ``sorted_values`` values, and
    the driver sees at most ``EDGES`` counts per wanted rank and round. Exact whatever the sketch says.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    tallies = cut_lineage(values.groupBy("v").agg(F.count(F.lit(1)).alias("rows")), "tallies")
    total = tallies.agg(F.sum("rows")).first()[0] or 0
    heights = {float(p): float(p) * (total - 1) for p in probabilities}
    ranks = {int(k) for h in heights.values() for k in (floor(h), ceil(h))} if total else set()
    intervals = [(-float("inf"), float("inf"), 0)] if total else []  # from (included), to (excluded), rows below

    def within(found: list) -> DataFrame:
        place = F.array(*[F.lit(low) for low, _, _ in found])
        last = F.array(*[F.lit(high) for _, high, _ in found])
        at = F.size(F.filter(place, lambda low: low <= F.col("v"))) - 1
        held = tallies.withColumn("at", at).where("at >= 0")
        return held.where((F.col("v") < F.element_at(last, F.col("at") + 1)) | (F.element_at(last, F.col("at") + 1) == float("inf")))

    while intervals:
        sketch = F.array_distinct(F.percentile_approx("v", [k / EDGES for k in range(1, EDGES)], 10000))
        facts = within(intervals).groupBy("at").agg(F.count(F.lit(1)).alias("distinct"), sketch.alias("edges")).collect()
        wide = {r["at"]: r.edges for r in facts if r.distinct > sorted_values}
        if not wide:
            break
        edges = F.array(*[F.array(*[F.lit(float(e)) for e in wide.get(k, [])]).cast("array<double>") for k in range(len(intervals))])
        bin_ = F.size(F.filter(F.element_at(edges, F.col("at") + 1), lambda e: e <= F.col("v")))
        counts = within(intervals).groupBy("at", bin_.alias("bin")).agg(F.sum("rows").alias("n")).collect()
        following = []
        for k, (low, high, start) in enumerate(intervals):
            borders = [low, *wide.get(k, []), high]
            for r in sorted((r for r in counts if r["at"] == k), key=lambda r: r.bin):
                if any(start <= rank < start + r.n for rank in ranks):
                    following.append((borders[r.bin], borders[r.bin + 1], start))
                start += r.n
        intervals = following
    if not intervals:
        return df.sparkSession.createDataFrame([], "p double, q double")
    starts = F.array(*[F.lit(start) for _, _, start in intervals])
    upto = F.sum("rows").over(Window.partitionBy("at").orderBy("v")) + F.element_at(starts, F.col("at") + 1)
    counted = within(intervals).withColumn("upto", upto)
    hit = counted.select("v", "rows", "upto", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(h).alias("h")) for p, h in heights.items()])))
    low, high = F.floor("h"), F.ceil("h")
    start, end = F.col("upto") - F.col("rows"), F.col("upto")
    inside = lambda k: (k >= start) & (k < end)
    near = hit.where(inside(low) | inside(high)).groupBy("p", "h").agg(
        F.max(F.when(inside(low), F.col("v"))).alias("a"), F.max(F.when(inside(high), F.col("v"))).alias("b"))
    return near.select("p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias("q"))


def quantile_bin(df: DataFrame, column: str, out: str = "risk") -> DataFrame:
    """Quartile class 0 to 3: bounds belong to the lower class, the minimum included, the last class is open."""
    quartiles = exact_quantiles(df, column, (0, 0.25, 0.5, 0.75))
    edges = quartiles.agg(F.array_sort(F.collect_list("q")).alias("e")).scalar()
    v = number_or_null(df, column)
    return df.withColumn("__e", edges).withColumn(
        out, F.when(v.isNull() | (v < F.col("__e")[0]), None).otherwise(
            F.when(v <= F.col("__e")[1], 0).when(v <= F.col("__e")[2], 1).when(v <= F.col("__e")[3], 2).otherwise(3))).drop("__e")


def monthly_means(df: DataFrame, columns: Sequence[str], date: str = "date", series: Sequence[str] = ()) -> DataFrame:
    """Month-end means; months without rows appear with NULLs."""
    month = F.last_day(F.col(date).cast("date"))
    means = df.groupBy(*series, month.alias("month")).agg(*[F.avg(c).alias(c) for c in columns])
    span = means.groupBy(*series).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select(*series, F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("m"))
    return months.select(*series, F.last_day("m").alias("month")).join(means, [*series, "month"], "left")


def monthly_standardized(df: DataFrame, columns: Sequence[str], date: str = "date", series: Sequence[str] = ()) -> DataFrame:
    return monthly_means(standardize(df, columns, series), columns, date, series)


def figure_series(df: DataFrame, actual: str, predictions: Sequence[str], date: str = "date", baseline: str | None = None) -> DataFrame:
    """Observed and forecast values in long form, one panel per model."""
    cells = [F.struct(F.lit("baseline" if c == baseline else c.removesuffix("_pred")).alias("model"),
                      F.col(actual).alias("observed"), F.col(c).alias("forecast")) for c in predictions]
    return df.select(F.col(date).alias("date"), F.inline(F.array(*cells)))


def comparison_table(metrics: DataFrame, models: Sequence[str], values: Sequence[str] = ("MSE", "MAE"), by: Sequence[str] = ()) -> DataFrame:
    """One row per metric, one column per model in the given order (numeric; formatting is up to the sink)."""
    cells = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values]
    long = metrics.where(F.col("model").isin(list(models))).select(*by, "model", F.inline(F.array(*cells)))
    return long.groupBy(*by, "metric").pivot("model", list(models)).agg(F.first("v"))


def dm_blocks(tests: Mapping[str, DataFrame], models: Sequence[str], value: str = "statistic") -> DataFrame:
    """Test tables of several horizons stacked under a ``horizon`` column."""
    parts = [t.groupBy("criterion").pivot("model", list(models)).agg(F.first(value)).select(
        F.lit(h).alias("horizon"), "criterion", *models) for h, t in tests.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def published_comparison(metrics: DataFrame, models: Sequence[str], baseline: str) -> DataFrame:
    """Error table as text, one line per metric: models in the given order, then IMP, the baseline's saving on the best
    other model in percent. MSE is written with an exponent, MAE with three decimals."""
    best = F.least(*[F.col(f"`{m}`") for m in models if m != baseline])
    saved = F.try_divide(best - F.col(f"`{baseline}`"), best) * 100
    cell = lambda x: F.when(F.col("metric") == "MSE", scientific(x)).otherwise(fixed(x, 3))
    table = comparison_table(metrics, models)
    return table.select(F.col("metric").alias("line"), *[cell(F.col(f"`{m}`")).alias(m) for m in models], fixed(saved, 2, suffix="%").alias("IMP"))


# The criterion under which each loss is published.
PUBLISHED_CRITERIA = {"MAD": "MAE", "MSE": "MSE"}


def published_tests(tests: Mapping[str, DataFrame], models: Sequence[str]) -> DataFrame:
    """Test statistics with their marks as text, one block of lines per horizon; every block needs both criteria."""
    blocks = []
    for horizon, table in tests.items():
        wide = dm_table(table, models)
        lines = wide.groupBy().agg(F.count_if(F.col("criterion").isin(list(PUBLISHED_CRITERIA))).alias("n")).scalar()
        line = lookup(F.col("criterion"), PUBLISHED_CRITERIA, default="keep")
        checked = F.when(lines < len(PUBLISHED_CRITERIA), F.raise_error(F.lit(f"{horizon}: a criterion has no row"))).otherwise(line)
        blocks.append(wide.select(F.lit(horizon).alias("horizon"), checked.alias("line"), *[F.col(f"`{m}`") for m in models]))
    return reduce(lambda a, b: a.unionByName(b), blocks)


def side_by_side(rows: DataFrame, order: DataFrame, entity: str, values: Sequence[str], line: str) -> DataFrame:
    """Entity blocks in two columns: the first half of the ordered entities left, the second half right."""
    n = order.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = rows.join(order, entity).withColumn("__half", F.ceil(n / 2).cast("bigint"))
    left = placed.where("ord < __half").select(F.col("ord").alias("block"), line, F.col(entity).alias("left"), *[F.col(v).alias(f"left_{v}") for v in values])
    right = placed.where("ord >= __half").select((F.col("ord") - F.col("__half")).alias("block"), line, F.col(entity).alias("right"), *[F.col(v).alias(f"right_{v}") for v in values])
    return left.join(right, ["block", line], "full")


def recoded(df: DataFrame, column: str, mapping: Mapping, strict: bool = False) -> DataFrame:
    return df.withColumn(column, lookup(column, mapping, "raise" if strict else "keep"))


def recode_by_table(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, strict: bool = False) -> DataFrame:
    """Recode by a two-column table; unmapped values stay, or are an error."""
    table = mapping.select(F.col(key).alias(column), F.col(value).alias("__mapped"))
    if strict:
        missing = df.select(column).distinct().join(table, column, "left_anti").limit(3).collect()
        if missing:
            raise ValueError(f"Unmapped values in {column}: {[r[0] for r in missing]}")
    joined = df.join(table, column, "left")
    return joined.select(*[F.coalesce("__mapped", F.col(c).cast("string")).alias(c) if c == column else F.col(c) for c in df.columns])
