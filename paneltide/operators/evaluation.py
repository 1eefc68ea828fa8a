"""Error metrics, Diebold-Mariano statistics and classification scores.

Regression operators take long rows ``model, y, p``; every one of them is a single aggregation over partial sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.reporting import fixed, stars
from ..functions.student_t import t_test_p
from ..functions.text import lookup
from ..schema import required

# Display name of each model column.
MODEL_LABELS = {"Informer": "Informer", "Persistence": "Persistence", "AR1": "AR(1)", "ETS": "ETS", "GBR": "GBR", "PatchTST": "PatchTST"}


def long_predictions(df: DataFrame, actual: str, predictions: Sequence[str], keep: Sequence[str] = (), suffix: str = "_pred") -> DataFrame:
    """One row per forecast and model."""
    cells = [F.struct(F.lit(c.removesuffix(suffix)).alias("model"), F.col(c).cast("double").alias("p")) for c in predictions]
    return df.select(*keep, F.col(actual).cast("double").alias("y"), F.inline(F.array(*cells)))


def model_label(name: Column) -> Column:
    return lookup(name, MODEL_LABELS, default="keep")


def _errors():
    e = F.col("y") - F.col("p")
    return e, e * e


def error_metrics(long: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    e, e2 = _errors()
    mse, spread = F.avg(e2), F.var_pop("y")
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), mse.alias("MSE"), F.sqrt(mse).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"),
        (1 - F.try_divide(mse, spread)).alias("R2"))


def error_metrics_pct(long: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """With percentage errors; a zero actual counts as 1e-9."""
    e, e2 = _errors()
    safe = F.when(F.col("y") == 0, 1e-9).otherwise(F.col("y"))
    mse = F.avg(e2)
    return long.groupBy(*by).agg(
        mse.alias("MSE"), F.avg(F.abs(e)).alias("MAE"), F.sqrt(mse).alias("RMSE"), (1 - F.try_divide(mse, F.var_pop("y"))).alias("R2"),
        (F.avg(F.abs(e / safe)) * 100).alias("MAPE"), (F.avg((e / safe) * (e / safe)) * 100).alias("MSPE"))


def error_metrics_raw(long: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Relative errors as fractions. A zero actual makes them infinite, or undefined if the error is zero too."""
    e, e2 = _errors()
    ratio = F.when(F.col("y") != 0, F.try_divide(e, F.col("y"))).otherwise(F.when(e != 0, float("inf")).otherwise(float("nan")))
    mse = F.avg(e2)
    return long.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("MAE"), mse.alias("MSE"), F.sqrt(mse).alias("RMSE"),
        F.avg(F.abs(ratio)).alias("MAPE"), F.avg(ratio * ratio).alias("MSPE"))


#: Powers of (y - mean, p - mean) whose sums are carried, beside the count and the means.
MOMENTS = [(2, 0), (1, 1), (0, 2), (2, 1), (1, 2), (2, 2)]


def _block_moments(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per block of rows and group: count, means, centred co-moments and squared error."""
    names = [f"m{i}{j}" for i, j in MOMENTS]

    def work(blocks):
        for rows in blocks:
            keys = rows[list(by)]
            code = keys.groupby(list(by), dropna=False, sort=False).ngroup() if by else keys.assign(code=0)["code"]
            y, p = rows["y"].astype(float), rows["p"].astype(float)
            code = code[y.notna() & p.notna()]
            y, p, keys = y[code.index], p[code.index], keys.loc[code.index]
            dy, dp = y - y.groupby(code).transform("mean"), p - p.groupby(code).transform("mean")
            sums = {f"m{i}{j}": (dy ** i * dp ** j).groupby(code).sum() for i, j in MOMENTS}
            out = keys.groupby(code).first() if by else keys.iloc[:0]
            done = out.assign(**{"n": code.groupby(code).size(), "my": y.groupby(code).mean(), "mp": p.groupby(code).mean(), "e2": ((y - p) ** 2).groupby(code).sum()}, **sums) if by else (
                keys.__class__({"n": code.groupby(code).size(), "my": y.groupby(code).mean(), "mp": p.groupby(code).mean(), "e2": ((y - p) ** 2).groupby(code).sum(), **sums}))
            yield done.reset_index(drop=True)

    kinds = dict(long.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n long", *[f"{c} double" for c in ("my", "mp", "e2", *names)]])
    return long.select(*by, "y", "p").mapInPandas(work, schema)


def rse_corr(long: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Root relative squared error, and the product-normalised correlation sum(dy*dp) / sqrt(sum(dy^2 * dp^2)).

    One pass: blocks of rows are summarised around their own means, and their moments are moved to the mean of the group by
    the binomial theorem, so large offsets cost no digits and nothing is joined."""
    blocks = _block_moments(long, by)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = F.sum("n").over(group)
    moved = blocks.withColumns({"gy": F.col("my") - F.sum(F.col("n") * F.col("my")).over(group) / n, "gp": F.col("mp") - F.sum(F.col("n") * F.col("mp")).over(group) / n})
    known = {(0, 0): F.col("n").cast("double"), **{(i, j): F.col(f"m{i}{j}") for i, j in MOMENTS}}  # first moments are zero

    def about_group(i, j):
        terms = [comb(i, a) * comb(j, b) * F.pow("gy", F.lit(float(i - a))) * F.pow("gp", F.lit(float(j - b))) * known[a, b]
                 for a in range(i + 1) for b in range(j + 1) if (a, b) in known]
        return F.sum(sum(terms[1:], terms[0]))

    sums = moved.groupBy(*by).agg(F.sum("e2").alias("e2"), about_group(2, 0).alias("yy"), about_group(1, 1).alias("yp"), about_group(2, 2).alias("yypp"))
    return sums.select(*by, F.try_divide(F.sqrt("e2"), F.sqrt("yy")).alias("RSE"), F.try_divide(F.col("yp"), F.sqrt("yypp")).alias("CORR"))


CRITERIA = {"MAD": F.abs, "MSE": lambda e: e * e}


def dm_statistics(df: DataFrame, actual: str, baseline: str, comparators: Sequence[str], by: Sequence[str] = (),
                  strict: bool = False, suffix: str = "_pred") -> DataFrame:
    """Mean loss difference (baseline minus comparator) over its standard error with the small-sample factor for one
    step. Negative favours the baseline. Without variance there is no statistic; ``strict`` makes that an error."""
    y, b = F.col(actual), F.col(baseline)
    cells = [F.struct(F.lit(name).alias("criterion"), F.lit(c.removesuffix(suffix)).alias("model"),
                      (loss(y - b) - loss(y - F.col(c))).alias("d"))
             for name, loss in CRITERIA.items() for c in comparators]
    d = df.select(*by, F.inline(F.array(*cells)))
    sums = d.groupBy(*by, "criterion", "model").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("variance"))
    n = F.col("n").cast("double")
    error = F.when(F.col("variance") > 0, F.sqrt(F.col("variance") / n))
    if strict:
        error = required(error, "the losses of the two forecasts differ by a constant; there is nothing to test")
    return sums.select(*by, "criterion", "model", "n", (F.col("mean") / error * F.sqrt((n - 1) / n)).alias("statistic"))


def dm_tests(*args, **kwargs) -> DataFrame:
    """Statistics with their two-sided p-value, n - 1 degrees of freedom."""
    out = dm_statistics(*args, **kwargs)
    return out.withColumn("p_value", t_test_p(F.col("statistic"), F.col("n").cast("double") - 1))


def dm_table(tests: DataFrame, models: Sequence[str]) -> DataFrame:
    """Wide table: one row per criterion, statistic and stars per comparator."""
    text = F.concat(fixed(F.col("statistic"), 3), stars(F.col("p_value")))
    return tests.withColumn("cell", text).groupBy("criterion").pivot("model", list(models)).agg(F.first("cell"))


def confusion(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(predicted).alias("pred")).agg(F.count(F.lit(1)).alias("rows"))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction; undefined ratios are 0."""
    sides = counts.select(*by, "rows", (F.col("label") == F.col("pred")).alias("hit"), F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("as_label")),
        F.struct(F.col("pred").alias("class"), F.lit(0).alias("as_label")))))
    rows = F.col("rows")
    tallies = sides.groupBy(*by, "class").agg(
        F.sum(F.when(F.col("as_label") == 1, rows).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("as_label") == 0, rows).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("as_label") == 1) & F.col("hit"), rows).otherwise(0)).alias("hits"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return tallies.select(*by, "class", "support", "hits", ratio(hits, predicted).alias("precision"),
                          ratio(hits, support).alias("recall"), ratio(2 * hits, support + predicted).alias("f1"))


def weighted_prf(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    scores = class_scores(confusion(df, label, predicted, by), by)
    total, weight = F.sum("support").cast("double"), F.col("support").cast("double")
    return scores.groupBy(*by).agg(
        (F.sum("hits") / total).alias("accuracy"),
        *[(F.sum(weight * F.col(m)) / total).alias(m) for m in ("precision", "recall", "f1")])


def predicted_class(scores: str | Column) -> Column:
    """Position of the largest score, counted from 0; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def macro_prf_by_step(df: DataFrame, label: str, scores: str, step: str, out: str = "Day") -> DataFrame:
    """Accuracy and unweighted class averages for every horizon step."""
    ready = df.select((F.col(step) + 1).alias(out), F.col(label).alias("label"), predicted_class(scores).alias("pred"))
    classes = class_scores(confusion(ready, "label", "pred", [out]), [out])
    return classes.groupBy(out).agg(
        (F.sum("hits").cast("double") / F.sum("support")).alias("Accuracy"), F.avg("precision").alias("Precision"),
        F.avg("recall").alias("Recall"), F.avg("f1").alias("F1_Score"))


def average_over_iterations(metrics: DataFrame, keys: Sequence[str] = ("bank", "spec"),
                            values: Sequence[str] = ("MSE", "MAE", "RMSE", "R2"), split: str = "split") -> DataFrame:
    return test_rows(metrics, split).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def test_rows(metrics: DataFrame, split: str = "split", name: str = "test") -> DataFrame:
    return metrics.where(F.col(split) == name)


def label_metrics(metrics: DataFrame, labels: Mapping[str, str] = MODEL_LABELS) -> DataFrame:
    return metrics.withColumn("model", lookup("model", labels))
