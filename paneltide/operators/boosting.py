"""Gradient boosting of regression trees, all series at once.

Features are cut into equal bins between the least and the greatest training value of their series. A level of all trees is one
aggregate: residuals and rows per (series, node, feature, bin), added up in the tasks before they are shuffled. Running sums over
the few bins give every possible cut its gain, and the best cut of each node comes back to the rows by a join on series and
node. A series that holds most of the rows is only more rows in that aggregate, and thousands of series are no more jobs than one.

Residuals and predictions are whole numbers in units of 2**-30 of the label, so sums do not depend on the order they are taken
in and reruns give the same trees. Cuts of equal gain go to the first feature, then the lowest bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, drop_stage

UNIT = float(1 << 30)
KEY = "__key"


def binned(rows: DataFrame, series: Sequence[str], features: str, train: str, bins: int) -> DataFrame:
    """Adds ``__key`` (the series; a NULL is one like any other) and ``codes``: the bin of every feature. NULLs are in bin 0,
    values beyond the training range in the outermost bins."""
    keyed = rows.withColumn(KEY, F.struct(*series) if series else F.struct(F.lit(0).alias("all")))
    cells = keyed.where(train).select(KEY, F.posexplode(features).alias("at", "x"))
    edges = cells.groupBy(KEY, "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    edges = edges.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("edges"))
    width = lambda e: F.when(e["high"] > e["low"], (e["high"] - e["low"]) / bins)
    code = lambda x, e: F.coalesce(F.least(F.greatest(F.floor((x - e["low"]) / width(e)), F.lit(0)), F.lit(bins - 1)).cast("int"), F.lit(0))
    return keyed.join(edges, KEY).withColumn("codes", F.zip_with(features, "edges", code)).drop("edges")


def best_cuts(rows: DataFrame, rate: float) -> DataFrame:
    """The best cut of every node that has one, with the values of its two sides."""
    cells = rows.select(KEY, "node", "residual", F.posexplode("codes").alias("feature", "bin"))
    sums = cells.groupBy(KEY, "node", "feature", "bin").agg(F.sum("residual").alias("s"), F.count(F.lit(1)).alias("n"))
    of_feature = Window.partitionBy(KEY, "node", "feature")
    up_to = of_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = sums.select(KEY, "node", "feature", "bin", F.sum("s").over(up_to).alias("ls"), F.sum("n").over(up_to).alias("ln"),
                        F.sum("s").over(of_feature).alias("s"), F.sum("n").over(of_feature).alias("n")).where("ln < n")
    square = lambda s, n: F.col(s).cast("double") * F.col(s) / F.col(n)
    sides = sides.withColumns({"rs": F.col("s") - F.col("ls"), "rn": F.col("n") - F.col("ln")})
    gained = sides.withColumn("gain", square("ls", "ln") + square("rs", "rn") - square("s", "n")).where("gain > 0")
    value = lambda s, n: F.round(rate * F.col(s) / F.col(n)).cast("long")
    cut = F.struct("feature", F.col("bin").alias("cut"), value("ls", "ln").alias("low"), value("rs", "rn").alias("high"))
    return gained.groupBy(KEY, "node").agg(F.max_by(cut, F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("best")).select(KEY, "node", "best.*")


def boosted(rows: DataFrame, features: str, label: str, train: str, out: str, series: Sequence[str] = (), rounds: int = 100, rate: float = 0.1,
            depth: int = 3, bins: int = 64) -> DataFrame:
    """Rows with the prediction ``out`` of ``label``, learnt from the rows that ``train`` (a boolean column) marks; rows of a
    series without such rows are dropped. ``features`` is an array column of one length."""
    if min(rounds, depth) < 1 or not 0 < rate <= 1 or bins < 2:
        raise ValueError(f"need rounds and depth from 1, 0 < rate <= 1 and two bins, not {rounds}, {depth}, {rate}, {bins}")
    whole = F.round(F.col(label).cast("double") * UNIT).cast("long")
    given = binned(rows, series, features, train, bins).withColumn("whole", whole)
    base = given.where(train).groupBy(KEY).agg(F.round(F.sum("whole") / F.count(F.lit(1))).cast("long").alias("made"))
    state = cut_lineage(given.join(base, KEY).withColumn("residual", F.col("whole") - F.col("made")).drop("whole", features), "boosting")
    for _ in range(rounds):
        grown = state.withColumns({"node": F.lit(1), "value": F.lit(0).cast("long")})
        for _ in range(depth):
            cuts = cut_lineage(best_cuts(grown.where(train), rate), "cuts")
            joined = grown.join(cuts, [KEY, "node"], "left")
            right = F.element_at("codes", F.col("feature") + 1) > F.col("cut")
            grown = joined.withColumns({
                "value": F.when(F.col("feature").isNull(), F.col("value")).when(right, F.col("high")).otherwise(F.col("low")),
                "node": F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("int"))}).drop("feature", "cut", "low", "high")
        moved = grown.withColumns({"made": F.col("made") + F.col("value"), "residual": F.col("residual") - F.col("value")}).drop("node", "value")
        before, state = state, cut_lineage(moved.select(*state.columns), "boosting")
        drop_stage(before)
    return state.withColumn(out, F.col("made") / UNIT).drop(KEY, "codes", "made", "residual")
