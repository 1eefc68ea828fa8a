"""Entity-day panels, capitalisation-weighted aggregates and macro predictors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.signals import macro_spreads, scaled
from ..schema import rows_complete, rows_observed
from ..session import cut_lineage
from ..timeline import forward_fill


def session_axis(dates: DataFrame, date: str = "date") -> DataFrame:
    """Distinct days with their position and neighbours.

    The one window without partitions in the package: it sees one row per calendar day, at most 3.65 million for the
    years a date can hold, however long the fact table is.
    """
    by_date = Window.orderBy("date")
    return dates.select(F.col(date).cast("date").alias("date")).where("date is not null").distinct().select(
        "date",
        (F.row_number().over(by_date).cast("bigint") - 1).alias("pos"),
        F.lead("date").over(by_date).alias("next_date"),
    )


def previous_session(panel: DataFrame, axis: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Each cell's value one panel session later: re-keying by the next session needs no window and no dense grid."""
    return panel.join(axis.where("next_date is not null").select("date", "next_date"), "date").select(
        F.col("next_date").alias("date"), "bank", *[F.col(src).alias(out) for out, src in columns.items()])


def lag_panel(panel: DataFrame, value: str, out: str) -> DataFrame:
    """All cells that hold a value or a lagged value."""
    lagged = previous_session(panel, session_axis(panel), {out: value})
    return panel.select("date", "bank", value).join(lagged, ["date", "bank"], "full")


def select_entities(mapping: DataFrame, include: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """Requested entities in mapping order; names the mapping does not know are passed over, or an error if ``strict``
    (which runs a job)."""
    if not include:
        return mapping
    names = list(dict.fromkeys(include))
    chosen = mapping.where(F.col("bank").isin(names))
    if not strict:
        return chosen
    known = {r.bank for r in chosen.select("bank").distinct().collect()}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"Unknown entities: {unknown}")
    return chosen


def common_entities(mapping: DataFrame, values: DataFrame, caps: DataFrame, strict: bool = False) -> DataFrame:
    """Mapped entities both panels carry."""
    shared = mapping
    for panel in [values] if values is caps else [values, caps]:
        shared = shared.join(panel.select("bank").distinct(), "bank", "left_semi")  # one row per entity and task is shuffled, not the panel
    if strict and shared.isEmpty():
        raise ValueError("no mapped entity is in both panels")
    return shared


def common_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct days both panels carry."""
    days = left.select("date").distinct()
    return days if left is right else days.join(right.select("date").distinct(), "date", "left_semi")


def cap_weighted_average(values: DataFrame, caps: DataFrame, mapping: DataFrame, columns: Mapping[str, str],
                         cap: str = "cap") -> DataFrame:
    """Average over entities weighted by the previous session's market capitalisation, several columns at once.

    The numerator skips cells without value or weight; the denominator keeps every weight, so a missing value counts
    as zero. Without any weight on a day the result is NULL.
    """
    banks = common_entities(mapping, values, caps).select("bank")
    weights = previous_session(caps, session_axis(caps), {"__w": cap}).join(banks, "bank", "left_semi")
    cells = weights.join(values.select("date", "bank", *dict.fromkeys(columns.values())), ["date", "bank"], "left")
    sums = cells.groupBy("date").agg(
        F.sum("__w").alias("__weight"),
        *[F.sum(F.col(src) * F.col("__w")).alias(f"__{out}") for out, src in columns.items()])
    averaged = sums.select("date", *[
        F.try_divide(F.coalesce(f"__{out}", F.lit(0.0)), F.col("__weight")).alias(out) for out in columns])
    return common_dates(values, caps).join(averaged, "date", "left")


def cap_weighted_tables(tables: Sequence[tuple[DataFrame, Mapping[str, str]]], caps: DataFrame, mapping: DataFrame, cap: str = "cap") -> DataFrame:
    """``cap_weighted_average`` of several tables at once, each given with its columns (new name -> column).

    Lagged weights are built and summed once. Every table keeps its own entities and days: its columns are divided by the
    weights of the entities it carries, and are NULL on days it lacks. Days of any table that the caps carry too.
    """
    marked = [table.select("date", "bank", *[F.col(src).alias(f"__{out}") for out, src in columns.items()], F.lit(True).alias(f"__t{k}"))
              for k, (table, columns) in enumerate(tables)]
    cells = cut_lineage(reduce(lambda a, b: a.join(b, ["date", "bank"], "full"), marked), "cells")
    carried = [F.max(f"__t{k}").alias(f"__k{k}") for k in range(len(tables))]
    banks = cells.groupBy("bank").agg(*carried).join(mapping.select("bank").distinct(), "bank", "left_semi")
    days = cells.groupBy("date").agg(*carried).join(caps.select("date").distinct(), "date", "left_semi")
    weights = previous_session(caps, session_axis(caps), {"__w": cap}).join(banks, "bank")
    summed = weights.join(cells, ["date", "bank"], "left").groupBy("date").agg(
        *[F.sum(F.when(F.col(f"__k{k}"), F.col("__w"))).alias(f"__w{k}") for k in range(len(tables))],
        *[F.sum(F.col(f"__{out}") * F.col("__w")).alias(f"__{out}") for _, columns in tables for out in columns])
    averages = [F.when(F.col(f"__k{k}"), F.try_divide(F.coalesce(f"__{out}", F.lit(0.0)), F.col(f"__w{k}"))).alias(out)
                for k, (_, columns) in enumerate(tables) for out in columns]
    return days.join(summed, "date", "left").select("date", *averages)


def carry_forward(frame: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """Daily series joined to the frame's days, each holding its last released value.

    Releases on days outside the frame are not seen, and nothing is filled before the first release.
    """
    imported = []
    for source in sources:
        names = [c for c in source.columns if c != "date"]
        imported += [c for c in names if c not in frame.columns]
        frame = frame.join(rows_observed(source, names), "date", "left")
    return forward_fill(frame, imported, "date")


def macro_features(days: DataFrame, sources: Sequence[DataFrame], names: Mapping[str, str] | None = None,
                   keep: Sequence[str] = ("LS", "YS", "CS", "VIX", "Market_Return")) -> DataFrame:
    """Macro predictors on the given distinct days."""
    return macro_spreads(carry_forward(days, sources), dict(names or {})).select("date", *keep)


def assemble_entity_panel(target: DataFrame, predictors: Sequence[DataFrame], macro: DataFrame, target_column: str,
                          scale: float = -100.0) -> DataFrame:
    """Scaled target with its predictors for all entities in one plan; incomplete rows are dropped.

    ``predictors`` are long by ``(date, bank)``, ``macro`` is by ``date``.
    """
    out = target.select("date", "bank", scaled(F.col(target_column), scale).alias("target"))
    for table in predictors:
        out = out.join(table, ["date", "bank"], "left")
    return rows_complete(out.join(macro, "date", "left"))


def assemble_system_panel(values: DataFrame, caps: DataFrame, mapping: DataFrame, target_column: str,
                          predictors: Mapping[str, str] | None = None, macro: DataFrame | None = None,
                          scale: float = -100.0, cap: str = "cap", target_out: str = "ALL_CoVaR") -> DataFrame:
    """Weighted aggregate of target and predictors; without predictors the older target-only panel."""
    ready = values.withColumn(target_column, scaled(F.col(target_column), scale))
    columns = {target_out: target_column, **(predictors or {})}
    out = cap_weighted_average(ready, caps, mapping, columns, cap)
    if macro is not None:
        out = out.join(macro, "date", "left")
    return rows_complete(out)


def merge_sentiment(panel: DataFrame, sentiment: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Add the day's sentiment; days without it drop out."""
    return rows_complete(panel.join(sentiment, list(keys), "left"))
