"""Wide daily panels to long form, and the entity mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import to_day
from ..schema import BANK_MAPPING, number_or_null, require_columns, required
from .csv_records import ENCODINGS, CsvRecords


def read_mapping(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None) -> DataFrame:
    """Entity mapping in any of the known encodings; its row order is kept in ``ord``, 0 to n - 1 over all files, because
    it decides the order of report columns. Rows are numbered where they are read, from the sums of what stands before."""
    raw = CsvRecords(spark, path, [encoding] if encoding else ENCODINGS).cells(numbered="ord")
    require_columns(raw, BANK_MAPPING.names, "bank mapping")
    return raw.select(F.col("bank_code").cast("bigint"), F.col("bank").cast("string"), "ord")


def stack_panel(df: DataFrame, labels: Mapping[str, tuple[str, str]], date: str = "date") -> DataFrame:
    """Wide to long in one pass: ``labels`` gives entity and indicator of each value column."""
    cells = [F.struct(F.lit(bank).alias("bank"), F.lit(indicator).alias("indicator"), number_or_null(df, name).alias("value"))
             for name, (bank, indicator) in labels.items()]
    return df.select(F.col(date).alias("date"), F.inline(F.array(*cells)))


def read_price_panel(spark: SparkSession, path: str, header_rows: int = 3) -> DataFrame:
    """Panel with stacked header rows (group, entity, indicator) as ``date, bank, indicator, value``. Files may differ in
    encoding but not in their header. A row without a date is dropped, one whose date cannot be read stops the job."""
    found = CsvRecords(spark, path, header_rows=header_rows)
    headers = {tuple(map(tuple, layout.header)) for layout in found.layouts}
    if len(headers) != 1:
        raise ValueError(f"{path}: files of one header are needed, found {len(headers)}")
    levels = headers.pop()
    rows = found.positional().where(F.trim("c0") != "")
    body = rows.withColumn("date", required(to_day("c0"), F.concat(F.lit(f"{path}: unreadable date "), F.col("c0"))))
    labels = {f"c{i}": (levels[-2][i], levels[-1][i]) for i in range(1, len(levels[0]))}
    return stack_panel(body, labels)


def select_indicator(panel: DataFrame, indicator: str) -> DataFrame:
    return panel.where(F.col("indicator") == indicator).drop("indicator")


def without_index_series(panel: DataFrame, word: str = "金融指数") -> DataFrame:
    """Drop sector index series that sit among the entities."""
    return panel.where(~F.contains("bank", F.lit(word)))


def unpivot_panel(df: DataFrame, date: str, mapping: DataFrame | None = None, value: str = "value",
                  suffix: str = "") -> DataFrame:
    """One row per date and entity column; with a mapping, mapped entities only."""
    columns = [c for c in df.columns if c != date]
    wide = df.select(F.col(date).alias("date"), *[number_or_null(df, c).alias(c.removesuffix(suffix)) for c in columns])
    long = wide.unpivot(["date"], [c.removesuffix(suffix) for c in columns], "bank", value)
    return long if mapping is None else long.join(mapping.select("bank"), "bank", "left_semi").select("date", "bank", value)


def select_entity(df: DataFrame, date: str, entity: str, out: str) -> DataFrame:
    """One entity column of a wide panel; an unknown entity is an error."""
    if entity not in df.columns:
        raise ValueError(f"{entity} not found in the panel")
    return df.select(F.col(date).alias("date"), number_or_null(df, entity).alias(out))


def inner_join_tables(frames: Sequence[DataFrame], renames: Mapping[str, str], date: str = "date") -> DataFrame:
    """Keep the dates all tables share; pick and rename columns."""
    joined = frames[0]
    for other in frames[1:]:
        joined = joined.join(other, date, "inner")
    return joined.withColumnsRenamed(dict(renames))
