"""Row order inside very long series.

A plain window sends a whole series to one task. Here a series is cut into blocks that are consecutive in its order,
so the largest unit of work is one block, however many rows one series holds. Results are the same as those of the
plain window: what crosses a block edge is carried either by a table with one row per block or by copying the few
edge rows a frame can reach.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .session import cut_lineage

BLOCK_ROWS = 4096
_BLOCK = "__block"
_START = "__start"
_SERIES = "__series"


def day_block(order: str, days: int = BLOCK_ROWS) -> Column:
    """Block number of a date column; a daily series has at most ``days`` rows in each."""
    return F.floor(F.unix_date(F.col(order).cast("date")) / F.lit(days))


def default_block(df: DataFrame, order: str) -> Column:
    """Days for a date column; seconds for a timestamp, so that a series sampled every second still splits."""
    if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(BLOCK_ROWS))
    return day_block(order)


def _ordered(series: Sequence[str]):
    return Window.partitionBy(*series).orderBy(_BLOCK)


def _keyed(df: DataFrame, order: str, series: Sequence[str], block: Column | None) -> tuple[DataFrame, list[str]]:
    """Rows with their block, and the columns that name their series: one struct, which is equal to itself even where a
    part of it is NULL, so that a join loses no row. A NULL in the order column has no place and stops the job."""
    placed = F.coalesce(default_block(df, order) if block is None else block, F.raise_error(F.lit(f"NULL in the order column {order}")))
    keyed = df.withColumn(_BLOCK, placed)
    return (keyed.withColumn(_SERIES, F.struct(*series)), [_SERIES]) if series else (keyed, [])


def row_index(df: DataFrame, order: str, series: Sequence[str] = (), index: str = "i", total: str | None = None,
              block: Column | None = None) -> DataFrame:
    """Add the 0-based position of each row in its series and, if asked, the series length.

    ``block`` must be monotone in ``order``; by default it is derived from the date or time.
    """
    keyed, series = _keyed(df, order, series, block)
    sizes = keyed.groupBy(*series, _BLOCK).agg(F.count(F.lit(1)).alias("__rows"))
    before = _ordered(series).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *series, _BLOCK,
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias(_START),
        F.sum("__rows").over(Window.partitionBy(*series)).alias("__total"),
    )
    inside = Window.partitionBy(*series, _BLOCK).orderBy(order)
    numbered = keyed.join(starts, [*series, _BLOCK]).withColumn(
        index, F.row_number().over(inside).cast("bigint") - 1 + F.col(_START))
    if total:
        numbered = numbered.withColumn(total, F.col("__total"))
    return numbered.select(*df.columns, index, *([total] if total else []))


def in_blocks(df: DataFrame, index: str, series: Sequence[str], columns: Mapping[str, object], before: int = 0,
              after: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Evaluate window frames of bounded reach block by block.

    ``columns`` maps an output name to a function of the window specification (partitioned by series and block,
    ordered by ``index``). A frame may look ``before`` index steps back and ``after`` steps ahead: rows that near to an
    edge are copied into the neighbour block and removed again afterwards.
    """
    at = F.col(index)
    home = F.floor(at / F.lit(block_rows))
    first, last = F.floor((at - after) / F.lit(block_rows)), F.floor((at + before) / F.lit(block_rows))
    spread = df.withColumn(_BLOCK, F.explode(F.sequence(first, last))) if before or after else df.withColumn(_BLOCK, home)
    window = Window.partitionBy(*series, _BLOCK).orderBy(index)
    out = spread.select("*", *[build(window).alias(name) for name, build in columns.items()])
    if before or after:
        out = out.where(F.col(_BLOCK) == home)
    return out.drop(_BLOCK)


def shift_rows(df: DataFrame, columns: Mapping[str, str], k: int, index: str, series: Sequence[str] = (),
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Value ``k`` rows earlier (``k`` > 0) or later (``k`` < 0), given a dense row index."""
    def lagged(name):
        return lambda window: F.lag(name, k).over(window)

    return in_blocks(df, index, series, {out: lagged(src) for out, src in columns.items()},
                     before=max(k, 0), after=max(-k, 0), block_rows=max(block_rows, abs(k)))


def forward_fill(df: DataFrame, columns: Sequence[str], order: str, series: Sequence[str] = (),
                 block: Column | None = None) -> DataFrame:
    """Carry the last observed value forward along ``order``; nothing is filled backwards."""
    keyed, series = _keyed(df, order, series, block)
    tails = keyed.groupBy(*series, _BLOCK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__tail_{c}") for c in columns])
    earlier = _ordered(series).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *series, _BLOCK, *[F.last(f"__tail_{c}", ignorenulls=True).over(earlier).alias(f"__carry_{c}") for c in columns])
    inside = Window.partitionBy(*series, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = keyed.join(carried, [*series, _BLOCK])
    wanted = set(columns)
    return filled.select(*[
        F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__carry_{c}")).alias(c) if c in wanted else F.col(c)
        for c in df.columns])


def running_total(df: DataFrame, value: str, order: str, block: Column, out: str, series: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sum of ``value``."""
    keyed, series = _keyed(df, order, series, block)
    sums = keyed.groupBy(*series, _BLOCK).agg(F.sum(value).alias("__sum"))
    earlier = _ordered(series).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*series, _BLOCK, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias(_START))
    inside = Window.partitionBy(*series, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (keyed.join(starts, [*series, _BLOCK])
            .select(*df.columns, (F.sum(value).over(inside) + F.col(_START)).alias(out)))


def running_offsets(df: DataFrame, value: str, order: Sequence[str], out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before a row in ``order``, which must tell rows apart.

    The rows are range-partitioned and written; each written part is a block that is consecutive in the order, so only one
    sum per part has to be brought into order by itself, and no task sees more than its part."""
    parts = cut_lineage(df.repartitionByRange(*order), "ordered")
    marked = parts.withColumn(_BLOCK, F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))
    earlier = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = marked.groupBy(_BLOCK).agg(F.sum(value).alias("__sum")).select(_BLOCK, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias(_START))
    inside = Window.partitionBy(_BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (marked.join(starts, _BLOCK)
            .select(*df.columns, (F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(_START)).alias(out)))
