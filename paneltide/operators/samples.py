"""Calendar-exact look-back samples and leak-free splits.

``i`` counts the rows of a series, ``pos`` counts calendar sessions: split boundaries use ``i``; leads and contiguity
use ``pos``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import fail_if, required
from ..timeline import BLOCK_ROWS, in_blocks, row_index


def calendar_position(df: DataFrame, axis: DataFrame, date: str = "date", out: str = "pos",
                      on_unknown: str = "raise") -> DataFrame:
    """Session number of each row's day; a day outside the calendar stops the job, gives NULL or drops the row."""
    known = axis.select(F.col("date").alias("__day"), F.col("pos").alias("__pos"))
    joined = df.join(known, F.col(date).cast("date") == F.col("__day"), "inner" if on_unknown == "drop" else "left")
    pos = F.col("__pos")
    if on_unknown == "raise":
        text = F.concat(F.lit("Date absent from the trading calendar: "), F.coalesce(F.col(date).cast("string"), F.lit("NULL")))
        pos = required(pos, text)
    return joined.select(*df.columns, pos.alias(out))


def unknown_dates(df: DataFrame, axis: DataFrame, date: str = "date") -> DataFrame:
    return df.select(date).distinct().join(axis.select(F.col("date").alias(date)), date, "left_anti")


def exact_lead(df: DataFrame, columns: Mapping[str, str], lead: int, series: Sequence[str] = (), pos: str = "pos",
               how: str = "inner") -> DataFrame:
    """Values of the row exactly ``lead`` sessions ahead. If that session is missing the sample is dropped (or NULL
    with ``how="left"``), never replaced by a neighbour. The join key contains the session, so a long series spreads."""
    if lead < 1:
        raise ValueError("lead must be positive")
    ahead = df.select(*series, (F.col(pos) - lead).alias(pos), *[F.col(src).alias(out) for out, src in columns.items()])
    return df.join(ahead, [*series, pos], how)


def contiguous_history(df: DataFrame, lags: int, series: Sequence[str] = (), pos: str = "pos",
                       out: str = "contiguous", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Flag rows whose last ``lags`` sessions are all present."""
    def full(window):
        return F.count(F.lit(1)).over(window.rangeBetween(-(lags - 1), 0)) == lags

    return in_blocks(df, pos, series, {out: full}, before=lags - 1, block_rows=max(block_rows, lags))


def lookback_windows(df: DataFrame, channels: Sequence[str], lags: int, series: Sequence[str] = (), pos: str = "pos",
                     out: str = "window", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Matrix of the last ``lags`` sessions (oldest first, one array per session) for every row that has them all."""
    def matrix(window):
        return F.collect_list(F.array(*[F.col(c).cast("double") for c in channels])).over(window.rangeBetween(-(lags - 1), 0))

    cut = in_blocks(df, pos, series, {out: matrix}, before=lags - 1, block_rows=max(block_rows, lags))
    return cut.where(F.size(out) == lags)


def decoder_input(window: str, label_len: int, channels: int, label: Column | None = None) -> Column:
    """Last ``label_len`` rows of the window and a masked row; the masked row may carry the label in its last cell."""
    masked = [F.lit(0.0)] * (channels - 1) + [F.lit(0.0) if label is None else label.cast("double")]
    return F.concat(F.slice(window, -label_len, label_len), F.array(F.array(*masked)))


def sliding_samples(df: DataFrame, value: str, seq_len: int, label_len: int, pred_len: int,
                    series: Sequence[str] = (), index: str = "i", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Overlapping samples: ``seq_len`` rows in, ``label_len`` known plus ``pred_len`` future rows out."""
    reach = max(seq_len - 1, label_len - 1)

    def frame(start, end):
        return lambda window: F.collect_list(F.struct(F.col(index), F.col(value).alias("v"))).over(window.rowsBetween(start, end))

    cut = in_blocks(df, index, series, {"x": frame(-(seq_len - 1), 0), "y": frame(-(label_len - 1), pred_len)},
                    before=reach, after=pred_len, block_rows=max(block_rows, reach + pred_len))
    full = cut.where((F.size("x") == seq_len) & (F.size("y") == label_len + pred_len))
    return full.select(*series, (F.col(index) - (seq_len - 1)).alias("sample"), F.col("x.v").alias("x"), F.col("y.v").alias("y"))


def share(n: Column, ratio: float) -> Column:
    """Whole rows in a share, in double arithmetic: 0.7 of 90 rows is 62."""
    return F.floor(n.cast("double") * F.lit(float(ratio)))


def chrono_split(df: DataFrame, seq_len: int, index: str = "i", total: str = "n", train: float = 0.7,
                 test: float = 0.2) -> DataFrame:
    """Ordered train / val / test segments; val and test start ``seq_len`` rows early, so a row may be in two."""
    i, n = F.col(index), F.col(total)
    n_train, n_test = share(n, train), share(n, test)
    return _segments(df, {
        "train": (F.lit(0), n_train),
        "val": (n_train - seq_len, n - n_test),
        "test": (n - n_test - seq_len, n),
    }, i)


def fixed_split(df: DataFrame, seq_len: int, unit: int, index: str = "i", sizes: Sequence[int] = (12, 4, 4)) -> DataFrame:
    """Segments of fixed length (12, 4 and 4 units of rows), with the same look-back overlap."""
    first, second, third = (unit * s for s in sizes)
    return _segments(df, {
        "train": (F.lit(0), F.lit(first)),
        "val": (F.lit(first - seq_len), F.lit(first + second)),
        "test": (F.lit(first + second - seq_len), F.lit(first + second + third)),
    }, F.col(index))


def _segments(df: DataFrame, borders: Mapping[str, tuple[Column, Column]], i: Column) -> DataFrame:
    names = [F.when((i >= start) & (i < end), name) for name, (start, end) in borders.items()]
    return df.withColumn("segment", F.explode(F.array_compact(F.array(*names))))


def embargo_two_way(origin: Column, target: Column, fit_end: Column) -> Column:
    """Training labels end before ``fit_end``; test origins start at the last training row; what straddles is NULL."""
    return F.when(target < fit_end, "train").when(origin >= fit_end - 1, "test")


def embargo_three_way(origin: Column, target: Column, train_end: Column, test_start: Column) -> Column:
    """Split by target; validation and test origins must have seen every label of the segment before."""
    return (F.when(target < train_end, "train")
            .when(target < test_start, F.when(origin >= train_end - 1, "val"))
            .otherwise(F.when(origin >= test_start - 1, "test")))


def prepare_samples(df: DataFrame, axis: DataFrame, target: str, features: Sequence[str] = (), lead: int = 1, lags: int = 5,
                    train_ratio: float = 0.7, series: Sequence[str] = (), ways: int = 2, test_ratio: float = 0.2,
                    on_unknown: str = "raise", windows: bool = True) -> DataFrame:
    """One row per usable origin: position, window, exact-lead target and split.

    Columns: series, ``origin_date, i, n, fit_end, pos, x, target_date, target_i, target, split`` and ``window`` with
    the target as first channel.
    """
    if not 0.0 < train_ratio < 1.0 or lags < 1:
        raise ValueError(f"need 0 < train_ratio < 1 and lags >= 1, not {train_ratio} and {lags}")
    names = [target, *[f for f in features if f != target]]
    channels = [f"__c{k}" for k in range(len(names))]
    values = df.select(*series, "date", *[F.col(c).alias(a) for c, a in zip(names, channels)])
    rows = calendar_position(row_index(values, "date", series, "i", total="n"), axis, on_unknown=on_unknown)
    cut = (lookback_windows(rows, channels, lags, series) if windows
           else contiguous_history(rows, lags, series).where("contiguous"))
    origins = cut.select(*series, F.col("date").alias("origin_date"), "i", "n", share(F.col("n"), train_ratio).alias("fit_end"),
                         "pos", F.col(channels[0]).alias("x"), *(["window"] if windows else []))
    ahead = rows.select(*series, (F.col("pos") - lead).alias("pos"), F.col("date").alias("target_date"),
                        F.col("i").alias("target_i"), F.col(channels[0]).alias("target"))
    if ways == 2:
        split = embargo_two_way(F.col("i"), F.col("target_i"), F.col("fit_end"))
    else:
        split = embargo_three_way(F.col("i"), F.col("target_i"), F.col("fit_end"), F.col("n") - share(F.col("n"), test_ratio))
    out = origins.join(ahead, [*series, "pos"]).withColumn("split", split).where("split is not null")
    return out.select(*series, "origin_date", "i", "n", "fit_end", "pos", "x", "target_date", "target_i", "target", "split",
                      *(["window"] if windows else []))


def require_segments(samples: DataFrame, lags: int, series: Sequence[str] = ()) -> DataFrame:
    """Samples whose series all have a training segment longer than ``lags`` and rows in both segments; else an error
    that names the first offenders. One action, of one row per series."""
    facts = samples.groupBy(*series).agg(F.max("fit_end").alias("fit_end"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    short = facts.where((F.coalesce("fit_end", F.lit(0)) <= lags) | (F.col("train") == 0) | (F.col("test") == 0)).limit(3).collect()
    if short:
        raise ValueError("too little history to fit and test on: " + "; ".join(str(r.asDict()) for r in short))
    return samples


def future_stamps(df: DataFrame, freq: str, seq_len: int, pred_len: int, series: Sequence[str] = (),
                  date: str = "date", block: Column | None = None) -> DataFrame:
    """Last ``seq_len`` stamps of every series followed by ``pred_len`` generated ones."""
    tail = row_index(df.select(*series, date), date, series, "i", total="n", block=block)
    known = tail.where(F.col("i") >= F.col("n") - seq_len).select(*series, F.col(date).alias("date"), F.lit(False).alias("generated"))
    last = df.groupBy(*series).agg(F.max(date).alias("last")).where("last is not null")
    made = last.select(*series, F.explode(_stamps_after(F.col("last"), freq, pred_len)).alias("date"), F.lit(True).alias("generated"))
    return known.unionByName(made.select(*series, F.col("date").cast(df.schema[date].dataType).alias("date"), "generated"))


# Length of one step of each supported frequency, in seconds.
STEP_SECONDS = {"d": 86400, "h": 3600, "t": 60, "min": 60, "s": 1}


def _stamps_after(last: Column, freq: str, count: int) -> Column:
    digits = "".join(ch for ch in freq if ch.isdigit())
    unit, every = freq[len(digits):].lower(), int(digits or 1)
    if unit == "b":
        # Five working days fit in any seven days, so this many candidates always suffice.
        days = F.transform(F.sequence(F.lit(0), F.lit((count + 1) * every * 2 + 7)), lambda k: F.date_add(last, k))
        working = F.filter(days, lambda d: F.weekday(d) < 5)
        return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.element_at(working, k * every + 1))
    # Ends of weeks (Sunday), months, quarters and years: the first end not before ``last`` is where counting starts.
    day = last.cast("date")
    ends = {"w": (F.date_add(day, 6 - F.weekday(day)), None), "m": (F.last_day(day), 1), "q": (F.last_day(F.add_months(F.trunc(day, "quarter"), 2)), 3),
            "y": (F.last_day(F.add_months(F.trunc(day, "year"), 11)), 12), "a": (F.last_day(F.add_months(F.trunc(day, "year"), 11)), 12)}
    if unit in ends:
        first, months = ends[unit]
        step = (lambda k: F.date_add(first, 7 * every * k)) if months is None else (lambda k: F.last_day(F.add_months(first, months * every * k)))
        return F.transform(F.sequence(F.lit(1), F.lit(count)), step)
    if unit not in STEP_SECONDS:
        raise ValueError(f"Unsupported frequency {freq}")
    step = STEP_SECONDS[unit] * every
    return F.transform(F.sequence(F.lit(1), F.lit(count)),
                       lambda k: F.timestamp_seconds(F.unix_seconds(last.cast("timestamp")) + k * step))


def forecast_identity(windows: DataFrame, values: str = "forecast", order: str = "origin_date", series: Sequence[str] = ()) -> DataFrame:
    """Joint forecasts to rows: window number, step, first forecast day. ``values`` is array<struct<date,...>>."""
    numbered = row_index(windows, order, series, "window_id")
    return numbered.select(
        *series, "window_id", F.col(values)[0]["date"].alias("forecast_start"), F.posexplode(values).alias("step", "f"),
    ).select(*series, "window_id", "forecast_start", (F.col("step") + 1).alias("horizon"), "f.*")


def recover_horizons(archive: DataFrame, lead: int, date: str = "date", place: str | None = None) -> DataFrame:
    """Window and horizon of each row of an archive that kept only its dates, sorted by date.

    Row counts decide: with W windows over W + lead - 1 consecutive days, day r belongs to the windows that start in
    the last ``lead`` days up to r. Anything else is rejected. Without ``place`` the result is one row (date, window_id, horizon)
    per archive row. ``place`` names the number of a row in the file, 0 to n - 1: then every row keeps its columns and
    gets its own window, equal dates in the order of their windows, and a file in another order is rejected. A day's rows
    stand together, so a row's rank in its day is its place less the day's first, and no day is ever sorted.
    """
    from .panel import session_axis

    day = F.col(date).cast("date")
    spans = [F.min(place).alias("low"), F.max(place).alias("high")] if place else []
    per_day = archive.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("rows"), *spans)
    axis = session_axis(per_day.select(F.col("__day").alias("date"))).select(F.col("date").alias("__day"), "pos")
    ranked = per_day.join(axis, "__day")
    sizes = per_day.agg(F.sum("rows").alias("total"), F.count(F.lit(1)).alias("days"))
    one = sizes.select(F.struct("*").alias("s")).scalar()
    ranked = ranked.select("*", one["total"].alias("total"), one["days"].alias("days"))
    count = F.floor(F.col("total") / lead)
    first = F.greatest(F.lit(0), F.col("pos") - (lead - 1))
    last = F.least(F.col("pos"), count - 1)
    wrong = (F.col("total") % lead != 0) | (F.col("days") != count + lead - 1) | (F.col("rows") != last - first + 1)
    if place:
        # Rows of earlier days: windows that ended before count in full, those still open by the days since their start.
        ended, begun = F.least(F.greatest(F.col("pos") - lead + 1, F.lit(0)), count), F.least(count, F.col("pos"))
        still = F.col("pos") * (begun - ended) - F.floor((begun * (begun - 1) - ended * (ended - 1)) / 2)
        start = ended * lead + still
        moved = (F.col("low") != start) | (F.col("high") != F.col("low") + F.col("rows") - 1)
        known = ranked.select("__day", "pos", "low", fail_if(wrong | moved, "the rows do not stand as windows that start on consecutive days would, sorted by day; their counts or their order do not fit", first).alias("first"))
        found = archive.withColumn("__day", day).join(known, "__day", "left")
        window = required(F.col("first"), "an archive row has no day") + F.col(place) - F.col("low")
        return found.select(*[F.col(f"`{c}`") for c in archive.columns], window.alias("window_id"), "pos").withColumn("horizon", F.col("pos") - F.col("window_id") + 1).drop("pos")
    windows = fail_if(wrong, "the rows per day do not fit windows that start on consecutive days", F.sequence(first, last))
    return ranked.select(F.col("__day").alias("date"), "pos", F.explode(windows).alias("window_id")).select(
        "date", "window_id", (F.col("pos") - F.col("window_id") + 1).alias("horizon"))
