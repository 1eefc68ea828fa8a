"""Calendar features of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PARTS = {
    "month": lambda t: F.month(t),
    "day": lambda t: F.dayofmonth(t),
    "weekday": lambda t: F.weekday(t),
    "hour": lambda t: F.hour(t),
    "minute": lambda t: F.floor(F.minute(t) / F.lit(15)).cast("int"),
}
_SCALED = {
    "second": (lambda t: F.second(t), 0, 59),
    "minute": (lambda t: F.minute(t), 0, 59),
    "hour": (lambda t: F.hour(t), 0, 23),
    "day_of_week": (lambda t: F.weekday(t), 0, 6),
    "day_of_month": (lambda t: F.dayofmonth(t), 1, 30),
    "day_of_year": (lambda t: F.dayofyear(t), 1, 365),
    "month": (lambda t: F.month(t), 1, 11),
    "week_of_year": (lambda t: F.weekofyear(t), 1, 52),
}
# Which features each sampling frequency uses, in output order.
PARTS_BY_FREQUENCY = {
    "y": [], "m": ["month"], "w": ["month"],
    "d": ["month", "day", "weekday"], "b": ["month", "day", "weekday"],
    "h": ["month", "day", "weekday", "hour"],
    "t": ["month", "day", "weekday", "hour", "minute"],
}
SCALED_BY_FREQUENCY = {
    "Y": [], "Q": ["month"], "M": ["month"], "W": ["day_of_month", "week_of_year"],
    "D": ["day_of_week", "day_of_month", "day_of_year"],
    "B": ["day_of_week", "day_of_month", "day_of_year"],
    "H": ["hour", "day_of_week", "day_of_month", "day_of_year"],
    "T": ["minute", "hour", "day_of_week", "day_of_month", "day_of_year"],
    "S": ["second", "minute", "hour", "day_of_week", "day_of_month", "day_of_year"],
}


def calendar_parts(ts: Column, freq: str) -> list[Column]:
    """Whole-number features (weekday: Monday is 0, minute: quarter of the hour)."""
    return [_PARTS[name](ts).alias(name) for name in PARTS_BY_FREQUENCY[freq.lower()]]


def scaled_features(ts: Column, freq: str) -> list[Column]:
    """Features scaled to [-0.5, 0.5]; multiples (``15min``, ``3h``) have the features of their unit."""
    unit = freq.lstrip("0123456789").upper()
    key = {"A": "Y", "MIN": "T"}.get(unit, unit)
    if key not in SCALED_BY_FREQUENCY:
        raise ValueError(f"Unsupported frequency {freq}; choose from {sorted(SCALED_BY_FREQUENCY)}")

    def scaled(name):
        part, origin, span = _SCALED[name]
        return ((part(ts) - F.lit(origin)) / F.lit(float(span)) - F.lit(0.5)).alias(name)

    return [scaled(name) for name in SCALED_BY_FREQUENCY[key]]
