"""Text and repair expressions of the report tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPLITTER = 134217729.0  # 2**27 + 1 halves a double's mantissa


def fixed(value: Column, decimals: int = 2, scale: float = 1.0, suffix: str = "") -> Column:
    """Fixed-point text, blank for NULL, rounded on the exact binary value.

    Java rounds the shortest decimal text (9.915 -> 9.92) where the published tables round the stored number
    (9.915 is just below the tie -> 9.91). The exact error of value * 10**decimals decides ties.
    """
    x = value.cast("double") * F.lit(float(scale)) if scale != 1.0 else value.cast("double")
    step = F.lit(float(10 ** decimals))
    product = x * step
    high = x * SPLITTER - (x * SPLITTER - x)
    error = (high * step - product) + (x - high) * step
    low = F.floor(product)
    part = product - low
    even = F.pmod(low, F.lit(2)) == 0
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & ~even)))
    rounded = (low + F.when(up, 1).otherwise(0)) / step
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")  # also of a negative zero
    text = F.concat(sign, F.format_string(f"%.{decimals}f", F.abs(rounded)), F.lit(suffix))
    return F.when(x.isNull() | F.isnan(x), "").otherwise(text)


def scientific(value: Column, decimals: int = 2) -> Column:
    x = value.cast("double")
    return F.when(x.isNull() | F.isnan(x), "").otherwise(F.format_string(f"%.{decimals}e", x))


def squeeze(value: Column) -> Column:
    """Drop the blanks inside a statistic such as ``-2.627 ***``."""
    return F.replace(value, F.lit(" "), F.lit(""))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def starred(estimate: Column, p: Column, decimals: int = 3) -> Column:
    """Estimate with its significance mark; blank when there is no estimate."""
    return F.when(estimate.isNull(), "").otherwise(F.concat(fixed(estimate, decimals), stars(p)))


def repaired_mse(mse: Column, rmse: Column, tolerance: float = 1e-6) -> Column:
    """Squared RMSE where the archived MSE contradicts it."""
    return F.when(F.abs(mse - rmse * rmse) > tolerance, rmse * rmse).otherwise(mse)
