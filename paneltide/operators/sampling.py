"""Exact, repeatable splits: the rows with the smallest hashes form the sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

BUCKET_DIGITS = 4  # hexadecimal digits of the hash: 65,536 buckets per stratum


def sample_hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def half_even(x: Column) -> Column:
    """Python's ``round``: ties go to the even number."""
    return F.bround(x).cast("bigint")


def _limits(hashed: DataFrame, strata: Sequence[str], size: Column) -> DataFrame:
    """The largest (hash, key) still in the sample of each stratum.

    Bucket counts (a small table) show which bucket the cut falls into; only the rows of that one bucket, 1/65,536 of
    the stratum, are ranked, and of them only hash and key.
    """
    counts = hashed.groupBy(*strata, "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    ordered = Window.partitionBy(*strata).orderBy("__bucket")
    marked = counts.select(
        *strata, "__bucket", "__rows",
        F.coalesce(F.sum("__rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__rows").over(Window.partitionBy(*strata)).alias("__total"),
    ).withColumn("__room", F.least(size, F.col("__total")) - F.col("__before"))
    cuts = marked.where("__room > 0 AND __room <= __rows").select(*strata, "__bucket", "__room")
    near = hashed.join(cuts, [*strata, "__bucket"])
    rank = F.row_number().over(Window.partitionBy(*strata, "__bucket").orderBy("__at"))
    return near.withColumn("__rank", rank).where("__rank = __room").select(*strata, F.col("__at").alias("__limit"))


def _flag_smallest(df: DataFrame, strata: Sequence[str], key: str, seed: int, size: Column, out: str) -> DataFrame:
    """Flag the ``size`` smallest hashes of every stratum. Rows without a stratum or key are never in the sample.

    What is shuffled is counts and a few hashes. The limits, one row per stratum, are written first, so that their size is
    known and Spark need not move the rows to them; without strata they are a scalar.
    """
    at = F.struct(sample_hash(seed, F.col(key)).alias("h"), F.col(key).alias("k"))
    known = F.col(key).isNotNull()
    for s in strata:
        known = known & F.col(s).isNotNull()
    hashed = df.where(known).select(*strata, at.alias("__at")).withColumn("__bucket", F.substring("__at.h", 1, BUCKET_DIGITS))
    limits = _limits(hashed, strata, size)
    if strata:
        joined = df.join(cut_lineage(limits, "limits"), list(strata), "left")
    else:
        joined = df.withColumn("__limit", limits.agg(F.max("__limit").alias("l")).scalar())
    return joined.select(*df.columns, F.coalesce(known & (at <= F.col("__limit")), F.lit(False)).alias(out))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int = 42, out: str = "is_val") -> DataFrame:
    """Validation flag: max(1, round(n * fraction)) rows of every label. ``key`` is a unique row id."""
    size = F.greatest(F.lit(1), half_even(F.col("__total").cast("double") * F.lit(float(fraction))))
    return _flag_smallest(df, [label], key, seed, size, out)


def random_split(df: DataFrame, key: str, fraction: float, seed: int = 42, out: str = "is_val") -> DataFrame:
    """Validation flag without strata: round(n * fraction) rows."""
    size = half_even(F.col("__total").cast("double") * F.lit(float(fraction)))
    return _flag_smallest(df, [], key, seed, size, out)


def rest_of(df: DataFrame, chosen: DataFrame | str, key: str | None = None) -> DataFrame:
    """Rows that were not chosen: by the flag a split has set (its name; nothing is joined, and the flag goes), or, for a choice
    that comes as a table, by key."""
    if isinstance(chosen, str):
        return df.where(~F.coalesce(F.col(chosen), F.lit(False))).drop(chosen)
    return df.join(chosen.select(key), key, "left_anti").select(*df.columns)


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")
