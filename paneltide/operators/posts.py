"""Scored posts to institution-day sentiment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.signals import sentiment_features
from ..functions.text import normalize_label, parse_count, to_day
from ..schema import SENTIMENT_FEATURES, SENTIMENT_RAW, fail_if, require_columns

# Label of each output group.
GROUPS = [("Negative", -1), ("Neutral", 0), ("Positive", 1)]


def correct_dates(posts: DataFrame, corrections: DataFrame, key: str, date: str = "pub_date") -> DataFrame:
    """Overwrite the date of listed rows; ``corrections`` holds ``key`` and the corrected ``date``, one row per key."""
    fixes = corrections.select(F.col(key), F.col(date).alias("__corrected"))
    joined = posts.join(fixes, key, "left")
    return joined.select(*[F.coalesce("__corrected", F.col(c)).alias(c) if c == date else F.col(c) for c in posts.columns])


def clean_posts(posts: DataFrame, date: str = "pub_date", bank: str = "bank_code", label: str = "predict",
                reads: str = "read_num", comments: str = "comments_num", on_bad_label: str = "raise") -> DataFrame:
    """Typed posts; rows without institution, day or label are dropped."""
    require_columns(posts, [date, bank, label, reads, comments], "predictions")
    types = dict(posts.dtypes)
    rest = [c for c in posts.columns if c not in {date, bank, label, reads, comments}]

    def count(name):
        return parse_count(name, numeric=types[name] not in ("string",))

    return posts.select(
        *rest,
        F.col(bank).alias("bank_code"),
        to_day(date).alias("pub_day"),
        normalize_label(label, on_bad_label).alias("predict"),
        count(reads).alias("read_num"),
        count(comments).alias("comments_num"),
    ).dropna("any", subset=["bank_code", "pub_day", *(["predict"] if on_bad_label == "null" else [])])


def daily_sentiment_stats(cleaned: DataFrame) -> DataFrame:
    """Counts, reads and comments by label plus totals, one row per institution and day.

    One aggregation: rows are reduced to at most one per institution and day in every task before the shuffle.
    """
    label = F.col("predict")
    counts = [F.count_if(label == v).alias(f"{g}_Count") for g, v in GROUPS]
    sums = [F.coalesce(F.sum(F.when(label == v, F.col(m))), F.lit(0)).cast("bigint").alias(f"{g}_{m}")
            for m in ("read_num", "comments_num") for g, v in GROUPS]
    totals = [F.sum(m).cast("bigint").alias(m) for m in ("read_num", "comments_num")]
    return cleaned.groupBy("bank_code", "pub_day").agg(*counts, *sums, *totals).select("bank_code", "pub_day", *SENTIMENT_RAW)


def merge_stats(parts: Sequence[DataFrame], keys: Sequence[str], fill: int = 0) -> DataFrame:
    """Outer merge of statistics that were taken apart, each with at most one row per key: every key of any part once, what a part
    does not know filled. The parts are stacked and met by key in one shuffle, not one full join after the other; two
    parts that name one column, or a key that is repeated in a part, stop the job."""
    names = [c for part in parts for c in part.columns if c not in keys]
    if len(set(names)) < len(names):
        raise ValueError(f"statistics named twice: {sorted({n for n in names if names.count(n) > 1})}")
    tagged = [part.select(*keys, F.lit(k).alias("__part"), *[c for c in part.columns if c not in keys]) for k, part in enumerate(parts)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    merged = stacked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.count_distinct("__part").alias("__parts"), *[F.first(c, ignorenulls=True).alias(c) for c in names])
    single = lambda c: fail_if(F.col("__rows") > F.col("__parts"), "a key is repeated in one of the statistics", F.coalesce(F.col(c), F.lit(fill)))
    return merged.select(*keys, *[single(c).alias(c) for c in names])


def system_day_sentiment(stats: DataFrame) -> DataFrame:
    """All institutions together, with the derived indicators."""
    require_columns(stats, ["pub_day", *SENTIMENT_RAW], "daily sentiment")
    total = stats.groupBy("pub_day").agg(*[F.sum(c).cast("bigint").alias(c) for c in SENTIMENT_RAW])
    return sentiment_features(total)


def entity_sentiment(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Indicators of every mapped institution, by name."""
    require_columns(stats, ["bank_code", "pub_day", *SENTIMENT_RAW], "daily sentiment")
    named = stats.join(mapping.select("bank_code", "bank"), "bank_code")
    return sentiment_features(named).select("bank", F.col("pub_day").alias("date"), *SENTIMENT_FEATURES)


def sentiment_for(stats: DataFrame, mapping: DataFrame, entity: str | None = None) -> DataFrame:
    """Indicators of one institution, or of the whole system (``None`` or ``ALL``)."""
    if entity is None or entity.upper() == "ALL":
        return system_day_sentiment(stats).select(F.col("pub_day").alias("date"), *SENTIMENT_FEATURES)
    one = mapping.where(F.col("bank") == entity)
    if one.isEmpty():
        raise ValueError(f"the mapping has no entity {entity!r}")
    return entity_sentiment(stats, one).drop("bank")
