"""Prediction files to institution-day sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.signals import sentiment_features
from ..operators.posts import clean_posts, correct_dates, daily_sentiment_stats
from ..sources.tables import audit_inputs, merge_prediction_files


def daily_sentiment(posts: DataFrame, corrections: DataFrame | None = None, correction_key: str | None = None,
                    on_bad_label: str = "raise", **columns: str) -> DataFrame:
    """Raw counts and derived indicators, one row per institution and day."""
    if corrections is not None:
        posts = correct_dates(posts, corrections, correction_key, columns.get("date", "pub_date"))
    return sentiment_features(daily_sentiment_stats(clean_posts(posts, on_bad_label=on_bad_label, **columns)))


def run(spark: SparkSession, pattern: str, out: str, step: str = "all", encoding: str | None = None, **columns: str) -> DataFrame:
    """``audit`` reports presence, size and records of the input; ``daily-stats`` and ``all`` read every file once, aggregate and write parquet.

    No merged copy is kept in between: Spark reads the files as one table.
    """
    if step == "audit":
        return audit_inputs(spark, {"posts": pattern}, encoding or "UTF-8")
    stats = daily_sentiment_stats(clean_posts(merge_prediction_files(spark, pattern, encoding=encoding), **columns))
    stats.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
