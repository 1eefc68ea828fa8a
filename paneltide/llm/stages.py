"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of ``docs``.

Common to all: NULL texts count as empty, repeated rows are rows, an empty table gives an empty result, and further columns
ride along under their own names (rows are packed into a struct, so no name can clash).
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paneltide.session import small_batches

from . import bpe, kneser_ney, mixing, personal, simhash
from .common import table

NO_KEY = -(1 << 63)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Documents whose toxicity is below the threshold. The score is computed beside the row, so nothing is joined."""
    small_batches(spark)
    model = kneser_ney.fit(docs, table(spark, sf_dir, "labels"))

    @F.arrow_udf("double")
    def score(given: pa.Array) -> pa.Array:
        if isinstance(model, float):
            return pa.array([model] * len(given), pa.float64())
        return pa.array(np.concatenate([np.zeros(0)] + [model.probability(given.slice(at, 512).fill_null("").to_pylist()) for at in range(0, len(given), 512)]), pa.float64())

    packed = docs.select(F.struct("*").alias("row"), score(F.col("text")).alias("score"))
    return packed.where(F.col("score") < threshold).select("row.*")


def _spot() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY)), F.xxhash64(F.coalesce("text", F.lit("")))]


def _least_of_each(docs: DataFrame, of_fp: DataFrame) -> DataFrame:
    """The row of the smallest ``least`` (late, key, hash) of every root; of equal rows, one.

    Rows are found again by key and text hash, one shuffle of the texts; representatives are the minimum of each group, so
    a large group is reduced before it is shuffled."""
    chosen = of_fp.groupBy("root").agg(F.min("least").alias("least")).select("least.key", "least.hash")
    packed = docs.select(F.struct("*").alias("row"), *[c.alias(n) for c, n in zip(_spot(), ("key", "hash"))])
    one = Window.partitionBy("key", "hash").orderBy(*[F.col(f"row.`{c}`") for c in docs.columns if c in ("source", "lang", "n_chars")] or [F.lit(1)])
    found = packed.join(chosen, ["key", "hash"], "left_semi").withColumn("n", F.row_number().over(one))
    return found.where("n = 1").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of op3's contract (fingerprints within two bits): the one with the smallest key (NULL last),
    then text hash."""
    small_batches(spark)
    spot = _spot()
    _, of_fp = simhash.grouped(docs, F.struct(F.col("doc_id").isNull().alias("late"), spot[0].alias("key"), spot[1].alias("hash")))
    return _least_of_each(docs, of_fp)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal-data span is replaced by its kind in brackets; ``n_chars``, where present, follows the new text."""
    packed = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    done = packed.select("row", F.when(F.col("row.text").isNotNull(), personal.redacted(F.col("t"), personal.spans(F.col("t")))).alias("clean"))
    columns = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean").cast(dict(docs.dtypes).get("n_chars", "long")), F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return done.select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as each is taken."""
    return mixing.mixture(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
