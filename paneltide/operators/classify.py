"""Batch scoring of text and comparison of text classifiers."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import parse_response, title_prompt
from ..schema import required
from ..session import cut_lineage, small_batches
from .evaluation import weighted_prf

Predictor = Callable[[pd.Series], pd.Series]
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20  # rows a predictor sees at once: at most that many, and no second one beyond that size


def slices(given: pa.Array) -> Iterator[pa.Array]:
    """The same texts, fewer at a time: what lives as Python objects must not depend on how many rows Spark sends."""
    size = given if pa.types.is_string(given.type) or pa.types.is_large_string(given.type) else given.cast(pa.string())
    size, at = pc.fill_null(pc.binary_length(size), 0).to_numpy(zero_copy_only=False), 0
    total = 0
    for row, held in enumerate(size):
        total = held if row == at else total + held
        if row > at and (row - at >= SLICE_ROWS or total > SLICE_BYTES):
            yield given.slice(at, row - at)
            at, total = row, held
    if at < len(given):
        yield given.slice(at)


def score_text(df: DataFrame, text: str, factory: Callable[[], Predictor], output: str = "Output") -> DataFrame:
    """Apply a text model in batches and keep the source columns.

    ``factory`` runs once per task and returns a function from a batch of texts to a batch of responses. Missing text
    is scored as the empty string. Only the text goes to Python, in batches of bounded size, and becomes objects a slice at a time;
    all other columns stay in Spark, and those not asked for are never read. Every row is scored once.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf(T.StringType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = factory()

        def answers(given: pa.Array) -> pa.Array:
            return pa.array(predictor(given.to_pandas().fillna("").astype(str)).to_numpy(), pa.string(), from_pandas=True)

        gc.collect()
        gc.freeze()  # the model and what is loaded beside it: collecting in full then costs no more than what a slice left behind
        try:
            for batch in batches:
                found = [pa.array([], pa.string())]
                for part in slices(batch):
                    found.append(answers(part))
                    # a Series whose ``.str`` was used refers to itself, and where a predictor makes many objects it is an old one
                    # before its slice is done: without this, texts pile up until Python happens to look
                    gc.collect()
                yield pa.concat_arrays(found)
        finally:
            gc.unfreeze()  # the worker goes on to other tasks

    return df.select("*", score.asNondeterministic()(F.col(f"`{text}`")).alias(output))


def text_key(text: str):
    """What makes two texts one for scoring; missing text is the empty one."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str, output: str = "Output") -> DataFrame:
    """Scored texts so far: ``key`` and ``output``, one row each; empty where nothing is scored yet."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField(output, T.StringType())])
    try:
        return spark.read.schema(schema).parquet(path).dropDuplicates(["key"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def score_new_texts(df: DataFrame, text: str, factory: Callable[[], Predictor], path: str, output: str = "Output") -> DataFrame:
    """Score every distinct text that the ledger at ``path`` does not hold, append the results and return the whole ledger.

    A run over grown input, or one that is repeated after a failure, pays for new texts only. One model, one path. A run that
    fails appends nothing; two runs at once may score a text twice, of which one result counts."""
    spark = df.sparkSession
    texts = df.select(text_key(text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    fresh = texts.join(read_ledger(spark, path, output).select("key"), "key", "left_anti").groupBy("key").agg(F.first("__text").alias("__text"))
    score_text(fresh, "__text", factory, output).select("key", output).write.mode("append").parquet(path)
    return read_ledger(spark, path, output)


def scores_to_rows(df: DataFrame, text: str, ledger: DataFrame, output: str = "Output", what: str = "score") -> DataFrame:
    """Every row with the score of its text; a text without one stops the job."""
    keyed = df.withColumn("__key", text_key(text))
    found = keyed.join(ledger.select(F.col("key").alias("__key"), F.col(output).alias("__found")), "__key", "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], required(F.col("__found"), f"a text has no {what}").alias(output))


def predict_sentiment(df: DataFrame, text: str, factory: Callable[[], Predictor]) -> DataFrame:
    """Prompt, score and read the label off the response; a response without a label word counts as neutral."""
    prompted = df.withColumn("Input", title_prompt(F.col(text)))
    return score_text(prompted, "Input", factory).withColumn("predict", parse_response("Output", default=0))


def compare_text_classifiers(df: DataFrame, text: str, label: str, flag: str, features: int = 1 << 16, rounds: int = 100) -> DataFrame:
    """Tidy accuracy, precision, recall and F1 of Spark ML text models on the training and held-out rows."""
    return weighted_prf(text_predictions(df, text, label, flag, features, rounds), label, "prediction", ["dataset", "model_name"])


def text_predictions(df: DataFrame, text: str, label: str, flag: str, features: int = 1 << 16, rounds: int = 100) -> DataFrame:
    """``dataset`` (train or val), ``model_name``, label and prediction of every row and model.

    ``label`` holds class numbers from 0, ``flag`` marks the held-out rows. Words are hashed into ``features`` columns;
    the logistic fit ends at convergence or after ``rounds`` iterations. Features are written once and read by every fit.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    tokens = RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"(?U)\W+", minTokenLength=1)
    counts = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=features)
    weights = IDF(inputCol="__tf", outputCol="__features")
    clean = df.select(F.coalesce(text, F.lit("")).alias(text), F.col(label).cast("double").alias(label), flag)
    train = clean.where(~F.col(flag))
    prepared = Pipeline(stages=[tokens, counts, weights]).fit(train).transform(clean).select(label, flag, "__features")
    prepared = cut_lineage(prepared, "features")
    models = {
        "LogisticRegression": LogisticRegression(featuresCol="__features", labelCol=label, maxIter=rounds, regParam=0.01),
        "NaiveBayes": NaiveBayes(featuresCol="__features", labelCol=label),
    }
    fitted = {name: m.fit(prepared.where(~F.col(flag))) for name, m in models.items()}
    scored = None
    for name, model in fitted.items():
        rows = model.transform(prepared).select(
            F.when(F.col(flag), "val").otherwise("train").alias("dataset"), F.lit(name).alias("model_name"), label, "prediction")
        scored = rows if scored is None else scored.unionByName(rows)
    return scored
