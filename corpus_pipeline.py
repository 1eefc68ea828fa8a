"""Corpus pipeline: toxicity filter, near-duplicate removal, redaction of personal data, source mixing, tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneltide.llm import stages
from paneltide.llm.common import table
from paneltide.session import cut_lineage, drop_stage

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.keep_one_of_each),
    ("personal_data", stages.redact),
    ("mixing", stages.mix),
    ("tokens", stages.tokenise),
]

#: Models, hashes and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared folder and read back as the documents of the next, after which it is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
