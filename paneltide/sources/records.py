"""Instruction records: build, write, read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import DEFAULT_INSTRUCTION, LABEL_TEXT, chat_source, chat_target, lookup, normalize_label, with_input
from ..schema import INSTRUCTIONS
from .tables import write_csv


def instruction_records(df: DataFrame, text: str, label: str, instruction: str = DEFAULT_INSTRUCTION,
                        keep: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *keep,
        F.lit(instruction).alias("instruction"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("input"),
        lookup(normalize_label(label), LABEL_TEXT, default="raise").alias("output"),
    )


def write_split(df: DataFrame, text: str, label: str, flag: str, folder: str,
                instruction: str = DEFAULT_INSTRUCTION) -> dict[str, str]:
    """Training and validation rows, each as CSV and as instruction records (JSON lines)."""
    written = {}
    for name, chosen in (("train", ~F.col(flag)), ("val", F.col(flag))):
        rows = df.where(chosen).drop(flag)
        written[f"{name}_csv"] = write_csv(rows, f"{folder}/{name}_csv")
        written[f"{name}_json"] = f"{folder}/{name}_json"
        instruction_records(rows, text, label, instruction).write.json(written[f"{name}_json"])
    return written


def read_instructions(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """Instruction records of many files as one table; ``multi_line`` reads files that hold one JSON array."""
    return spark.read.schema(INSTRUCTIONS).option("multiLine", multi_line).json(paths)


def chat_pairs(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Source and target text of each record in the chat template."""
    return records.select(
        *keep,
        chat_source(with_input(F.col("instruction"), F.col("input"))).alias("source"),
        chat_target(F.col("output")).alias("target"),
    )
