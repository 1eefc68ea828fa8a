"""Labelled text to training and validation files."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window, functions as F

from ..functions.text import DEFAULT_INSTRUCTION, normalize_label
from ..operators.sampling import random_split, stratified_split
from ..schema import require_columns
from ..session import cut_lineage
from ..sources.records import write_split
from ..sources.tables import read_csv_auto


def run(spark: SparkSession, path: str, out: str, text: str = "text", label: str = "sen", fraction: float = 0.1, seed: int = 42,
        stratify: bool = True, instruction: str = DEFAULT_INSTRUCTION) -> dict[str, str]:
    """Split a labelled CSV and write both parts as CSV and as instruction records."""
    raw = require_columns(read_csv_auto(spark, path), [text, label], "labelled text")
    # A row's key is its content and its number among equal rows, so neither file order nor partitioning moves the split.
    content = F.xxhash64(text, label)
    same = Window.partitionBy(content, label).orderBy(F.lit(1))
    labelled = raw.withColumn(label, normalize_label(label)).withColumn("__row", F.concat_ws("-", content, F.row_number().over(same)))
    rows = cut_lineage(labelled, "labelled")
    flagged = stratified_split(rows, label, "__row", fraction, seed) if stratify else random_split(rows, "__row", fraction, seed)
    return write_split(flagged.drop("__row"), text, label, "is_val", out, instruction)
