"""CSV tables whose encoding and columns are not known beforehand, and their sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import EVALUATION, require_columns
from .csv_records import BOM, ENCODINGS, CsvRecords



def read_csv_auto(spark: SparkSession, paths: str | Sequence[str], schema=None, encoding: str | None = None, one_line: bool = False) -> DataFrame:
    """CSV with a header. Files may differ in encoding and columns; columns are united by name, values stay text unless a schema
    is given, which every header must match. Quoted cells may hold line breaks, and large files are split all the same.

    The files are read twice: once to tell encoding, header and where records begin, once for the records. A named ``encoding``
    is the only one tried. ``one_line=True`` declares that files of a named encoding and one header hold no line breaks in
    cells: they are read once, and a record of the wrong width stops the job.
    """
    if one_line:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        base = spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST").option("encoding", encoding or ENCODINGS[0])
        return (base if schema is None else base.schema(schema).option("enforceSchema", False)).csv(paths)
    found = CsvRecords(spark, paths, [encoding] if encoding else ENCODINGS)
    if not found.layouts:
        raise FileNotFoundError(f"No rows in {paths}")
    return found.cells(schema)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> str:
    """Header row led by a UTF-8 byte order mark, as spreadsheet users expect; one file per partition. Blanks at the ends of
    a cell, quotes, separators and line breaks inside it survive; an empty text is read back as NULL."""
    marked = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if header else df
    (marked.write.mode(mode).option("header", header).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def matching_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Path and size of the matching files; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size_bytes"))


def audit_inputs(spark: SparkSession, expected: Mapping[str, str], encoding: str = "UTF-8") -> DataFrame:
    """One row per expected input (name -> path or pattern): whether a file is there, its size in bytes and its records.

    The sizes come from the file listing; the records are counted by reading the CSV files."""
    parts = []
    for name, path in expected.items():
        try:
            sizes = matching_files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))
            rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
        except AnalysisException:
            parts.append(spark.range(1).select(F.lit(name).alias("name"), F.lit(False).alias("exists"), F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("bigint").alias("records")))
            continue
        counted = rows.agg(F.count(F.lit(1)).alias("records")).scalar()
        parts.append(sizes.select(F.lit(name).alias("name"), (F.col("files") > 0).alias("exists"), "size_bytes", counted.alias("records")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_tables(frames: Iterable[DataFrame]) -> DataFrame:
    """Bag union with the union of the columns."""
    frames = list(frames)
    if not frames:
        raise FileNotFoundError("No prediction table to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_prediction_files(spark: SparkSession, pattern: str, out: str | None = None, encoding: str | None = None) -> DataFrame:
    """All prediction files a pattern matches, as one table; no match is an error.

    Files of one known encoding and layout need no look at their contents first: name the ``encoding``.
    """
    try:
        merged = read_csv_auto(spark, pattern, encoding=encoding)
    except AnalysisException as error:
        raise FileNotFoundError(f"no file at {pattern}") from error
    if out:
        write_csv(merged, out, mode="overwrite")
    return merged


def merge_evaluations(frames: Iterable[DataFrame]) -> DataFrame:
    checked = [require_columns(f, EVALUATION, "evaluation table").select(*EVALUATION) for f in frames]
    return union_tables(checked)
