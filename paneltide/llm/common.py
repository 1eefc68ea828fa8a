"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but the space and the control characters 0x09 to 0x0D; ``bytes.split`` cuts there too.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, a NULL text as the empty one; further columns, whatever their names, stay behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key written as text, modulo ``folds``; -1 for a NULL key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(-1))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for work that yields columns as a dict of lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: what a worker makes of a batch lives as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def each_text(score: Callable[[str], tuple], names: list[str]):
    """Work for ``map_batches``: ``score`` gives one tuple of ``names`` per text; ``doc_id`` is carried along."""
    def work(batches):
        for batch in batches:
            rows = [score(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id")} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return work


SLICE = 256  # entries of an array that are folded together


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def by_slices(items: Column, start: Column, step) -> Column:
    """Fold over slices of an array; ``step(state, slice)``."""
    return let(items, lambda given: F.when(F.size(given) == 0, start).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(given) - 1) / SLICE).cast("int")), start, lambda state, k: step(state, F.slice(given, k * SLICE + 1, F.lit(SLICE))))))
