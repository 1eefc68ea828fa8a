"""CSV records in large files of unknown encoding, found by many tasks at once.

A quoted cell may hold line breaks, so where a byte range starts nobody can tell whether its first line begins a record. But
in every encoding supported here a line break and a quote are always the bytes 0x0A and 0x22, and quotes inside a quoted cell
are doubled, so a line begins a record if and only if an even number of quotes stands before it in its file. Hence two
passes over raw lines, both split as Spark splits text:

1. every byte range is summarised to one row: its quotes, the records that begin in it if it starts outside of a quoted cell
   and if inside, which encodings its bytes fit, and the first lines of its file;
2. running sums over a file's ranges tell each range where it starts, so it cuts its lines into records alone. Only records
   that cross the border of a range are put together afterwards, from at most two pieces a range.

The driver sees layouts, that is distinct pairs of encoding and header, never files.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schema import required
from ..session import cut_lineage
from ..timeline import running_offsets

BOM = "﻿"
# Encodings in the order they are tried.
ENCODINGS = ["UTF-8", "GB18030", "GBK"]
HEAD_LINES, HEAD_BYTES = 32, 1 << 20  # what the header records of a file may take up
BROADCAST_RANGES = 100_000  # with more byte ranges than this, lines meet their range in a shuffle
BLANK = np.isin(np.arange(256), [9, 13, 32])
RANGE = "path string, start long, quotes long, outside long, inside long, damaged int, head binary"
PIECE = "at long, layout int, kind int, path string, start long, record string"
WHOLE, HEAD, TAIL = 0, 1, 2


@dataclass(frozen=True)
class Layout:
    encoding: str
    header: list[list[str]]

    @property
    def names(self) -> list[str]:
        """Column names as Spark gives them: a blank cell or a repeated name gets its position."""
        last = self.header[-1]
        folded = [n.lower() for n in last]
        return [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(last)]


def raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines as bytes, in file order inside each byte range; the text source does not decode them."""
    return spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def runs(batch: pa.RecordBatch):
    """Stretches of one byte range: (first row, end, path, start)."""
    if not batch.num_rows:
        return
    path = batch.column("path").dictionary_encode()
    code, start = path.indices.to_numpy(zero_copy_only=False), batch.column("start").to_numpy()
    edges = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges, edges[1:]):
        yield i, j, path.dictionary[int(code[i])].as_py(), int(start[i])


def measured(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Quotes per line, and which lines hold anything but blanks."""
    wide = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, wide)[lines.offset:lines.offset + len(lines) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    up_to = lambda flags: np.concatenate([[0], np.cumsum(flags)])[at]
    return np.diff(up_to(raw == 34)), np.diff(up_to(~BLANK[raw])) > 0


def misfits(lines: list[bytes], encodings: Sequence[str]) -> int:
    """One bit per encoding that cannot hold these lines."""
    raw, found = b"\n".join(lines), 0
    if raw.isascii():
        return 0
    for k, encoding in enumerate(encodings):
        try:
            raw.decode(encoding)
        except UnicodeDecodeError:
            found |= 1 << k
    return found


def summaries(lines: DataFrame, encodings: Sequence[str]) -> DataFrame:
    """First pass: one row per byte range."""
    def work(batches):
        now, head = None, []
        for batch in batches:
            column, done = batch.column("line"), []
            for i, j, path, start in runs(batch):
                if now is None or (path, start) != (now["path"], now["start"]):
                    if now is not None:
                        done.append(now | {"head": b"\n".join(head)[:HEAD_BYTES] if now["start"] == 0 else None})
                    now, head = {"path": path, "start": start, "quotes": 0, "outside": 0, "inside": 0, "damaged": 0}, []
                part = column.slice(i, j - i)
                quotes, filled = measured(part)
                odd = (now["quotes"] + np.cumsum(quotes) - quotes) % 2 == 1
                now["outside"] += int((filled & ~odd).sum())
                now["inside"] += int((filled & odd).sum())
                now["quotes"] += int(quotes.sum())
                given = part.to_pylist()
                now["damaged"] |= misfits(given, encodings)
                if start == 0 and len(head) < HEAD_LINES:
                    head += given[:HEAD_LINES - len(head)]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now | {"head": b"\n".join(head)[:HEAD_BYTES] if now["start"] == 0 else None}], schema)

    schema = arrow_schema(RANGE)
    return lines.mapInArrow(work, RANGE)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def first_records(text: str, count: int) -> list[list[str]]:
    reader = csv.reader(io.StringIO(text.removeprefix(BOM), newline=""), strict=False)
    return [[cell.replace("\r\n", "\n") for cell in record] for record in reader if len(record) > 1 or "".join(record).strip()][:count]


class CsvRecords:
    """The records of some CSV files; ``header_rows`` records lead each file and are its header."""

    def __init__(self, spark: SparkSession, paths: str | Sequence[str], encodings: Sequence[str] = ENCODINGS, header_rows: int = 1,
                 broadcast_ranges: int = BROADCAST_RANGES):
        self.lines, self.encodings, self.header_rows = raw_lines(spark, paths), list(encodings), header_rows
        ranges = cut_lineage(summaries(self.lines, self.encodings), "csv-ranges")
        before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        odd = F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False))
        self.ranges = ranges.select("path", "start", odd.alias("odd"), "outside", "inside")
        tried = self.encodings
        per_file = ranges.groupBy("path").agg(F.bit_or("damaged").alias("damaged"), F.max("head").alias("head"))

        def describe(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    fit = next((k for k in range(len(tried)) if not row["damaged"] >> k & 1), None)
                    header = None if fit is None else json.dumps(first_records(row["head"].decode(tried[fit], "replace"), header_rows), ensure_ascii=False)
                    out.append({"path": row["path"], "encoding": fit, "header": header})
                yield pa.RecordBatch.from_pylist(out, schema)

        schema = arrow_schema("path string, encoding int, header string")
        self.files = per_file.mapInArrow(describe, "path string, encoding int, header string")
        sizes = self.ranges.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("odd").alias("torn"))
        found = (self.files.join(sizes, "path").groupBy("encoding", "header")
                 .agg(F.min("path").alias("path"), F.sum("n").alias("n"), F.max("torn").alias("torn")).collect())
        found.sort(key=lambda r: r.path)
        if any(r.encoding is None for r in found):
            raise ValueError(f"No encoding of {self.encodings} fits {next(r.path for r in found if r.encoding is None)}")
        self.layouts = [Layout(self.encodings[r.encoding], json.loads(r.header)) for r in found]
        self.torn, self.few = any(r.torn for r in found), sum(r.n for r in found) <= broadcast_ranges
        self._codes = {(r.encoding, r.header): k for k, r in enumerate(found)}
        self._spark = spark

    def _placed(self, numbered: bool) -> DataFrame:
        """Per byte range: whether it starts inside a quoted cell, its layout, and the number of its first record."""
        codes = self._spark.createDataFrame([(*k, v) for k, v in self._codes.items()], "encoding int, header string, layout int")
        placed = self.ranges.join(self.files.join(codes, ["encoding", "header"]).select("path", "layout"), "path")
        if not numbered:
            return placed.select("path", "start", "odd", "layout", F.lit(0).cast("long").alias("base"))
        here = F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside")) - F.when(F.col("start") == 0, self.header_rows).otherwise(0)
        return running_offsets(placed.select("path", "start", "odd", "layout", here.alias("here")), "here", ["path", "start"], "base").drop("here")

    def _pieces(self, placed: DataFrame) -> DataFrame:
        """Second pass: whole records, and pieces of those that cross the border of a range."""
        if self.few:
            lines = self.lines.join(F.broadcast(placed), ["path", "start"], "left")
        else:
            lines = (self.lines.withColumn("order", F.monotonically_increasing_id()).join(placed, ["path", "start"], "left")
                     .repartition("path", "start").sortWithinPartitions("path", "start", "order"))
        lines = lines.select("line", "path", "start", required(F.col("odd"), "a byte range changed while it was read").alias("odd"), "layout", "base")
        encodings, header_rows = [layout.encoding for layout in self.layouts], self.header_rows
        schema = arrow_schema(PIECE)

        def work(batches):
            now, held = None, []  # the range at hand and the lines of its open record

            def emit(out, lines_, kind):
                if kind == WHOLE and len(lines_) == 1 and not lines_[0].strip(b" \t\r"):
                    return
                if kind != HEAD:
                    now["n"] += 1
                    if now["n"] <= 0:
                        return  # a header record
                out["at"].append(now["base"] + now["n"] - 1)
                out["layout"].append(now["layout"])
                out["kind"].append(kind)
                out["path"].append(None if kind == WHOLE else now["path"])
                out["start"].append(now["start"])
                text = b"\n".join(lines_).decode(encodings[now["layout"]])
                out["record"].append(text.removesuffix("\r") if kind == WHOLE else text)

            def close(out):
                nonlocal held
                if held:  # open to the end: the next range goes on with it, or the file ends
                    emit(out, held, HEAD if now["within"] else TAIL)
                held = []

            for batch in batches:
                out = {f.name: [] for f in schema}
                for i, j, path, start in runs(batch):
                    if now is None or (path, start) != (now["path"], now["start"]):
                        if now is not None:
                            close(out)
                        first = batch.slice(i, 1).to_pylist()[0]
                        now = {"path": path, "start": start, "odd": first["odd"], "within": first["odd"], "layout": first["layout"],
                               "base": first["base"], "n": -header_rows if start == 0 else 0}
                    part = batch.column("line").slice(i, j - i)
                    quotes, _ = measured(part)
                    after = (int(now["odd"]) + np.cumsum(quotes)) % 2 == 1
                    for line, still in zip(part.to_pylist(), after.tolist()):
                        held.append(line)
                        if not still:
                            emit(out, held, HEAD if now["within"] else WHOLE)
                            held, now["within"] = [], False
                    now["odd"] = bool(after[-1])
                yield pa.RecordBatch.from_pydict(out, schema)
            out = {f.name: [] for f in schema}
            if now is not None:
                close(out)
            yield pa.RecordBatch.from_pydict(out, schema)

        return lines.mapInArrow(work, PIECE)

    def records(self, numbered: bool = False) -> DataFrame:
        """``record`` (its text), ``layout`` (position in ``layouts``) and, if ``numbered``, ``at``: 0 to n - 1 in the order of
        paths and of the files."""
        pieces = self._pieces(self._placed(numbered))
        whole = pieces.where(F.col("kind") == WHOLE).select("at", "layout", "record")
        # A range that ends inside a quoted cell closes with a tail; the ranges after it continue it until one begins a record.
        # Without a torn range there are none but an open end of file, which is a record as it stands.
        order = Window.partitionBy("path").orderBy("start", "kind")
        opened = pieces.where(F.col("kind") != WHOLE).withColumn("of", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
        if not self.torn:
            return pieces.select("at", "layout", "record")
        joined = opened.groupBy("path", "of").agg(
            F.min(F.when(F.col("kind") == TAIL, F.col("at"))).alias("at"), F.first("layout").alias("layout"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n").alias("record"))
        return whole.union(joined.select("at", "layout", F.regexp_replace("record", r"\r$", "")))

    def positional(self, numbered: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
        """Cells as text in ``c0``, ``c1``, ... up to the widest header, the ``layout`` and, if named, the place of each row."""
        width = max((len(layout.names) for layout in self.layouts), default=0)
        row = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), self._options(options))
        extra = [F.col("at").alias(numbered)] if numbered else []
        return self.records(numbered is not None).select(row.alias("row"), "layout", *extra).select("row.*", "layout", *([numbered] if numbered else []))

    @staticmethod
    def _options(options):
        return {"escape": '"', "multiLine": "true"} | (options or {})

    def cells(self, schema=None, numbered: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
        """Columns united by name over all layouts, as text or in the types of ``schema``, whose names every header must have.
        ``numbered`` names a column for the place of each row."""
        last = [numbered] if numbered else []
        if schema is not None:
            wanted = self._spark.createDataFrame([], schema).schema
            for layout in self.layouts:
                if layout.names != wanted.names:
                    raise ValueError(f"header {layout.names} is not {wanted.names}")
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted)
            typed = self.records(numbered is not None).select(F.from_csv("record", ddl, self._options(options)).alias("row"), *[F.col("at").alias(n) for n in last])
            return typed.select("row.*", *last)
        places: dict[str, list[tuple[int, int]]] = {}
        for k, layout in enumerate(self.layouts):
            for i, name in enumerate(layout.names):
                places.setdefault(name, []).append((k, i))

        def column(name):
            at = {i for _, i in places[name]}
            if len(places[name]) == len(self.layouts) and len(at) == 1:
                return F.col(f"c{at.pop()}")
            return F.coalesce(*[F.when(F.col("layout") == k, F.col(f"c{i}")) for k, i in places[name]])

        return self.positional(numbered, options).select(*[column(name).alias(name) for name in places], *last)
