"""Records of CSV files, read by many tasks per file although cells may hold line feeds inside quotes.

A task sees a byte range of a file, cut at line feeds, and does not know whether it begins inside a quoted cell.  A first
pass gives, per range, the state at its end for both possible states at its beginning.  Such a map is constant, the identity
or a swap, so the state at each beginning is the last constant plus the swaps after it: a running sum over one row per
range.  A second pass cuts the ranges into records; what a record has in several ranges is put together by a grouping of
those fragments alone (at most two per range).
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsense.session import shared_scratch, worker_path

#: Text that one output batch of a task holds, about.
BATCH_CHARS = 4 << 20
#: What a row of the second pass is: a whole record, or the last, a middle, the first part of one that spans ranges.
WHOLE, LAST, MIDDLE, FIRST = 0, 1, 2, 3


class Cutter:
    """Finds the ends of records in a line.  A quote opens a cell only as its first character; after the closing quote the cell
    goes on, unquoted, to the next separator.  Outside quotes a carriage return ends a record."""

    def __init__(self, sep: str):
        if len(sep) != 1 or sep in '"\r\n':
            raise ValueError("the separator is one character, no quote and no line end")
        s = re.escape(sep)
        self.sep = sep
        # an unquoted (rest of a) cell with what ends it; a quoted one from after its opening quote
        self.plain = re.compile(f"[^{s}\r]*+({s}|\r|\\Z)")
        self.quoted = re.compile(r'[^"]*+(?:""[^"]*+)*+"')

    def cut(self, line: str, inside: bool) -> tuple[list[int], bool]:
        """(positions of the carriage returns that end a record, whether the line ends inside quotes)."""
        if '"' not in line:
            return ([] if inside else [i for i, c in enumerate(line) if c == "\r"] if "\r" in line else []), inside
        ends, at, fresh = [], 0, True
        while True:
            if inside or (fresh and line.startswith('"', at)):
                closing = self.quoted.match(line, at if inside else at + 1)
                if closing is None:
                    return ends, True
                inside, at = False, closing.end()
            end = self.plain.match(line, at)
            at, fresh = end.end(), True
            if end.group(1) == "\r":
                ends.append(at - 1)
            elif not end.group(1):
                return ends, False


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, start, lines) of each range that the task reads, in order."""
    def rows():
        for b in batches:
            for line, file, start in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                yield file, start, line.as_py().decode("utf-8", "replace")
    for (file, start), lines in groupby(rows(), key=lambda r: r[:2]):
        yield file, start, (r[2] for r in lines)


def state_batches(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Per range: whether it ends inside quotes if it begins outside (``out``), and if it begins inside (``ins``)."""
    cutter, got = Cutter(sep), []
    for file, start, lines in _ranges(batches):
        out, ins = False, True
        for line in lines:
            if '"' in line:
                same = out == ins
                out = cutter.cut(line, out)[1]
                ins = out if same else cutter.cut(line, ins)[1]
        got.append((file, start, out, ins))
    yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "out", "ins"), g)) for g in got],
                                     schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("out", pa.bool_()), ("ins", pa.bool_())]))


def _records(start: int, lines: Iterator[str], inside: bool, cutter: Cutter) -> Iterator[tuple[int, bool, str]]:
    """(kind, whether it is the first record of the file, text) of one range."""
    parts: list[str] = []  # of the record that is open
    open_kind = MIDDLE if inside else WHOLE
    header = start == 0
    for line in lines:
        ends, inside = cutter.cut(line, inside)
        at = 0
        for end in ends if inside else [*ends, len(line)]:
            parts.append(line[at:end])
            text, kind, at = "\n".join(parts), LAST if open_kind == MIDDLE else WHOLE, end + 1
            parts, open_kind = [], WHOLE
            if text or kind == LAST:
                yield kind, header, text
                header = False
        if inside:
            parts.append(line[at:])
    if parts:
        yield MIDDLE if open_kind == MIDDLE else FIRST, header, "\n".join(parts)


RECORD_SCHEMA = "file string, start long, kind int, header boolean, record string, cells array<string>"


def record_batches(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Whole records as cells, quotes resolved; parts of others as text."""
    csv.field_size_limit(2 ** 31 - 1)
    cutter = Cutter(sep)
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_()),
                        ("record", pa.string()), ("cells", pa.list_(pa.string()))])
    inside_of: dict[tuple, bool] = {}

    def noting():
        for b in batches:
            inside_of.update(zip(zip(b.column(1).to_pylist(), b.column(2).to_pylist()), b.column(3).to_pylist()))
            yield b

    def batch():
        return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    rows, chars = [], 0
    for file, start, lines in _ranges(noting()):
        for kind, header, text in _records(start, lines, inside_of[(file, start)], cutter):
            rows.append((file, start, kind, header, None, cells_of(text, sep)) if kind == WHOLE else (file, start, kind, header, text, None))
            chars += len(text) + 100
            if chars > BATCH_CHARS:
                yield batch()
                rows, chars = [], 0
    yield batch()


def cell_batches(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """(file, header, cells) of (file, header, record)."""
    csv.field_size_limit(2 ** 31 - 1)
    for b in batches:
        got = [cells_of(r.as_py(), sep) for r in b.column(2)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(got, pa.list_(pa.string()))], names=["file", "header", "cells"])


def cells_of(record: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=sep), [""])


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))


def beginnings(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, start, inside) of every range: whether it begins inside quotes.  One row per range."""
    maps = _scan(spark, path).mapInArrow(lambda b: state_batches(b, sep), "file string, start long, out boolean, ins boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    swap = F.when(F.col("out") & ~F.col("ins"), 1).otherwise(0)
    const = F.when(F.col("out") == F.col("ins"), F.col("out").cast("int"))
    seen = maps.withColumn("swaps", F.sum(swap).over(upto)).withColumn("base", (const + F.col("swaps")) % 2)
    state = (F.coalesce(F.last("base", True).over(before), F.lit(0)) + F.coalesce(F.last("swaps").over(before), F.lit(0))) % 2
    return seen.select("file", "start", (state == 1).alias("inside"))


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, header, cells): every record of the files, empty lines left out; ``header`` marks the first one of a file.

    The source is read twice, for the states and for the records, which are written to the shared folder once.  What is
    broadcast is one small row per range that begins inside quotes, at most one per
    ``spark.sql.files.maxPartitionBytes`` of input."""
    worker_path(spark)
    begin = shared_scratch(spark, "csv-ranges")
    beginnings(spark, path, sep).where("inside").write.parquet(begin)
    inside = F.broadcast(spark.read.schema("file string, start long, inside boolean").parquet(begin))
    lines = _scan(spark, path).join(inside, ["file", "start"], "left") \
        .select("value", "file", "start", F.coalesce("inside", F.lit(False)).alias("inside"))
    out = shared_scratch(spark, "csv-records")
    lines.mapInArrow(lambda b: record_batches(b, sep), RECORD_SCHEMA).write.parquet(out)
    rows = spark.read.schema(RECORD_SCHEMA).parquet(out)
    own = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.where(F.col("kind") != WHOLE) \
        .withColumn("of", F.last(F.when(F.col("kind") == FIRST, F.col("start")), True).over(own))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n")
    glued = parts.groupBy("file", "of").agg(F.bool_or(F.col("header") & (F.col("kind") == FIRST)).alias("header"), text.alias("record")) \
        .select("file", "header", "record").mapInArrow(lambda b: cell_batches(b, sep), "file string, header boolean, cells array<string>")
    across = shared_scratch(spark, "csv-across")
    glued.write.parquet(across)
    return rows.where(F.col("kind") == WHOLE).select("file", "header", "cells") \
        .unionByName(spark.read.schema("file string, header boolean, cells array<string>").parquet(across))
