"""Text files in file order: exact line numbers, and CSV records of several lines, over byte ranges read in parallel.

A file is read in as many ranges as Spark cuts it into. What a range hands to the next (lines seen, whether a quote is
open, records begun) is summed over the ranges of each file, a row for each range; then every range knows where it
stands. No line moves but those of records that lie over a range's edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges up to which their table is broadcast by a hint: one row of some hundred bytes for each.
BROADCAST_RANGES = 50_000
_RANGE = ["file", "begin"]


def _lines(spark: SparkSession, path: str | list[str], glob: str | None = None, lenient: bool = False) -> DataFrame:
    """(value, file, begin, id): lines with their range; ids grow within a range in file order.

    lenient: a file that cannot be read ends where its first error is, and bytes that are no UTF-8 are replaced.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("ignoreCorruptFiles", lenient)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return raw.select(F.make_valid_utf8("value").alias("value") if lenient else F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"))


def _with_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines with what is known of their range, in file order within it; a range's lines stay in one task."""
    if len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= BROADCAST_RANGES:  # no fewer than there are ranges
        return lines.join(F.broadcast(ranges), _RANGE, "left")
    return lines.join(ranges, _RANGE, "left").repartition(*_RANGE).sortWithinPartitions(*_RANGE, "id")


def _before(column: str | Column, over: Window) -> Column:
    return F.coalesce(F.sum(column).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, lenient: bool = False) -> DataFrame:
    """(file, line, value): every line of the files with its number in its file, from 0. (file, line) is the order of a
    sequential read of the files by name. A carriage return before the end of a line goes; an empty file has no lines.

    The files are read twice, once to count the lines of each range. Should the second read cut them otherwise, it
    ends with an error, not with wrong numbers. lenient: see _lines.
    """
    lines = _lines(spark, path, glob, lenient)
    counts = lines.groupBy(*_RANGE).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    ranges = counts.withColumn("seen", _before("n", Window.partitionBy("file").orderBy("begin")))
    at = F.col("id") - F.col("first")
    wrong = F.col("first").isNull() | (at < 0) | (at >= F.col("n"))
    line = F.when(wrong, F.raise_error(F.concat(F.lit("ranges have changed while reading "), "file")).cast("long")).otherwise(F.col("seen") + at)
    return _with_ranges(lines, ranges).select("file", line.alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def _quotes(values: pa.Array, quote: str) -> np.ndarray:
    return pc.count_substring(values, quote).to_numpy(zero_copy_only=False).astype(np.int64)


def _range_states(lines: DataFrame, quote: str) -> DataFrame:
    """Per range: lines n, odd (whether its quotes change the state), and how many records begin in it if no quote is
    open before it (starts0) or one is (starts1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        for batch in batches:
            values, files, begins = batch.column(0), batch.column(1), batch.column(2)
            q = _quotes(values, quote)
            begin = begins.to_numpy()
            edges = _edges(files, begin)
            for i, j in zip(edges, edges[1:], strict=False):
                state = states.setdefault((files[i].as_py(), int(begin[i])), [0, 0, 0, 0])
                odd_before = (state[1] + np.cumsum(q[i:j]) - q[i:j]) & 1
                odd = int(odd_before.sum())
                state[0] += j - i
                state[1] = (state[1] + int(q[i:j].sum())) & 1
                state[2] += j - i - odd
                state[3] += odd
        keys = list(states)
        columns = [[k[0] for k in keys], [k[1] for k in keys], *([states[k][c] for k in keys] for c in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["file", "begin", "n", "odd", "starts0", "starts1"])

    return lines.select("value", *_RANGE).mapInArrow(scan, "file string, begin long, n long, odd long, starts0 long, starts1 long")


def _edges(files: pa.Array, begin: np.ndarray) -> list[int]:
    """Places where a batch's rows pass into another range, with both ends."""
    if not len(begin):
        return [0]
    code = files.dictionary_encode().indices.to_numpy()
    return [0, *(np.flatnonzero((begin[1:] != begin[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(begin)]


def csv_records(spark: SparkSession, path: str | list[str], quote: str = '"', glob: str | None = None, lenient: bool = False) -> DataFrame:
    """(file, record, line, text): the records of CSV files, numbered from 0 in each file, with their first line.

    A record ends with the first line end outside quotes; a quote within a quoted field is written twice, so that
    the parity of quotes tells inside from outside, and no quote stands in a field that is not quoted. A carriage
    return before a record's end goes. Empty lines are records of empty text. lenient: see _lines.
    """
    lines = _lines(spark, path, glob, lenient)
    order = Window.partitionBy("file").orderBy("begin")
    ranges = _range_states(lines, quote).withColumn("open", _before("odd", order) % 2)
    ranges = ranges.withColumn("starts", F.when(F.col("open") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    ranges = ranges.select(*_RANGE, "n", "open", _before("n", order).alias("line"), _before("starts", order).alias("records"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        here, n_lines, of, odd, record, at, line, held = None, 0, 0, 0, 0, 0, 0, []
        out: list[tuple] = []

        def flush(done: bool) -> None:
            """A record's lines of this range; done: it also ends here."""
            nonlocal held
            if held:
                whole = done and held[0][0]
                out.append((here[0], record, at, here[1], whole, "\n".join(t for _, t in held)))
            held = []

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["file", "record", "line", "begin", "whole", "text"])

        for batch in batches:
            files, begin, values = batch.column(1), batch.column(2).to_numpy(), batch.column(0)
            edges = _edges(files, begin)
            for i, j in zip(edges, edges[1:], strict=False):
                key = (files[i].as_py(), int(begin[i]))
                if key != here:
                    if here is not None and n_lines != of:
                        raise RuntimeError(f"ranges have changed while reading {here[0]}")
                    flush(False)
                    n, opened, line, records = (batch.column(c)[i].as_py() for c in range(3, 7))
                    if n is None:
                        raise RuntimeError(f"ranges have changed while reading {key[0]}")
                    here, n_lines, of, odd, record, at = key, 0, n, opened, records - 1, line
                part = values.slice(i, j - i)
                parity = (odd + np.cumsum(_quotes(part, quote))) & 1
                for text, after in zip(part.to_pylist(), parity.tolist(), strict=True):
                    if not odd:
                        record, at = record + 1, line + n_lines
                    held.append((not odd or bool(held and held[0][0]), text))
                    odd, n_lines = after, n_lines + 1
                    if not after:
                        flush(True)
            if out:
                yield frame()
                out = []
        if here is not None and n_lines != of:
            raise RuntimeError(f"ranges have changed while reading {here[0]}")
        flush(False)
        if out:
            yield frame()

    def as_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gather(batches):
            yield pa.RecordBatch.from_pandas(found, schema=schema, preserve_index=False)

    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("line", pa.int64()), ("begin", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
    known = _with_ranges(lines, ranges).select("value", *_RANGE, "n", "open", "line", "records")
    found = known.mapInArrow(as_arrow, "file string, record long, line long, begin long, whole boolean, text string")
    pieces = found.filter("not whole").groupBy("file", "record").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("p"))  # of one record
    joined = pieces.select("file", "record", "line", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    every = found.filter("whole").select("file", "record", "line", "text").unionByName(joined)
    return every.withColumn("text", F.regexp_replace("text", "\r$", ""))
