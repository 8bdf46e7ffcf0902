"""Delimited files with quoted line breaks, read by many tasks.

A line break ends a record only outside quotes, which no task can tell that begins in the middle of a file.
So every byte range is first scanned for both answers: how many records begin in it, and in which state it
ends, from outside and from inside quotes. Running these along a file's ranges gives the state and the number
that each begins with; a second scan then cuts records, and the pieces of those that reach over the end of a
range are put together by their number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditspark.plans import settled


def patterns(sep: str) -> tuple[str, str]:
    """What lines look like that end inside a quoted value, from outside and from inside one. Only a quote at the
    beginning of a value opens it; doubled quotes belong to it; what follows the closing quote up to the delimiter
    belongs to the value. For engines that match in linear time."""
    s = re.escape(sep)
    held = '(?:[^"]|"")*'
    value = f'(?:"{held}"(?:[^"{s}][^{s}]*)?|[^"{s}][^{s}]*)?'
    opens = f'(?:{value}{s})*"{held}$'
    return f"^{opens}", f'^{held}(?:$|"(?:[^"{s}][^{s}]*)?{s}{opens})'


class Walk:
    """The lines of a range from one starting state, batch by batch."""

    def __init__(self, inside: bool):
        self.inside, self.begun = inside, 0

    def __call__(self, blank: np.ndarray, end_out: np.ndarray, end_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line begins inside quotes, and whether it begins a record: those outside that are not blank.
        A line sets the state, keeps it or turns it."""
        turns = np.cumsum(end_out & ~end_in)
        last = np.maximum.accumulate(np.where(end_out == end_in, np.arange(len(blank)), -1))
        after = np.where(last < 0, self.inside, end_out[last]) ^ ((turns - np.where(last < 0, 0, turns[last])) % 2 == 1)
        inside = np.append(self.inside, after[:-1])
        self.inside = bool(after[-1])
        begins = ~inside & ~blank
        self.begun += int(begins.sum())
        return inside, begins


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files with the byte range that each is read in, in order; ranges are Spark's own splits."""
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of batches that lie in one range."""
    for batch in batches:
        if not len(batch):
            continue
        block, file = batch.column("block").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (file[1:] != file[:-1])))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(batch)], strict=True):
            yield batch.column("file")[a].as_py(), int(block[a]), batch.slice(a, b - a)


def _looked(part: pa.RecordBatch, block: int, how: tuple[str, str]) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The lines without byte order mark and carriage return, and of each whether it is blank and how it ends from
    outside and inside."""
    value = pc.utf8_rtrim(part.column("value"), "\r")
    if block == 0:
        value = pc.utf8_ltrim(value, "\ufeff")
    end_out, end_in = np.zeros(len(value), bool), np.ones(len(value), bool)
    quoted = np.flatnonzero(pc.match_substring(value, '"').to_numpy(zero_copy_only=False))
    lines = value.take(pa.array(quoted))
    for end, pattern in zip((end_out, end_in), how, strict=True):
        end[quoted] = pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    return value, (pc.equal(value, "").to_numpy(zero_copy_only=False), end_out, end_in)


def _summaries(lines: DataFrame, sep: str) -> DataFrame:
    """A row for each range: file, block, and for both starts how many records begin and whether it ends inside."""
    how = patterns(sep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walks, out = None, (), []
        keep = lambda: out.append({"file": at[0], "block": at[1], "begun_out": walks[0].begun, "begun_in": walks[1].begun, "end_out": walks[0].inside, "end_in": walks[1].inside})
        for file, block, part in _ranges(batches):
            if at != (file, block):
                if at:
                    keep()
                at, walks = (file, block), (Walk(False), Walk(True))
            seen = _looked(part, block, how)[1]
            for walk in walks:
                walk(*seen)
        if at:
            keep()
        yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("begun_out", pa.int64()), ("begun_in", pa.int64()), ("end_out", pa.bool_()), ("end_in", pa.bool_())]))

    return lines.mapInArrow(scan, "file string, block long, begun_out long, begun_in long, end_out boolean, end_in boolean")


def states(ranges: DataFrame) -> DataFrame:
    """ranges (file, block) with inside, the state that each begins in, before, the records that begin in earlier
    ranges of its file, and offset, the records, headers aside, of earlier files. A range sets the state, keeps it or
    turns it; so the state is that of the last range that sets it, turned as often as ranges since then turn it.
    Windows run over ranges and files, a row for each."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    r = ranges.withColumn("turns", F.sum((F.col("end_out") & ~F.col("end_in")).cast("int")).over(upto))
    r = r.withColumn("set", F.when(F.col("end_out") == F.col("end_in"), F.struct("end_out", "turns")))
    r = r.withColumn("last", F.last("set", ignorenulls=True).over(before)).withColumn("turned", F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(F.col("last.turns"), F.lit(0)))
    r = r.withColumn("inside", F.coalesce(F.col("last.end_out"), F.lit(False)) != (F.col("turned") % 2 == 1))
    r = r.withColumn("begun", F.when(F.col("inside"), F.col("begun_in")).otherwise(F.col("begun_out")))
    r = r.select("file", "block", "inside", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("before"), "begun")
    files = r.groupBy("file").agg(F.greatest(F.sum("begun") - 1, F.lit(0)).alias("n"))
    earlier = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return r.drop("begun").join(files.select("file", F.coalesce(earlier, F.lit(0)).alias("offset")), "file")


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, number, ordinal, record): the records of every file. number counts them in their file from 0, the
    header; ordinal counts those that are no headers over all files, in the order of their names, from 1. Blank lines
    between records are none, and carriage returns before line breaks are dropped. The last record of a file may end
    without closing its quotes.

    The ranges' states, a row of a hundred bytes for each split of a file (128 MB by default), are sent to all
    tasks; lines are not shuffled, only the pieces of records that reach over the end of a range are."""
    lines = _lines(spark, path)
    known = F.broadcast(settled(states(_summaries(lines, sep))).select(F.col("file").alias("f"), F.col("block").alias("b"), "inside", "before", "offset"))
    held = lines.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    kind = pa.schema([("file", pa.string()), ("number", pa.int64()), ("ordinal", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("record", pa.string())])

    how = patterns(sep)

    def cut(batches: Iterator[pa.RecordBatch], wholes: bool) -> Iterator[pa.RecordBatch]:
        at, walk, number, offset = None, None, 0, 0
        open_, of, first = [], 0, False  # lines of the record at hand, its number, and whether it began in an earlier range

        def rows(numbers: np.ndarray, texts: pa.Array, whole: bool) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(at[0]), n), pa.array(numbers, pa.int64()), pa.array(numbers + offset, pa.int64()), pa.repeat(pa.scalar(at[1], pa.int64()), n), pa.repeat(pa.scalar(whole), n), texts.cast(pa.string())], schema=kind)

        def piece(whole: bool) -> pa.RecordBatch:
            return rows(np.array([of]), pa.array(["\n".join(open_)]), whole)

        for file, block, part in _ranges(batches):
            if at != (file, block):
                if open_ and not wholes:
                    yield piece(False)
                begin = part.slice(0, 1).to_pylist()[0]
                at, walk, number, offset = (file, block), Walk(begin["inside"]), begin["before"], begin["offset"]
                open_, of, first = [], number - 1, begin["inside"]
            value, seen = _looked(part, block, how)
            inside, begins = walk(*seen)
            kept = inside | begins
            value, starts = value.filter(pa.array(kept)), np.flatnonzero(begins[kept])
            head = int(starts[0]) if len(starts) else len(value)
            open_ += value.slice(0, head).to_pylist()
            if open_ and (len(starts) or not walk.inside):
                if first != wholes:
                    yield piece(wholes)
                open_ = []
            if len(starts):
                whole = len(starts) - walk.inside  # the last one may go on
                ends = pa.array(np.append(starts, len(value))[: whole + 1] - head, pa.int32())
                if whole and wholes:
                    yield rows(number + np.arange(whole), pc.binary_join(pa.ListArray.from_arrays(ends, value.slice(head)), "\n"), True)
                number += len(starts)
                if walk.inside:
                    open_, of, first = value.slice(int(starts[-1])).to_pylist(), number - 1, False
        if open_ and not wholes:
            yield piece(False)

    schema = "file string, number long, ordinal long, block long, whole boolean, record string"
    whole, pieces = (held.mapInArrow(lambda batches, w=w: cut(batches, w), schema) for w in (True, False))
    parts = F.array_sort(F.collect_list(F.struct("block", "record")))
    joined = pieces.groupBy("file", "number", "ordinal").agg(F.array_join(F.transform(parts, lambda x: x["record"]), "\n").alias("record"))
    return whole.select("file", "number", "ordinal", "record").unionByName(joined)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A file or folder of files with a header as text columns, named as the library names them, with _src_row, the
    ordinal of each record in the source, of which the header is row 1. Values missing at the end are null, further
    ones are left out."""
    options = {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path, header=True).columns
    rows = csv_records(spark, path, sep).filter("number > 0")
    value: Column = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), options)
    parsed = rows.select("ordinal", F.inline(F.array(value)))  # one parse a record, whichever columns are asked for
    return parsed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], (F.col("ordinal") + 1).alias("_src_row"))
