"""CSV files read by many tasks each, though quoted cells may hold line ends.

Whether a line begins inside a quoted cell depends on every quote before it.
Each range of a file is therefore scanned for both cases at once: how many
quotes it has (odd or even), and whether a record begins in it in either case.
A running sum over the ranges, one row each, then says which case holds, and a
second scan cuts every range into records. Only a record that crosses a border
is put together from several ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.scratch import settle
from papyra.shipping import ship

_RANGE = ["file", "begin"]


def _lines(spark: SparkSession, path: str, range_bytes: int | None) -> DataFrame:
    """(value, file, begin): the physical lines, each range's in order, ``begin`` being the range's first byte in the file.

    Read in a session of its own, whose settings make every scan cut the files
    alike, however many executors there are at the time.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes) if range_bytes else spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if range_bytes:
        own.conf.set("spark.sql.files.openCostInBytes", str(min(range_bytes, 4 << 20)))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    read = own.read.option("lineSep", "\n").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))


def _runs(batch: pa.RecordBatch):
    """The stretches of a batch that lie in one range: its file and begin, their first row and their lines."""
    file, begin = batch.column("file"), batch.column("begin").to_numpy(zero_copy_only=False)
    n = len(begin)
    if not n:
        return
    other = (begin[1:] != begin[:-1]) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(other) + 1).tolist(), n]
    for at, to in zip(edges, edges[1:], strict=False):
        yield file[at].as_py(), int(begin[at]), at, batch.column("value").slice(at, to - at)


def _odd_before(value: pa.Array, odd: int) -> tuple[np.ndarray, int]:
    """Of each line whether the quotes before it are odd in number, and the same after the last; ``odd`` holds before the first."""
    sums = np.cumsum(pc.count_substring(value, '"').to_numpy(zero_copy_only=False), dtype=np.int64) + odd
    return np.concatenate([[odd], sums[:-1]]) & 1 == 1, int(sums[-1] & 1)


def _joined(value: pa.Array, edges: np.ndarray) -> pa.Array:
    """The lines between neighbouring edges, each stretch as one string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), value), "\n")


def ranges(lines: DataFrame) -> DataFrame:
    """(file, begin, odd, starts_inside): of each range whether its quotes are odd in number, and whether a record begins in it if its first byte lies inside quotes."""
    ship(lines.sparkSession)

    def scan(batches):
        now, odd, starts = None, 0, False
        for b in batches:
            for file, begin, _, value in _runs(b):
                if (file, begin) != now:
                    if now:
                        yield pa.record_batch({"file": [now[0]], "begin": [now[1]], "odd": [bool(odd)], "starts_inside": [starts]})
                    now, odd, starts = (file, begin), 0, False
                before, odd = _odd_before(value, odd)
                starts = starts or bool(before.any())  # inside at first, outside after an odd number of quotes
        if now:
            yield pa.record_batch({"file": [now[0]], "begin": [now[1]], "odd": [bool(odd)], "starts_inside": [starts]})

    return lines.mapInArrow(scan, "file string, begin long, odd boolean, starts_inside boolean")


def _placed(table: DataFrame) -> DataFrame:
    """Each range with whether it begins inside quotes, and the range in which the record that is open there began."""
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier) % 2, F.lit(0)) == 1
    known = table.withColumn("inside", inside)
    own = F.when(~F.col("inside") | F.col("starts_inside"), F.col("begin"))
    return known.withColumn("opened", F.when(F.col("inside"), F.last(own, ignorenulls=True).over(earlier))).select("file", "begin", "inside", "opened")


def records(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(file, begin, nth, record): the logical lines of the files, quoted line ends kept, without their own; nth counts a range's records from 0."""
    ship(spark)
    lines = _lines(spark, path, range_bytes)
    # One row a range: 100 TB in ranges of 128 MB are under a million.
    where = settle(_placed(settle(ranges(lines), "csv-ranges")), "csv-places")
    joined = lines.join(F.broadcast(where), _RANGE)

    def cut(batches):
        now, nth, held, owner, whole, inside = None, 0, [], None, True, 0

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=_PIECE)

        def closed(last: bool):
            # A piece is whole if its record neither began before the range nor is still open at its end.
            out = rows([now[0]], [owner if owner is not None else now[1]], [nth], [now[1]], [whole and not last], ["\n".join(held)])
            held.clear()
            return out

        for b in batches:
            for file, begin, at, value in _runs(b):
                if (file, begin) != now:
                    if held:
                        yield closed(inside == 1)
                    now, nth, inside = (file, begin), 0, int(b.column("inside")[at].as_py())
                    owner, whole = b.column("opened")[at].as_py(), not inside
                before, inside = _odd_before(value, inside)
                starts = np.flatnonzero(~before)
                first = int(starts[0]) if len(starts) else len(value)
                if first:
                    held.append(_joined(value, np.array([0, first]))[0].as_py())
                if not len(starts):
                    continue
                if held:
                    yield closed(False)
                    nth, owner, whole = nth + 1, None, True
                if k := len(starts) - 1:
                    yield rows([file] * k, np.full(k, begin), np.arange(nth, nth + k), np.full(k, begin), np.ones(k, bool), _joined(value, starts))
                    nth += k
                held.append(_joined(value, np.array([starts[-1], len(value)]))[0].as_py())
        if held:
            yield closed(inside == 1)

    pieces = joined.mapInArrow(cut, "file string, owner long, nth long, begin long, whole boolean, text string")
    pieces = spark.read.schema(pieces.schema).parquet(settle(pieces, "csv-pieces")._settled_at)
    # The last record of a range that is still open goes on as the first of the next ones.
    broken = pieces.filter("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("begin", "nth", "text"))).alias("p"))
    joined_up = broken.select("file", F.col("owner").alias("begin"), F.col("p")[0]["nth"].alias("nth"), F.array_join("p.text", "\n").alias("record"))
    every = pieces.filter("whole").select("file", "begin", "nth", F.col("text").alias("record")).unionByName(joined_up)
    return every.withColumn("record", F.regexp_replace("record", "\\r$", ""))


_PIECE = ["file", "owner", "nth", "begin", "whole", "text"]


def read_csv(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """What ``files.read_csv`` gives, with several tasks a file: every column a string, missing cells empty, rows without any value dropped.

    All files have the header of the first; a byte order mark is dropped.
    Quoted cells may hold doubled quotes and line ends, which stay as they are
    (the other reader turns CRLF inside a cell into LF). No rows and no header
    give an empty table.
    """
    every = records(spark, path, range_bytes)
    is_head = (F.col("begin") == 0) & (F.col("nth") == 0)
    first = every.filter(is_head).orderBy("file").select("record").first()
    if first is None:
        return spark.createDataFrame([], "value string")
    csv = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    line = first[0].lstrip("﻿")
    width = spark.range(1).select(F.size(F.split(F.lit(line), ",")).alias("n")).first()[0]
    names = list(spark.range(1).select(F.from_csv(F.lit(line), ", ".join(f"c{k} string" for k in range(width)), csv).alias("r")).select("r.*").first())
    names = [n for n in names if n is not None]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return every.filter(~is_head).select(F.from_csv("record", schema, csv).alias("r")).select("r.*").na.drop("all").na.fill("")
