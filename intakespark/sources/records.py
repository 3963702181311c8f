"""CSV records of any number of files, split in parallel even where quoted cells hold line feeds.

Spark's text reader splits files anywhere and gives lines with their file and the start of their split. Whether a line
continues a quoted cell depends on all before it, so

* a first pass says of each split what it does to an open and to a closed quote, and how many records begin in it
  either way: one short row a split;
* running over these rows in file order gives every split its carry (open or closed) and the number of its first record;
* a second pass cuts each split into records. What lies before the first and after the last border of a split are
  parts of a record that spans splits; only these few are brought together.

A quote opens a cell only at its begin, a doubled quote inside stands for one, and what follows a closing quote is taken
as it is, so a count of quotes alone would not do.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings in which line feeds, commas and quotes are single bytes that occur in no other sign.
WIDE = ("utf-16", "utf16", "utf-32", "utf32", "utf-7", "utf7")
_SPLITS = "file string, block long, closed_to boolean, open_to boolean, closed_starts long, open_starts long"
_CUT = "file string, block long, nth long, cells array<string>, part binary, closes boolean"


def ends_open(line: str, is_open: bool) -> bool:
    """Whether a quoted cell is still open at the end of a line."""
    if '"' not in line:
        return is_open
    at, size = 0, len(line)
    while True:
        if is_open:
            at = line.find('"', at)
            while at >= 0 and line.startswith('""', at):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            is_open = False
        elif at < size and line[at] == '"':
            is_open, at = True, at + 1
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _lines(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """(file and block, some lines of it), in order; bytes that are none of the encoding become the replacement sign."""
    for batch in batches:
        values = [(v or b"").decode(encoding, "replace") for v in batch.column(0).to_pylist()]
        keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        low = 0
        while low < len(keys):
            high = len(keys) if keys[-1] == keys[low] else next(k for k in range(low, len(keys)) if keys[k] != keys[low])
            yield keys[low], values[low:high]
            low = high


def _measure(encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, starts = None, [False, True], [0, 0]

        def row() -> pa.RecordBatch:
            values = (*now, *state, *starts)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], [c.split()[0] for c in _SPLITS.split(", ")])

        for key, lines in _lines(batches, encoding):
            if key != now:
                if now is not None:
                    yield row()
                now, state, starts = key, [False, True], [0, 0]
            for line in lines:
                for k in (0, 1):
                    starts[k] += not state[k] and line != ""
                if '"' in line:
                    state = [ends_open(line, s) for s in state]
        if now is not None:
            yield row()

    return run


def _cells(lines: list[str]) -> list[list[str]]:
    """The records of some lines; the last line brings no line feed into a cell that stays open."""
    csv.field_size_limit(sys.maxsize)
    last = len(lines) - 1
    return [r for r in csv.reader(x + "\n" * (k < last) for k, x in enumerate(lines)) if r]


def _cut(encoding: str, opened: frozenset):
    """Records of each split. ``opened`` names the splits that begin within a quoted cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, wait, nth, is_open = None, None, [], 0, False

        def rows(cells: list, first: int) -> pa.RecordBatch:
            n = len(cells)
            return made([now] * n, list(range(first, first + n)), cells, [None] * n, [None] * n)

        def part(lines: list[str], at: int, closes: bool) -> pa.RecordBatch:
            return made([now], [at], [None], ["\n".join(lines).encode("utf-8", "surrogatepass")], [closes])

        def made(keys, nths, cells, parts, closes) -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(nths, pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array(parts, pa.binary()), pa.array(closes, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _CUT.split(", ")])

        def end() -> Iterator[pa.RecordBatch]:
            if head is not None:
                yield part(head, -1, False)
            elif wait:
                yield part(wait, nth, False)

        for key, lines in _lines(batches, encoding):
            if key != now:
                if now is not None:
                    yield from end()
                now, wait, nth = key, [], 0
                is_open = key in opened
                head = [] if is_open else None
            if head is not None:
                for k, line in enumerate(lines):
                    head.append(line)
                    if not ends_open(line, True):
                        yield part(head, -1, True)
                        head, lines, is_open = None, lines[k + 1 :], False
                        break
                else:
                    continue
            done = 0
            for k, line in enumerate(lines):
                is_open = ends_open(line, is_open)
                if not is_open:
                    done = k + 1
            if done and (cells := _cells(wait + lines[:done])):
                yield rows(cells, nth)
                nth += len(cells)
            wait = lines[done:] if done else wait + lines
        if now is not None:
            yield from end()

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [_cells("\n".join(p.decode("utf-8", "surrogatepass") for p in parts).split("\n"))[0] for parts in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.list_(pa.string()))], ["file", "block", "nth", "cells"])


def read_records(spark: SparkSession, path: str, encoding: str = "utf-8", with_header: bool = True) -> DataFrame:
    """(seq, cells): the records of CSV files, ``seq`` counting from 0 in the order of file names and places.

    Results do not depend on how files are split or packed into tasks. Each file begins with a header of its own, which
    is left out unless ``with_header`` is false. Line ends of any kind count as line feeds, blank lines are no records,
    undecodable bytes become the replacement sign, and a quote that stays open takes the rest of its file (without a
    last line feed). Only one short row a split reaches the driver, and only of splits that begin within a quoted cell.
    Empty files and folders give no rows; encodings of more than one byte a comma raise ValueError.
    """
    if encoding.lower().startswith(WIDE):
        raise ValueError(f"files in {encoding} cannot be split at bytes; write them in UTF-8 first")
    lines = spark.read.text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    splits = lines.mapInArrow(_measure(encoding), _SPLITS)

    # The carry: the last split of the file that ends alike either way, turned over by those after it that swap open and closed.
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.sum(F.when(F.col("closed_to") & ~F.col("open_to"), 1).otherwise(0)).over(order)
    known = splits.withColumn("turned", turned).withColumn("fixed", F.when(F.col("closed_to") == F.col("open_to"), F.struct("closed_to", "turned")))
    known = known.withColumn("from", F.last("fixed", ignorenulls=True).over(before)).withColumn("so_far", F.coalesce(F.lag("turned").over(order), F.lit(0)))
    known = known.withColumn("open", F.pmod(F.coalesce(F.col("from.closed_to").cast("int"), F.lit(0)) + F.col("so_far") - F.coalesce(F.col("from.turned"), F.lit(0)), F.lit(2)) == 1)
    known = known.withColumn("starts", F.when(F.col("open"), F.col("open_starts")).otherwise(F.col("closed_starts")))
    known = known.withColumn("first", F.coalesce(F.sum("starts").over(before), F.lit(0))).select("file", "block", "open", "starts", "first")
    opened = frozenset((r.file, r.block) for r in known.where("open").select("file", "block").collect())

    cut = lines.mapInArrow(_cut(encoding, opened), _CUT)
    parts = cut.where(F.col("part").isNotNull())
    # A part after a split's last border begins a record; the parts at the heads of the next splits go on with it.
    within = Window.partitionBy("file").orderBy("block", "nth")
    begun = parts.withColumn("begin", F.last(F.when(F.col("nth") >= 0, F.struct("block", "nth")), ignorenulls=True).over(within))
    whole = begun.groupBy("file", "begin.block", "begin.nth").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), F.col("nth").alias("n"), "part"))), lambda x: x["part"]).alias("parts"))
    spanning = whole.select("file", "block", "nth", "parts").mapInArrow(_join, "file string, block long, nth long, cells array<string>")
    records = cut.where(F.col("part").isNull()).select("file", "block", "nth", "cells").unionByName(spanning)

    headers = 1 if with_header else 0
    sizes = known.groupBy("file").agg(F.greatest(F.sum("starts") - headers, F.lit(0)).alias("n"))
    files = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = known.join(files, "file").select("file", "block", (F.col("base") + F.col("first") - headers).alias("shift"), "first")
    numbered = records.join(placed, ["file", "block"]).where(F.col("first") + F.col("nth") >= headers)
    return numbered.select((F.col("shift") + F.col("nth")).cast("long").alias("seq"), "cells")


def read_header(spark: SparkSession, path: str, encoding: str = "utf-8") -> list[str]:
    """The first record of the first file: only as many of its first lines as that takes."""
    files = sorted(spark.read.text(path).inputFiles())
    for file in files:
        top = spark.read.text(file).where(F.col("_metadata.file_block_start") == 0).select(F.col("value").cast("binary"))
        n = 8
        while True:
            got = [(r[0] or b"").decode(encoding, "replace") for r in top.limit(n).collect()]
            lines, is_open = [], False
            for line in got:
                if line == "" and not lines:
                    continue
                lines.append(line)
                is_open = ends_open(line, is_open)
                if not is_open:
                    break
            if lines and not is_open or len(got) < n:
                break
            n *= 8
        if lines:
            return [h.removeprefix("﻿") for h in _cells(lines)[0]]
    return []
