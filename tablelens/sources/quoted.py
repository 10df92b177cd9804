"""A1/A2 — delimited files with line breaks inside quoted fields, read in splits by many tasks.

Whether a line break ends a record depends on all quotes before it in the file,
so a parser that starts in the middle cannot know. Three steps find out without
reading a file in one task:

1. Every split (as Spark's line reader cuts files) is run through for both
   possible beginnings, outside and inside a quoted field. The result is a
   function of two states, one row a split.
2. These functions are composed over a file's earlier splits, which gives the
   state at every split's beginning.
3. The splits are read again from that state and cut into records. What is left
   open at a split's ends (at most one fragment at either end) is joined to a
   record over the splits it spans.

Quotes open a field only at its beginning; elsewhere they are text, as pandas
and Spark's own reader take them. A doubled quote inside a quoted field is one
quote. Line breaks inside fields stay as they are (``\\n`` or ``\\r\\n``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fit import BROADCAST_KEYS, col, materialize

QUOTE = '"'
OUTSIDE, INSIDE = 0, 1
#: What a piece of a split is: a whole record, the end of one that began in an earlier split, the
#: beginning of one that ends in a later split, or a stretch of one that does neither here.
WHOLE, END, BEGIN, MIDDLE = range(4)


def end_state(line: str, state: int, sep: str) -> int:
    """The state after ``line``, which begins in ``state``."""
    at, n = 0, len(line)
    while True:
        if state == OUTSIDE:
            if line[at:at + 1] != QUOTE:
                at = line.find(sep, at) + 1
                if not at:
                    return OUTSIDE
                continue
            at += 1
        close = line.find(QUOTE, at)
        while close >= 0 and line[close + 1:close + 2] == QUOTE:
            close = line.find(QUOTE, close + 2)
        if close < 0:
            return INSIDE
        at = line.find(sep, close + 1) + 1
        if not at or at > n:
            return OUTSIDE
        state = OUTSIDE


def _transitions(sep: str):
    """(file, block, quoted) -> one row (file, block, outside, inside) a split: its end state from either beginning."""
    def run(batches):
        key, state = None, (OUTSIDE, INSIDE)

        def row():
            return pa.RecordBatch.from_pydict({"file": pa.array([key[0]]), "block": pa.array([key[1]]),
                                               "outside": pa.array([state[0]], pa.int32()), "inside": pa.array([state[1]], pa.int32())})
        for batch in batches:
            files, blocks, lines = (batch.column(c).to_pylist() for c in ("file", "block", "quoted"))
            for here, line in zip(zip(files, blocks), lines):
                if here != key:
                    if key is not None:
                        yield row()
                    key, state = here, (OUTSIDE, INSIDE)
                if line is not None:
                    state = end_state(line, state[0], sep), end_state(line, state[1], sep)
        if key is not None:
            yield row()
    return run


def split_starts(transitions: DataFrame) -> DataFrame:
    """(file, block, start): the state in which each split begins.

    A split's function keeps the state, swaps it, or sets it whatever it was. So
    a split begins in the state last set before it (outside, at a file's
    beginning), swapped as often as splits in between swap it.
    """
    swap = (F.col("outside") == INSIDE) & (F.col("inside") == OUTSIDE)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = transitions.withColumn("swaps", F.coalesce(F.sum(swap.cast("int")).over(before), F.lit(0)))
    was_set = F.when(F.col("outside") == F.col("inside"), F.struct("swaps", "outside"))
    rows = rows.withColumn("last", F.last(was_set, ignorenulls=True).over(before))
    state = F.when(F.col("last").isNull(), F.col("swaps")).otherwise(F.col("last.outside") + F.col("swaps") - F.col("last.swaps"))
    return rows.select("file", "block", (state % 2).cast("int").alias("start"))


def _records(sep: str):
    """Lines in order, with the state of their split's beginning -> (file, block, kind, first, record)."""
    names = ["file", "block", "kind", "first", "record"]

    def run(batches):
        key, held, out, state, began, first = None, [], [], OUTSIDE, True, False

        def close(kind):
            nonlocal first
            out.append((*key, kind, first, "\n".join(held)))
            held.clear()
            first = False

        def batch_of(rows):
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            files, blocks, starts, lines = (batch.column(c).to_pylist() for c in ("file", "block", "start", "line"))
            for file, block, start, line in zip(files, blocks, starts, lines):
                if (file, block) != key:
                    if held:
                        close(BEGIN if began else MIDDLE)
                    # ``began``: the record now open began in this split
                    key, state, began, first = (file, block), start, start == OUTSIDE, block == 0
                if state == INSIDE or QUOTE in line:
                    state = end_state(line, state, sep)
                    held.append(line)
                    if state == OUTSIDE:
                        held[-1] = held[-1].removesuffix("\r")
                        close(WHOLE if began else END)
                        began = True
                elif line.strip(" \r"):  # blank lines are no records
                    held.append(line.removesuffix("\r"))
                    close(WHOLE)
            yield batch_of(out)
            out = []
        if held:
            close(BEGIN if began else MIDDLE)
        yield batch_of(out)
    return run


def join_fragments(pieces: DataFrame) -> DataFrame:
    """(first, record) of the records that go over splits, from (file, block, kind, first, record) pieces.

    At most two pieces a split. A record that the file's end leaves open ends there.
    """
    so_far = Window.partitionBy("file").orderBy("block", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = F.when(F.col("kind") == BEGIN, 1).otherwise(0)  # a split may end one record and begin another
    owned = (pieces.where(F.col("kind") != WHOLE).withColumn("order", order)
             .withColumn("owner", F.last(F.when(F.col("kind") == BEGIN, F.col("block")), ignorenulls=True).over(so_far)))
    parts = F.sort_array(F.collect_list(F.struct("block", "record")))  # the pieces of one record, which is one row in the end
    return (owned.groupBy("file", "owner").agg(parts.alias("parts"), F.max("first").alias("first"))
            .select("first", F.array_join(F.col("parts.record"), "\n").alias("record")))


def physical_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, line) in file order within each split; a byte order mark at a file's beginning is gone."""
    rows = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.upper().replace("-", "") == "UTF8" else F.decode(F.col("value").cast("binary"), encoding)
    block = F.col("_metadata.file_block_start")
    mark = F.when((block == 0) & line.startswith("﻿"), F.substring(line, 2, 1 << 30)).otherwise(line)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), block.alias("block"), mark.alias("line"))


def has_quotes(spark: SparkSession, path: str) -> bool:
    """Whether any line holds a quote; ends at the first one found."""
    return not spark.read.option("lineSep", "\n").text(path).where(F.col("value").contains(QUOTE)).isEmpty()


def read_quoted(spark: SparkSession, path: str, columns: list[str], sep: str, encoding: str, extra: str) -> DataFrame:
    """The records of all files as text columns, staged once, with ``_header`` marking each file's first record.

    ``extra``: one more column, for fields beyond the header's.
    """
    lines = physical_lines(spark, path, encoding)
    only_quoted = F.when(F.col("line").contains(QUOTE), F.col("line")).alias("quoted")
    transitions = lines.select("file", "block", only_quoted).mapInArrow(_transitions(sep), "file long, block long, outside int, inside int")
    starts = materialize(split_starts(transitions))
    if starts.count() <= BROADCAST_KEYS:  # one row a split
        ready = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        ready = (lines.withColumn("place", F.monotonically_increasing_id()).join(starts, ["file", "block"])
                 .repartition("file", "block").sortWithinPartitions("file", "block", "place"))
    pieces = ready.select("file", "block", "start", "line").mapInArrow(_records(sep), "file long, block long, kind int, first boolean, record string")
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(columns) + 1)])
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "emptyValue": "", "mode": "PERMISSIVE"}

    def fields(df: DataFrame, *also: str) -> DataFrame:
        return df.withColumn("fields", F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), options)).select(*also, "fields.*")
    whole = F.col("kind") == WHOLE
    staged = materialize(fields(pieces, "file", "block", "kind", "first", F.when(~whole, F.col("record")).alias("record")))
    names = [col(f"f{i}") for i in range(len(columns) + 1)]
    rows = staged.where(whole).select("first", *names)
    rows = rows.unionByName(fields(join_fragments(staged.select("file", "block", "kind", "first", "record")), "first").select("first", *names))
    return rows.select(F.col("first").alias("_header"), *(c.alias(n) for c, n in zip(names, [*columns, extra])))
