"""Delimited files whose quoted fields hold line ends, read by many tasks.

Spark's ``multiLine`` reader makes a file one task.  Here files are read as
plain lines, which split at any byte range (a block), in two passes:

1. each block reports the parity of its quotes, and whether one of its lines
   ends a record if the block starts outside quotes, or inside them;
2. a running sum of the parities over a file's blocks (one row a block) tells
   how each block starts, and which block began the record that is open there.
   Each block then joins the lines of its own records; the pieces of a record
   that crosses blocks are joined by that first block.

A quote inside a quoted field is doubled, and a field with a quote is quoted
(RFC 4180), so a line end belongs to a field exactly if the quotes before it
are odd in number.  Line ends inside fields stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks (some 100 bytes each) up to which their states are broadcast; beyond
#: it, lines are joined to them by a sort on the block.
BROADCAST_BLOCKS = 200_000

_BLOCK = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value): the files' lines; n rises with the line inside a block."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("n"), "value"))


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of a batch's rows that lie in one block."""
    block = batch.column("block").to_numpy()
    file = batch.column("file")
    new = np.flatnonzero(block[1:] != block[:-1]) + 1
    moved = np.flatnonzero(pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1
    cuts = [0, *np.union1d(new, moved).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield (file[a].as_py(), int(block[a])), batch.slice(a, b - a)


def _open_after(value: pa.Array, quote: str, start: int) -> np.ndarray:
    """1 for each line after which a quoted field is open, else 0."""
    return (start + np.cumsum(pc.count_substring(value, quote).to_numpy(zero_copy_only=False))) % 2


def _block_parities(lines: DataFrame, quote: str) -> DataFrame:
    """(file, block, parity, ends_closed, ends_open): one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            for key, part in _by_block(batch):
                own = found.setdefault(key, [0, 0, 0])
                state = _open_after(part.column("value"), quote, own[0])
                own[0] = int(state[-1])
                own[1] |= int((state == 0).any())
                own[2] |= int((state == 1).any())
        keys = list(found)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                               *(pa.array([found[k][i] for k in keys], pa.int32()) for i in range(3))],
                              names=[*_BLOCK, "parity", "ends_closed", "ends_open"])

    return lines.select(*_BLOCK, "value").mapInArrow(run, "file string, block long, parity int, ends_closed int, ends_open int")


def block_states(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, block, start, owner): 1 where the block starts inside quotes, and
    the block that began the record open at this block's start (null: none is)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = _block_parities(lines, quote).withColumn("start", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"))
    # a block begins the record that it leaves open if one ends in it, or if it starts outside quotes
    ends = F.when(F.col("start") == 0, F.col("ends_closed")).otherwise(F.col("ends_open"))
    begins = F.when((F.col("start") == 0) | (ends == 1), F.col("block"))
    owner = F.last(begins, ignorenulls=True).over(before)
    return states.select(*_BLOCK, "start", F.when(F.col("start") == 1, owner).alias("owner"))


def _joined(quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, owner, held, seen = None, 0, None, [], 0

        def rows(texts, firsts, whole, owners):
            n = len(texts)
            return pa.record_batch([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(owners, pa.int64()),
                                    pa.array(whole, pa.bool_()), pa.array(firsts, pa.bool_()), pa.array(texts, pa.string())],
                                   names=[*_BLOCK, "owner", "whole", "first", "record"])

        def left():
            """The open record's lines at the end of a block."""
            own = owner if owner is not None else key[1]
            return rows(["\n".join(held)], [own == key[1] == 0 and seen == 0], [False], [own])

        for batch in batches:
            for now, part in _by_block(batch):
                if now != key:
                    if held:
                        yield left()
                    start = part.column("start")[0].as_py()
                    if start is None:
                        raise ValueError(f"{now[0]} was split in another way on the second pass")
                    key, state, held, seen = now, start, [], 0
                    owner = part.column("owner")[0].as_py()
                value = part.column("value")
                after = _open_after(value, quote, state)
                state = int(after[-1])
                lines, at = value.to_pylist(), 0
                texts, firsts, whole, owners = [], [], [], []
                for end in np.flatnonzero(after == 0).tolist():
                    held.extend(lines[at:end + 1])
                    at = end + 1
                    texts.append("\n".join(held))
                    firsts.append(owner is None and key[1] == 0 and seen == 0)
                    whole.append(owner is None)
                    owners.append(key[1] if owner is None else owner)
                    held, owner, seen = [], None, seen + 1
                held.extend(lines[at:])
                if texts:
                    yield rows(texts, firsts, whole, owners)
        if held:
            yield left()

    return run


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(record, first): the files' records as text, in no order; ``first`` marks
    a file's first.  Empty lines between records are records of no text.  A file
    whose quotes do not match ends with one record of all its last lines."""
    lines = _lines(spark, path)
    states = block_states(lines, quote).persist()
    if states.count() <= BROADCAST_BLOCKS:
        joined = lines.join(F.broadcast(states), _BLOCK, "left")
    else:
        joined = lines.join(states.hint("merge"), _BLOCK, "left").sortWithinPartitions(*_BLOCK, "n")
    out = joined.select(*_BLOCK, "start", "owner", "value").mapInArrow(
        _joined(quote), "file string, block long, owner long, whole boolean, first boolean, record string")
    pieces = (out.where(~F.col("whole")).groupBy("file", "owner")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "\n").alias("record"),
                   F.max("first").alias("first")))
    return out.where("whole").select("record", "first").unionByName(pieces.select("record", "first"))


def scan_quoted(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", quote: str = '"', check_header: bool = True) -> DataFrame:
    """Files with a header, as rows of ``schema``.  ``check_header`` raises an
    error where a header's names are not the schema's, in any case."""
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE"}
    records = quoted_records(spark, path, quote).withColumn("record", F.regexp_replace("record", "\r$", ""))
    keep = ~F.col("first")
    if check_header:
        names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])
        head = F.from_csv("record", names.simpleString()[len("struct<"):-1].replace(":", " "), options)
        same = F.lit(True)
        for i, name in enumerate(schema.names):
            same = same & F.coalesce(F.lower(head[f"c{i}"]) == name.lower(), F.lit(False))
        keep = F.when(~F.col("first"), True).when(same, False).otherwise(
            F.raise_error(F.concat(F.lit("header does not match the schema: "), F.col("record"))).cast("boolean"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return (records.where(keep & (F.trim("record") != ""))
            .select(F.from_csv("record", ddl, options).alias("row")).select("row.*"))
