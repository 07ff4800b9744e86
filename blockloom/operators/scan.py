"""Prefix scans in blocks, and stream compaction."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators.blocks import block_of, with_index
from blockloom.operators.reduce import _FOLDS, _NODES, block_partials

#: Most blocks whose totals meet in one task and are broadcast. Longer inputs get longer blocks.
MAX_BLOCKS = 1 << 16


def scan_chunk(n: int, chunk: int = 0) -> int:
    return max(chunk or 1 << 16, -(-n // MAX_BLOCKS))


def scan_blocks(indexed: DataFrame, value: Column, n: int, *, op: str = "sum", exclusive: bool = False, identity: Column | None = None, chunk: int = 0, idx: str = "idx", name: str = "scan") -> DataFrame:
    """indexed with the inclusive or exclusive running sum, min or max of value in index order.

    Blocks of the index are scanned by themselves; the totals of the blocks before, MAX_BLOCKS rows at most, are added
    after a broadcast. Null values change nothing. Before the first value stands identity, or null. Sums of doubles have
    the same bits for any partitioning, since blocks depend on the index alone.
    """
    size, fold, node = scan_chunk(n, chunk), _FOLDS[op], _NODES[op]
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(node(a, b))
    block = block_of(F.col(idx), size)
    totals = block_partials(indexed, value, size, op, idx)
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("block").alias("__block"), F.col("p")).select("__block", fold("p").over(before).alias("__start"))
    last = -1 if exclusive else 0
    local = Window.partitionBy("__block").orderBy(idx).rowsBetween(Window.unboundedPreceding, last)
    rows = indexed.withColumn("__block", block).withColumn("__local", fold(value).over(local))
    out = both(F.col("__start"), F.col("__local"))
    joined = rows.join(F.broadcast(starts), "__block", "left")
    return joined.select(*[F.col(f"`{c}`") for c in indexed.columns], (out if identity is None else F.coalesce(out, identity)).alias(name))


def scan_total(scanned: DataFrame, n: int, idx: str = "idx", name: str = "scan") -> DataFrame:
    """The right edge of an inclusive scan: its total."""
    return scanned.where(F.col(idx) == n - 1).select(F.col(name).alias("total"))


def scan_with(indexed: DataFrame, value: str, n: int, fn: Callable[[Any, Any], Any], *, chunk: int = 0, idx: str = "idx", name: str = "scan") -> DataFrame:
    """(idx, name): inclusive scan by any associative function, commutative or not, of two Python values.

    Two passes over blocks, as in scan_blocks. A block's rows stream through one task in order, batch by batch, so no block
    is held. Nulls change nothing.
    """
    size = scan_chunk(n, chunk)
    kind = indexed.schema[value].dataType
    both = lambda a, b: b if a is None else a if b is None else fn(a, b)
    rows = indexed.select(block_of(F.col(idx), size).alias("block"), F.col(idx).alias("idx"), F.col(value).alias("v"))
    ordered = lambda df: df.repartition("block").sortWithinPartitions("block", "idx")
    total_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("p", kind)])
    out_schema = T.StructType([T.StructField(idx, T.LongType()), T.StructField(name, kind)])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, p, type_ = None, None, None
        for batch in batches:
            type_, done = batch.column("v").type, []
            for block, v in zip(batch.column("block").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if block != now:
                    done += [(now, p)] if now is not None else []
                    now, p = block, None
                p = both(p, v)
            yield _pairs(done, type_)
        if now is not None:
            yield _pairs([(now, p)], type_)

    def _pairs(done: list, type_: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int64()), pa.array([x for _, x in done], type_)], names=["block", "p"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches))  # MAX_BLOCKS rows at most
        if found.num_rows:
            found = found.sort_by("block")
            own = [None, *itertools.accumulate(found.column("p").to_pylist(), both)][:-1]
            yield from pa.table({"block": found.column("block"), "p": pa.array(own, found.column("p").type)}).to_batches()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, p = None, None
        for batch in batches:
            out = []
            for block, v, start in zip(*[batch.column(c).to_pylist() for c in ("block", "v", "start")], strict=True):
                if block != now:
                    now, p = block, start
                p = both(p, v)
                out.append(p)
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(out, batch.column("v").type)], names=[idx, name])

    offsets = ordered(rows).mapInArrow(totals, total_schema).coalesce(1).mapInArrow(starts, total_schema).withColumnRenamed("p", "start")
    return ordered(rows.join(F.broadcast(offsets), "block")).select("block", "idx", "v", "start").mapInArrow(local, out_schema)


def compact(df: DataFrame, keep: Column, *order: Column | str, name: str = "slot") -> DataFrame:
    """The rows to keep, in order, each with its output slot.

    The slot is the exclusive scan of the flags; counting only kept rows gives the same and lets the filter reach the scan.
    """
    return with_index(df.where(keep), *order, name=name)
