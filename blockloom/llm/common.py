"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.storage import materialize, table

__all__ = ["bit_field", "bit_set", "cells", "column", "discard", "field_bits", "first_columns", "fresh", "materialize", "only", "plain", "raw", "resident", "small_batches", "steady", "table", "told", "without"]

#: Text held in numpy work arrays at once, in bytes. Only the size of the working set depends on it.
WORK_BYTES = 1 << 19

#: Least and most bits of a field by which rows that a join would drop are left out before it.
FIELD = (1 << 22, 1 << 27)

_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by materialize() which nothing will read again."""
    spark = tables[0].sparkSession
    for folder in {f.rpartition("/")[0] for df in tables for f in df.inputFiles() if "/blockloom/" in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def steady(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches. After each, memory that its work has freed goes back to the system: idle workers of a cluster stay small."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        _trim(0)


def field_bits(n: int) -> int:
    """Bits of a field for n keys: 64 a key, from FIELD[0] up to FIELD[1], whatever n. One key in 64 others passes, more beyond."""
    return min(max(1 << (64 * n).bit_length(), FIELD[0]), FIELD[1])


def bit_field(df: DataFrame, place: Column, bits: int) -> np.ndarray:
    """A field of `bits` bits, packed: those at the places (0 to bits - 1) that rows of df have are set.

    Tasks set bits before the shuffle; the driver gets bits / 8 bytes, however many rows there are.
    """
    at = place.cast("long") + 1
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for bucket, part in rows:
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] = np.frombuffer(part, np.uint8)
    return out


def bit_set(field: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the packed field's bits at the places are set."""
    return (field[places >> 3] >> (places & 7).astype(np.uint8)) & 1 != 0


def told(df: DataFrame, key: Column, ids: DataFrame, name: str) -> DataFrame:
    """df with a column `name`: whether a row's key may be among ids (one column of the same type); false is certain.

    A field of bits tells, whose size is taken from the number of ids up to FIELD[1] bits. It is a broadcast table of 4 KB
    rows that each row of df meets once, in the JVM. More ids than bits could not be told apart: then all rows may be.
    """
    n = ids.count()
    if n > FIELD[1] // 2:
        return df.withColumn(name, F.lit(True))
    bits = field_bits(n)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    own = place(column(ids.columns[0]))
    taken = fresh(df, "field_bucket"), fresh(df, "field_bits"), fresh(df, "field_place")
    field = ids.groupBy(F.bitmap_bucket_number(own).alias(taken[0])).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias(taken[1]))
    at = F.col(taken[2])
    met = df.withColumn(taken[2], place(key)).join(F.broadcast(field), F.bitmap_bucket_number(at) == F.col(taken[0]), "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substr(taken[1], F.shiftright(bit.cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn(name, F.coalesce(F.call_function("bit_get", byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))).drop(*taken)


def only(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ids; most others are left out before the shuffle."""
    perhaps, name = fresh(df, "perhaps"), fresh(df, "only")
    return told(df, key, ids, perhaps).where(F.col(perhaps)).drop(perhaps).join(ids.toDF(name), key.eqNullSafe(F.col(name)), "left_semi")


def without(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows whose key is not among ids; only rows that may be are shuffled."""
    perhaps, name = fresh(df, "perhaps"), fresh(df, "without")
    marked = told(df, key, ids, perhaps)
    rest = marked.where(F.col(perhaps)).join(ids.toDF(name), key.eqNullSafe(F.col(name)), "left_anti")
    return marked.where(~F.col(perhaps)).unionByName(rest).drop(perhaps)


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """What make() gives for the key. A process holds one such object: a worker that goes on to another stage drops the last one."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def cells(batch: pa.RecordBatch, column: str, budget: int = WORK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most budget bytes of text each, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > budget:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets counted from 0; null is as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def plain(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names that Python functions over whole rows can take."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """For applications whose executors have little memory: Python functions get batches of at most `size`, unless the session says otherwise.

    The operators never set this themselves; they work on any batch in slices of WORK_BYTES.
    """
    if spark.conf.get(_BATCH).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH, size)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def first_columns(docs: DataFrame, **named: str) -> DataFrame:
    """The columns an operator needs under fixed names; others, whatever they are called, do not get in its way."""
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in named.items()])
