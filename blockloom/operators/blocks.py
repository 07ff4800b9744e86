"""Dense indexes, blocks and slots: the shape that every ordered operator works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.storage import materialize

#: Indexes end here; Spark's longs do.
MAX_INDEX = 2**63 - 1
#: Blocks of a reduction whose chunk is not given.
DEFAULT_BLOCKS = 64


def chunk_size(n: int, participants: int, chunk: int = 0, balance: str = "dynamic") -> int:
    """Rows of a map's block: chunk if given, else n over the participants (static) or over twice as many (dynamic)."""
    if chunk:
        return chunk
    parts = participants * (2 if balance == "dynamic" else 1)
    return max(1, -(-n // parts))


def reduce_chunk(n: int, chunk: int = 0) -> int:
    """Rows of a reduction's block. It never depends on the participants, so neither does the result."""
    return chunk or max(1, -(-n // DEFAULT_BLOCKS))


def slot_bounds(n: int, participants: int) -> list[tuple[int, int]]:
    """[lo, hi) of each slot: contiguous, without gaps, exact for any n up to MAX_INDEX."""
    if not 0 <= n <= MAX_INDEX:
        raise ValueError(f"a range has 0 to {MAX_INDEX} rows, not {n}")
    return [(n * s // participants, n * (s + 1) // participants) for s in range(participants)]


def div(a: Column, b: Column | int) -> Column:
    """Whole division of longs; the operands aren't rounded to doubles on the way."""
    return F.call_function("div", a, F.lit(b))


def slot_of(idx: Column, n: int, participants: int) -> Column:
    """The slot whose bounds hold idx, for 0 <= idx < n."""
    if n == 0:
        return F.lit(0)
    if (n + 1) * participants > MAX_INDEX:
        idx = idx.cast("decimal(38,0)")
    return div((idx + 1) * F.lit(participants) - 1, n).cast("int")


def block_of(idx: Column, chunk: int, first: int = 0) -> Column:
    return div(idx - F.lit(first), chunk)


def with_index(df: DataFrame, *keys: Column | str, name: str = "idx") -> DataFrame:
    """df with its rows' dense 0-based positions in the order of keys; rows equal in all keys come in any order.

    The sort deals rows out by ranges of the keys, so no task holds more than its range, and is written once, which fixes
    each row's place in its file. Only row counts by file, at most as many as there are tasks, meet in one place and are
    broadcast. Select the columns you need before: all are written.
    """
    placed = materialize(df.orderBy(*keys).withColumn("__place", F.monotonically_increasing_id()), "indexed")
    part, at = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.select((F.col("__start") + at).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def coverage(n: int, participants: int, chunk: int = 0, balance: str = "dynamic", first: int = 0) -> list[tuple[int, int, int]]:
    """(block, lo, hi) of a map over [first, first + n); the last block is clipped, an empty or inverted range has none."""
    if n <= 0:
        return []
    size = chunk_size(n, participants, chunk, balance)
    return [(b, first + lo, first + min(lo + size, n)) for b, lo in enumerate(range(0, n, size))]
