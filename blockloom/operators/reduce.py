"""Ordered reductions whose result has the same bits for any partitioning.

Rows are folded one after another within fixed blocks of the index, and the blocks' partials by a tree of neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators.blocks import block_of, reduce_chunk

#: Partials that meet in one row at once; six levels of the tree make one of them.
FAN = 64
_LEVELS = 6
_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}
_NODES: dict[str, Callable[[Column, Column], Column]] = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def kahan_zero() -> Column:
    """A compensated sum of nothing."""
    return F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("c"))


def kahan_add(a: Column, x: Column) -> Column:
    """One step of compensated summation on struct(sum, c)."""
    y = x - a["c"]
    return _bound(F.struct(y.alias("y"), (a["sum"] + y).alias("t")), lambda s: F.struct(s["t"].alias("sum"), ((s["t"] - a["sum"]) - s["y"]).alias("c")))


def kahan_node(a: Column, b: Column) -> Column:
    return _bound(kahan_add(a, b["sum"]), lambda s: kahan_add(s, -b["c"]))


def block_partials(indexed: DataFrame, value: Column, chunk: int, op: str = "sum", idx: str = "idx") -> DataFrame:
    """(block, p): each block's values folded from the left in index order; null values are skipped.

    The fold is a running window aggregate of which the block's last row is kept: it spills, and needs no block in memory.
    """
    rows = indexed.select(F.col(idx).alias("idx"), block_of(F.col(idx), chunk).alias("block"), value.alias("v"))
    running = Window.partitionBy("block").orderBy("idx")
    so_far = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    folded = rows.select("block", _FOLDS[op]("v").over(so_far).alias("p"), (F.lead("idx").over(running)).isNull().alias("last"))
    return folded.where("last").select("block", "p")


def folded_partials(indexed: DataFrame, value: Column, chunk: int, start: Column, step: Callable[[Column, Column], Column], idx: str = "idx") -> DataFrame:
    """(block, p) by any step(accumulator, value) from `start`. A block's values are held as one array: give a chunk that fits."""
    rows = indexed.select(F.col(idx).alias("idx"), block_of(F.col(idx), chunk).alias("block"), value.alias("v"))
    lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("rows"))
    return lists.select("block", F.aggregate("rows", start, lambda acc, r: step(acc, r["v"])).alias("p"))


def tree(partials: DataFrame, n_blocks: int, node: Callable[[Column, Column], Column]) -> DataFrame:
    """(p): the partials (block, p) combined pairwise with their right neighbours, level by level; an odd one is carried.

    FAN neighbours meet in a row and go up six levels at once, so no step gathers more than FAN partials.
    """

    def level(a: Column) -> Column:
        pair = lambda k: F.when(2 * k + 1 < F.size(a), node(F.get(a, 2 * k), F.get(a, 2 * k + 1))).otherwise(F.get(a, 2 * k))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), pair)

    while True:
        lists = partials.groupBy(F.floor(F.col("block") / FAN).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "p"))).alias("rows"))
        for _ in range(_LEVELS):
            if "a" not in lists.columns:
                lists = lists.select("block", F.transform("rows", lambda r: r["p"]).alias("a"))
            lists = lists.select("block", level(F.col("a")).alias("a"))
        partials = lists.select("block", F.get("a", F.lit(0)).alias("p"))
        n_blocks = -(-n_blocks // FAN)
        if n_blocks <= 1:
            return partials.select("p")


def combined(partials: DataFrame, n_blocks: int, *, op: str = "sum", init: Column | None = None, determinism: str = "fixed", name: str = "value") -> DataFrame:
    """One row with the tree over the partials (block, p), and init combined on its left, once. See reduce_blocks()."""
    if determinism == "kahan":
        if op != "sum":
            raise ValueError("only sums are compensated")
        pairs = partials.select("block", kahan_add(kahan_zero(), F.coalesce(F.col("p").cast("double"), F.lit(0.0))).alias("p"))
        total = tree(pairs, n_blocks, kahan_node).select(F.col("p.sum").alias("p"))
    else:
        both = _NODES[op]
        node = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both(a, b))
        total = tree(partials, n_blocks, node)
    return _with_init(total.agg(F.first("p").alias("p")), op, init, name)


def _with_init(one: DataFrame, op: str, init: Column | None, name: str) -> DataFrame:
    if init is None:
        return one.select(F.col("p").alias(name))
    return one.select(F.when(F.col("p").isNull(), init).otherwise(_NODES[op](init, F.col("p"))).alias(name))


def orderless(indexed: DataFrame, value: Column, op: str) -> bool:
    """Whether the reduction is the same in any order: least and greatest values, and sums of whole numbers and decimals."""
    return op != "sum" or not isinstance(indexed.select(value).schema[0].dataType, (T.DoubleType, T.FloatType))


def reduce_blocks(
    indexed: DataFrame, value: Column, n: int, *, op: str = "sum", init: Column | None = None, determinism: str = "fixed", chunk: int = 0, idx: str = "idx", name: str = "value"
) -> DataFrame:
    """One row with the ordered reduction of value over an indexed frame of n rows.

    op: sum, min or max. init is combined once, on the left, after the tree; an empty frame gives init (null without
    one). determinism="kahan" compensates between blocks: each partial enters with compensation 0 and the sum is what is
    returned. All-null blocks take no part. What is the same in any order is a plain aggregate: every task folds its rows.
    """
    if determinism == "fixed" and orderless(indexed, value, op):
        return _with_init(indexed.agg(_FOLDS[op](value).alias("p")), op, init, name)
    size = reduce_chunk(n, chunk)
    return combined(block_partials(indexed, value, size, op, idx), -(-n // size), op=op, init=init, determinism=determinism, name=name)


def kahan_within(indexed: DataFrame, value: Column, n: int, *, chunk: int = 1 << 12, idx: str = "idx", name: str = "value") -> DataFrame:
    """One row with the sum that is compensated within blocks and between them; a block's own compensation ends with it.

    A block's values meet in one array, so blocks have `chunk` rows whatever n is.
    """
    number = F.coalesce(value.cast("double"), F.lit(0.0))
    blocks = folded_partials(indexed, number, chunk, kahan_zero(), kahan_add, idx).select("block", F.col("p.sum").alias("p"))
    return combined(blocks, -(-n // chunk), determinism="kahan", name=name)


def divergence(runs: DataFrame, run: str = "run", value: str = "value", baseline: int = 0) -> DataFrame:
    """(divergent_pct): the share of runs whose doubles differ in any bit from the baseline run's."""
    bits = lambda c: F.col(c).cast("double").cast("string")  # noqa: E731  the shortest text that reads back as the same bits
    base = runs.where(F.col(run) == baseline).select(bits(value).alias("__base"))
    return runs.join(F.broadcast(base.limit(1))).agg((100.0 * F.avg((bits(value) != F.col("__base")).cast("double"))).alias("divergent_pct"))
