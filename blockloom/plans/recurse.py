"""Recursion, level by level: a frontier of nodes is expanded until none are left."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.storage import materialize


#: Also under Spark's limit of 100 levels of a recursive query.
FIBONACCI = 91


def expand_levels(roots: DataFrame, step: Callable[[DataFrame, int], DataFrame], *, max_depth: int | None = None, token=None, cut_every: int = 1) -> list[DataFrame]:
    """The levels of a tree, roots first. step(level, depth) gives the children; each level is written once.

    A stopped token or max_depth ends the descent before the next level; by default no depth does.
    """
    levels, depth = [materialize(roots, "level")], 0
    while (max_depth is None or depth < max_depth) and not (token is not None and token.stop_requested):
        after = materialize(step(levels[-1], depth), "level")
        if after.isEmpty():
            break
        levels.append(after)
        depth += 1
    return levels


def union_all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def fan_out(nodes: DataFrame, n: Column, name: str = "child") -> DataFrame:
    """n rows for each node, numbered from 0; none where n is 0 or less."""
    return nodes.withColumn("__n", n).where("__n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias(name)).drop("__n")


def skynet(spark: SparkSession, depth: int = 6, fan: int = 10) -> DataFrame:
    """(depth, leaves, total): the sum of the leaf numbers of a complete tree, expanded level by level."""
    roots = spark.createDataFrame([(0,)], "label long")
    leaves = roots
    for _ in range(depth):
        leaves = fan_out(leaves, F.lit(fan)).select((F.col("label") * fan + F.col("child")).alias("label"))
    return leaves.agg(F.lit(depth).alias("depth"), F.count("*").alias("leaves"), F.coalesce(F.sum("label"), F.lit(0)).alias("total"))


def fibonacci(spark: SparkSession, n: int = 24) -> DataFrame:
    """(n, fib) of 0 to n, up to FIBONACCI, the last that a long holds. Calls of one argument are merged at each level: two sums a level, not a call tree."""
    if not 0 <= n <= FIBONACCI:
        raise ValueError(f"n is from 0 to {FIBONACCI}, not {n}")
    return spark.sql(f"WITH RECURSIVE f(n, a, b) AS (SELECT 0, 0L, 1L UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < {n}) SELECT n, a AS fib FROM f")


def queens(spark: SparkSession, n: int = 8) -> DataFrame:
    """(n, solutions): placements of n queens, one row of the board a level."""
    boards = spark.createDataFrame([([],)], "cols array<int>")

    def place(level: DataFrame, depth: int) -> DataFrame:
        tried = fan_out(level, F.lit(n), "c")
        clash = F.exists(F.transform("cols", lambda x, i: (x == F.col("c")) | (F.abs(x - F.col("c")) == depth - i)), lambda x: x)
        return tried.where(~clash).select(F.concat("cols", F.array(F.col("c").cast("int"))).alias("cols"))

    levels = expand_levels(boards, place, max_depth=n)
    found = levels[n] if len(levels) > n else levels[-1].limit(0)
    return found.agg(F.lit(n).alias("n"), F.count("*").alias("solutions"))


def knapsack(items: DataFrame, capacity: int, *, key: str, weight: str, value: str) -> DataFrame:
    """(capacity, best): the greatest value of items that fit, each used at most once.

    Items come one at a time, as in the recursion; of the branches that have used the same capacity only the best stays,
    so a level is an array of capacity + 1 numbers. Items meet in one row: each is a step of one fold, not a Spark job.
    """
    own = items.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(weight).cast("long").alias("w"), F.col(value).cast("long").alias("v")))).alias("items"))
    with_item = lambda best, x: F.transform(best, lambda old, c: F.when(c >= x.w, F.greatest(old, F.get(best, (c - x.w).cast("int")) + x.v)).otherwise(old))
    best = F.aggregate("items", F.array_repeat(F.lit(0).cast("long"), capacity + 1), with_item)
    return own.select(F.lit(capacity).cast("long").alias("capacity"), F.array_max(best).alias("best"))


def knapsack_search(items: DataFrame, capacity: int, *, key: str, weight: str, value: str, token=None, stop_above: float | None = None, together: int = 4) -> DataFrame:
    """(capacity, best, branches): the same by a search that is pruned by bounds; branches: how many were still open at the levels looked at.

    A level decides about one item, densest first. A branch is dropped if even a fractional filling of its room with the
    items to come cannot beat the best found so far, or if another has as much value and room. `together` levels are one
    plan. A stopped token ends the search with the best found so far; it stops itself when an improvement is by a share of
    over stop_above. The items, which are the depth of the search, are on the driver.
    """
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("k"), F.col(weight).cast("long").alias("w"), F.col(value).cast("long").alias("v")).where("w > 0 AND v > 0").collect()
    own = sorted(((r.w, r.v) for r in rows), key=lambda x: (-x[1] / x[0], x))
    level, best, seen = spark.createDataFrame([(capacity, 0)], "room long, value long"), 0, 1

    def bound(k: int) -> Column:
        """The value with a fractional filling of the room by items from number k on."""
        start = F.struct(F.col("room").cast("double").alias("room"), F.col("value").cast("double").alias("value"))
        rest = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(v)).alias("v")) for w, v in own[k:]])
        fill = lambda a, x: F.struct((a.room - F.least(a.room, x.w)).alias("room"), (a.value + x.v * F.least(a.room, x.w) / x.w).alias("value"))
        return F.aggregate(rest, start, fill).value if own[k:] else F.col("value").cast("double")

    for k in range(0, len(own), together):
        if token is not None and token.stop_requested:
            break
        for w, v in own[k : k + together]:
            taken = level.where(F.col("room") >= w).select((F.col("room") - w).alias("room"), (F.col("value") + v).alias("value"))
            level = level.unionByName(taken).groupBy("room").agg(F.max("value").alias("value"))
        level = materialize(level, "branches")
        found = level.agg(F.max("value"), F.count("*")).first()
        before, best, seen = best, max(best, found[0] or 0), seen + found[1]
        if token is not None and stop_above is not None and before and best > before * (1 + stop_above):
            token.request_stop()
        level = level.where(bound(k + together) > best)
    return spark.createDataFrame([(capacity, best, seen)], "capacity long, best long, branches long")


def geometric_tree(spark: SparkSession, *, seed: int = 19, branching: float = 4.0, max_depth: int = 10, cut: int = 5, parts: int = 0) -> DataFrame:
    """(depth, nodes) of the unbalanced tree whose node states are chained SHA-1 digests.

    A child's state is the digest of its parent's and the child's number; the last four bytes of a state, without sign,
    draw the number of children from a geometric distribution with mean `branching` above max_depth. Built-in functions
    alone; the frontier is dealt out anew at level `cut`, so that subtrees of any size spread over the tasks.
    """
    import math

    word = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    roots = spark.range(1).select(F.unhex(F.sha1(F.concat(F.lit(bytearray(16)), word(F.lit(seed))))).alias("state"))
    drawn = F.conv(F.hex(F.substring("state", 17, 4)), 16, 10).cast("long").bitwiseAND(F.lit(2**31 - 1)) / F.lit(2.0**31)
    shape = math.log(1.0 - 1.0 / (1.0 + branching))

    def children(level: DataFrame, depth: int) -> DataFrame:
        n = F.floor(F.log(1.0 - drawn) / F.lit(shape)).cast("int")
        grown = fan_out(level, n, "child").select(F.unhex(F.sha1(F.concat("state", word(F.col("child"))))).alias("state"))
        return grown.repartition(parts or spark.sparkContext.defaultParallelism) if depth == cut else grown

    levels = expand_levels(roots, children, max_depth=max_depth)
    return union_all([x.agg(F.lit(k).alias("depth"), F.count("*").alias("nodes")) for k, x in enumerate(levels)])


def sort_keys(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Full sort: ranges of the keys are dealt out, each range is sorted by itself."""
    return df.orderBy(*keys)
