"""Numeric kernels built from the operators: matrix products and stencils."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.plans.chain import run_phases

#: Side of a dense block, in rows and columns.
BLOCK = 256


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of sparse matrices a (i, k, v) and b (k, j, v); missing and null cells are 0.

    Cells are gathered into dense blocks, blocks meet by their inner index, and each pair is one product in memory; sums
    of blocks are combined before and after the shuffle, cell by cell. Cells that no product reaches are left out.
    """

    def blocks(df: DataFrame, row: str, col: str) -> DataFrame:
        cells = df.where(F.col("v").isNotNull()).select(F.floor(F.col(row) / BLOCK).alias("r"), F.floor(F.col(col) / BLOCK).alias("c"), F.struct(F.pmod(row, F.lit(BLOCK)).cast("int").alias("y"), F.pmod(col, F.lit(BLOCK)).cast("int").alias("x"), F.col("v").cast("double").alias("v")).alias("cell"))
        return cells.groupBy("r", "c").agg(F.collect_list("cell").alias("cells"))  # BLOCK * BLOCK cells at most

    left = blocks(a, "i", "k").select(F.col("r").alias("bi"), F.col("c").alias("bk"), F.col("cells").alias("lc"))
    right = blocks(b, "k", "j").select(F.col("r").alias("bk"), F.col("c").alias("bj"), F.col("cells").alias("rc"))

    def dense(cells: pa.Scalar) -> np.ndarray:
        own, out = cells.values, np.zeros((BLOCK, BLOCK))
        np.add.at(out, (own.field("y").to_numpy(), own.field("x").to_numpy()), own.field("v").to_numpy())
        return out

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = dense(batch.column("lc")[k]), dense(batch.column("rc")[k])
                i, j = np.nonzero((x != 0).astype(float) @ (y != 0).astype(float))
                v = (x @ y)[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(i + batch.column("bi")[k].as_py() * BLOCK), pa.array(j + batch.column("bj")[k].as_py() * BLOCK), pa.array(v)], names=["i", "j", "v"])

    pairs = left.join(right, "bk").select("bi", "bj", "lc", "rc")
    return pairs.mapInArrow(multiply, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def lcg_grid(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, cells): an n by n grid of a linear congruential sequence. The k-th number comes from a closed form, so rows are made anywhere."""
    mult, add, mod = 1664525, 1013904223, 1 << 32

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                k = i * n
                power = pow(mult, k, mod * (mult - 1))
                state = (seed * power + add * ((power - 1) // (mult - 1))) % mod
                own = []
                for _ in range(n):
                    state = (state * mult + add) % mod
                    own.append((state >> 12) / 1048576.0)
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["i", "cells"])

    return spark.range(n).mapInArrow(rows, "i long, cells array<double>")


def heat(grid: DataFrame, n: int, steps: int, cut_every: int = 4) -> DataFrame:
    """The grid (i, cells) after Jacobi steps of the five-point mean; the border stays.

    A row goes to itself and its two neighbours and meets theirs there: one shuffle a step, nothing else moves.
    """

    def step(rows: DataFrame, phase: int, _: object) -> DataFrame:
        sent = rows.select(F.explode(F.array(F.struct((F.col("i") - 1).alias("to"), F.lit(1).alias("side")), F.struct(F.col("i").alias("to"), F.lit(0).alias("side")), F.struct((F.col("i") + 1).alias("to"), F.lit(-1).alias("side")))).alias("m"), "cells")
        side = lambda s: F.max(F.when(F.col("m.side") == s, F.col("cells")))
        met = sent.groupBy(F.col("m.to").alias("i")).agg(side(-1).alias("up"), side(0).alias("own"), side(1).alias("down")).where("own IS NOT NULL")
        mean = F.transform("own", lambda c, j: F.when((j > 0) & (j < n - 1), 0.25 * (F.get("up", j) + F.get("down", j) + F.get("own", j - 1) + F.get("own", j + 1))).otherwise(c))
        return met.select("i", F.when(F.col("up").isNull() | F.col("down").isNull(), F.col("own")).otherwise(mean).alias("cells"))

    return run_phases(grid, steps, step, cut_every=cut_every)
