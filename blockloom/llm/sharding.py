"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import first_columns

RING = 1 << 32
#: Copies of one row that a task expands at once.
COPIES = 1 << 16


class Ring:
    """Virtual nodes of all shards in clockwise order. Arc k ends at virtual node k, whose shard is the home of its keys."""

    def __init__(self, n_shards: int, vnodes: int) -> None:
        points = sorted((int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:4], "big"), s) for s in range(n_shards) for v in range(vnodes))
        self.n_shards, self.ends, self.shards = n_shards, np.array([p for p, _ in points], np.int64), [s for _, s in points]

    def arcs(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions) % len(self.ends)

    def clockwise(self, arc: int) -> Iterator[int]:
        seen: set[int] = set()
        for k in range(len(self.shards)):
            s = self.shards[(arc + k) % len(self.shards)]
            if s not in seen:
                seen.add(s)
                yield s

    def flows(self, counts: dict[tuple[int, int], int], capacity: list[int]) -> list[tuple[int, int, int, int, int, int]]:
        """(arc, band, from rank, to rank, shard, slot of the first): keys arrive by band, then arc, and go clockwise to the first shard with room."""
        filled, out = [0] * self.n_shards, []
        for band, arc in sorted((b, a) for a, b in counts):
            at, n = 0, counts[arc, band]
            for s in self.clockwise(arc):
                if at == n:
                    break
                if (take := min(n - at, capacity[s] - filled[s])) > 0:
                    out.append((arc, band, at, at + take, s, filled[s]))
                    filled[s], at = filled[s] + take, at + take
        return out


def capacities(n: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may hold: (1 + slack) times the mean, at no slack exactly as many as there are, counts at most one apart."""
    if slack:
        return [math.ceil((1 + slack) * n / n_shards)] * n_shards
    return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]


def _expanded(ranked: DataFrame) -> DataFrame:
    """One row for each of a row's copies, with its rank. Rows of very many copies are dealt out in stretches of COPIES first."""
    stretches = ranked.where(F.col("copies") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("stretch"))
    dealt = stretches.repartition("id", "size", "text_crc32", "stretch")
    part = dealt.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("stretch") * COPIES)).withColumn("first", F.col("first") + F.col("stretch") * COPIES).drop("stretch")
    every = ranked.where(F.col("copies") <= COPIES).unionByName(part)
    return every.select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("rank"))


def shard(docs: DataFrame, *, n_shards: int = 40, vnodes: int = 64, slack: float = 0.0, bands: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row; counts of shards are at most one apart at slack 0.

    A key is hashed to a place on the ring and belongs to the next virtual node clockwise; a full shard's surplus goes on
    clockwise. All keys of one arc have the same way round, so the driver needs only the arcs' row counts: n_shards *
    vnodes * bands numbers, whatever the input. Bands order the keys of an arc by another hash. The flows that it works
    out are as few, and are broadcast; a row finds its shard and slot by its rank in (arc, band). A hot key spreads over
    bands by its text; rows equal in id, size and checksum are counted before the shuffle and expanded at the end.

    Null ids hash like any key, null texts have size 16 and checksum 0. Empty table: empty result. Rows that are the same
    in id, size and checksum are interchangeable. Other columns are not read.
    """
    spark, ring = docs.sparkSession, Ring(n_shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(positions: pd.Series) -> pd.Series:
        return pd.Series(ring.arcs(positions.to_numpy()).astype(np.int32))

    keys = first_columns(docs, id=id_col, text=text_col).select(
        "id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    counted = keys.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = counted.select(
        "*",
        arc_of(F.pmod(F.xxhash64("id"), F.lit(RING))).alias("arc"),
        F.xxhash64("id", "size", "text_crc32").alias("order"),
    ).withColumn("band", F.pmod("order", F.lit(bands)).cast("int"))
    counts = {(r.arc, r.band): r.n for r in placed.groupBy("arc", "band").agg(F.sum("copies").alias("n")).collect()}
    flows = ring.flows(counts, capacities(sum(counts.values()), n_shards, slack))
    table = spark.createDataFrame(pd.DataFrame(flows, columns=["arc", "band", "lo", "hi", "shard", "base"]), "arc int, band int, lo long, hi long, shard int, base long")
    in_arc = Window.partitionBy("arc", "band").orderBy("order", "id", "size", "text_crc32")
    ranked = placed.withColumn("first", F.sum("copies").over(in_arc.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    return (
        _expanded(ranked)
        .join(F.broadcast(table), ["arc", "band"])
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
