"""Connected components of a graph given as links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every end of a link: the smallest id that can be reached.

    Alternates the large-star and small-star steps until nothing changes; the rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder. Smallest neighbours are found by an aggregate that combines
    before the shuffle and then joined, so a node with very many neighbours is split like any skewed join key. Links to
    oneself and null ends are ignored.
    """
    x, y = F.col(a), F.col(b)
    edges = materialize(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(edges)
        edges = after
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
