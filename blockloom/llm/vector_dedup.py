"""Embedding near-dedup: int8 tile products with rigorous error bounds, and full precision where they leave a doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm.common import first_columns, materialize
from blockloom.llm.components import components

#: Vectors of a block; a tile is the product of two blocks.
BLOCK = 4096
#: Rows of a tile multiplied at once, and pairs recomputed at once.
STRIP, PAIRS = 512, 1 << 16
#: Rounding of the float32 products and sums of up to 2^15 int8 products, with room to spare.
ROUNDING = 1e-5


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(integers up to 127 as float32, scales, errors, norms): unit vector = integers * scale + a rest no longer than error."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit = vectors / norms[:, None]
    scales = np.abs(unit).max(1) / 127
    whole = np.rint(unit / scales[:, None])
    return whole.astype(np.float32), scales, np.linalg.norm(unit - whole * scales[:, None], axis=1), norms


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find by smallest labels over arrays of links, in place."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]


def tile(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(links of each of x's then y's vectors, their smallest index in the tile's components, pairs recomputed)."""
    qx, sx, ex, nx = quantise(x)
    qy, sy, ey, ny = (qx, sx, ex, nx) if same else quantise(y)
    shift = 0 if same else len(x)
    links, labels, redone = np.zeros(len(x) + shift if same else len(x) + len(y), np.int64), np.arange(len(x) if same else len(x) + len(y)), 0
    for k in range(0, len(x), STRIP):
        part = slice(k, k + STRIP)
        near = (qx[part] @ qy.T) * sx[part, None].astype(np.float32) * sy[None].astype(np.float32)
        # |u.v - qu.qv| <= |eu| |v| + |qu| |ev| <= eu + (1 + eu) ev
        doubt = ex[part, None] + (1 + ex[part, None]) * ey[None] + ROUNDING
        i, j = np.nonzero(near >= threshold - doubt)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        redone += len(i)
        for m in range(0, len(i), PAIRS):
            a, b = i[m : m + PAIRS], j[m : m + PAIRS]
            cosine = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
            a, b = a[cosine >= threshold], b[cosine >= threshold] + shift
            links += np.bincount(a, minlength=len(links)) + np.bincount(b, minlength=len(links))
            merge(labels, a, b)
    return links, labels, redone


def near_duplicates(rows: DataFrame, *, threshold: float = 0.93, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of each row; vectors are compared only within equal, non-null groups and sizes.

    Each (group, size) is dealt into blocks of about `block` vectors by a hash, however large it is, and every pair of
    its blocks is one task's tile. Tile products of int8 values bound every cosine from both sides; pairs whose bound
    reaches the threshold are computed again in double precision. A tile returns counts and a spanning forest, at most
    one row a vector, never its pairs; vectors are shipped in their own type, and made doubles there; components of the forests are found by the shared distributed method.

    Null vectors, zero vectors and vectors with null or non-finite parts, rows with a null id or group: no links, their
    own component. Rows that repeat an id each count as a vector and share its component. Empty table: empty result.
    """
    base = first_columns(rows, id=id_col, v=vector_col, g=group_col)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = base.where(F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    own_type = base.schema["v"].dataType.elementType
    shipped = F.col("v") if isinstance(own_type, (T.FloatType, T.DoubleType)) else F.col("v").cast("array<double>")
    usable = usable.select("id", "g", shipped.alias("v"), F.size("v").alias("d"))
    usable = materialize(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = usable.groupBy("g", "d").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumnsRenamed({"g": "g2", "d": "d2"})
    dealt = usable.join(sizes, (F.col("g") == F.col("g2")) & (F.col("d") == F.col("d2"))).drop("g2", "d2")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    tiles = dealt.select("id", "row", "v", "g", "d", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("id", "row", "v", "g", "d", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        order = np.lexsort((table.column("row").to_numpy(), own))
        table, own = table.take(pa.array(order)), own[order]
        ids = table.column("id")
        size = table.column("d")[0].as_py()
        vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        # Powers of two change no digit of a cosine, and keep the squares of very small or large parts in range.
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        cut = int(np.searchsorted(own, i, "right"))
        links, labels, _ = tile(vectors, vectors, True, threshold) if i == j else tile(vectors[:cut], vectors[cut:], False, threshold)
        hit = np.flatnonzero(links)
        return pa.table({"row": table.column("row").take(pa.array(hit)), "id": ids.take(pa.array(hit)), "root": ids.take(pa.array(labels[hit])), "n": pa.array(links[hit])})

    kind = base.schema["id"].dataType.simpleString()
    found = materialize(tiles.groupBy("g", "d", "i", "j").applyInArrow(compare, f"row long, id {kind}, root {kind}, n long"), "tiles")
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = usable.select("id", "row").join(counts, "row", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    others = base.where(~(F.coalesce(F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False)))).select("id", F.lit(0).cast("long").alias("n_links"))
    every = linked.unionByName(others)
    return every.join(joined.withColumnRenamed("id", "member"), F.col("id") == F.col("member"), "left").select(
        F.col("id").alias(id_col),
        "n_links",
        F.coalesce("component", "id").cast("long").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )


#: The same by brute force.
ORACLE = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach AS (
  WITH RECURSIVE r(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN links l ON l.a = r.other)
  SELECT id, min(other) AS component_id FROM r GROUP BY id
)
SELECT e.vec_id, count(l.b) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN reach r ON r.id = e.vec_id LEFT JOIN links l ON l.a = e.vec_id
GROUP BY e.vec_id, r.component_id
"""
