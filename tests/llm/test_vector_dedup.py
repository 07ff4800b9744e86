import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import vector_dedup


def table(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g) for i, v, g in rows], "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "g", "d", "row", "own", "other", "i", "j", "n_links")])


def brute(rows, threshold):
    ok = [i for i, v, g in rows if g is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    by = {i: (np.array(v, np.float32).astype(float), g) for i, v, g in rows if i in ok}
    links, label = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for p, a in enumerate(ok):
        for b in ok[:p]:
            (x, g), (y, h) = by[a], by[b]
            if g == h and len(x) == len(y) and float(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                label[hi] = lo
    return sorted((i, links[i], find(i), find(i) == i) for i, *_ in rows)


@pytest.mark.parametrize("block", [4096, 7])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    rows = [(k * 3 % 241, (centres[k % 12] + rng.normal(size=24) * rng.choice([0.01, 0.1, 0.3, 0.4])).tolist(), int(k % 3) if k % 17 else None) for k in range(240)]
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] + [1.0] * 23, 1), (403, [None] + [1.0] * 23, 1), (404, [float("inf")] * 24, 1), (405, [], 1), (406, rows[5][1][:10], rows[5][2]), (407, [1e-30] * 24, 1), (408, [1e30] * 24, 1), (409, [-1.0] * 24, 1)]
    out = vector_dedup.near_duplicates(table(spark, rows), block=block)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 0.93)


def test_threshold_itself_and_bounds(spark):
    """Cosines within rounding of the threshold are told apart in full precision."""
    rows = []
    for k, c in enumerate((0.92999, 0.9299999, 0.93, 0.9300001, 0.93001)):
        rows += [(2 * k, [1.0, 0.0], k), (2 * k + 1, [c, float(np.sqrt(1 - c * c))], k)]
    assert sorted(tuple(r) for r in vector_dedup.near_duplicates(table(spark, rows)).collect()) == brute(rows, 0.93)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 64)), rng.normal(size=(200, 64))
    qx, sx, ex, nx = vector_dedup.quantise(x)
    qy, sy, ey, ny = vector_dedup.quantise(y)
    near = (qx @ qy.T) * sx[:, None] * sy[None]
    assert np.all(np.abs(near - (x @ y.T) / nx[:, None] / ny[None]) <= ex[:, None] + (1 + ex[:, None]) * ey[None] + vector_dedup.ROUNDING)


def test_repeated_ids_and_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (2, [1.0, 0.02], 0), (None, [1.0, 0.0], 0)]
    got = sorted(vector_dedup.near_duplicates(table(spark, rows)).collect(), key=repr)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    assert vector_dedup.near_duplicates(table(spark, [])).collect() == []


def test_long_vectors_and_doubles(spark):
    """Vectors of thousands of components, and components that only doubles hold."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 5000))
    rows = [(k, (centres[k % 4] + rng.normal(size=5000) * (0.2 if k % 3 else 0.45)).tolist(), 1) for k in range(40)]
    assert sorted(tuple(r) for r in vector_dedup.near_duplicates(table(spark, rows), block=9).collect()) == brute(rows, 0.93)
    exact = float(np.sqrt(1 - 0.93**2))
    pairs = [(0, [1.0, 0.0], 1), (1, [0.93 + 1e-12, exact], 1), (2, [1.0, 0.0], 2), (3, [0.93 - 1e-9, exact], 2)]
    doubles = spark.createDataFrame(pairs, "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in vector_dedup.near_duplicates(doubles).orderBy("vec_id").collect()] == [1, 1, 0, 0]


def test_squares_out_of_range(spark):
    """Parts whose squares are no numbers any more are compared like others."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=16)
    rows = [(k, (v * f).tolist(), 1) for k, f in enumerate((1.0, 1e-200, 1e200, -1.0, 1e-300))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (3, 0, 3, True), (4, 3, 0, False)]
