import math

import pytest
from pyspark.sql import functions as F

from blockloom.control import CancellationToken
from blockloom.operators import bulk, kernels
from blockloom.operators.blocks import slot_bounds
from blockloom.plans import chain, recurse
from blockloom.storage import materialize


def log(df, k):
    return df.withColumn("log", F.concat("log", F.array(F.lit(k))))


def slots(spark, stages, n=32, participants=4, token=None):
    df = spark.range(n).select(F.col("id").alias("idx"), F.array().cast("array<int>").alias("log"))
    rows = chain.run_chain(df, n, stages, participants=participants, token=token).collect()
    return {s: {tuple(r.log) for r in rows if r.slot == s} for s in range(participants)}


def test_static_stages(spark):
    assert slots(spark, [chain.static_stage("s", log)] * 3, 64) == {s: {(0, 1, 2)} for s in range(4)}


def test_the_stage_after_a_serial_one_runs_on_slot_0(spark):
    stages = [chain.serial_stage("a", log), chain.serial_stage("b", log), chain.static_stage("c", log), chain.static_stage("d", log)]
    assert slots(spark, stages) == {0: {(0, 1, 2, 3)}, 1: {(0, 3)}, 2: {(0, 3)}, 3: {(0, 3)}}


def test_global_and_reduce_stages_see_all(spark):
    def total(df, _):
        return df.drop("sum").crossJoin(df.agg(F.sum("idx").alias("sum"))).select(df.columns)

    df = spark.range(100).select(F.col("id").alias("idx"), F.lit(0).cast("long").alias("sum"))
    for make in (chain.global_stage, chain.reduce_stage):
        out = chain.run_chain(df, 100, [make("first", lambda d, _: d.withColumn("idx", F.col("idx") + 1)), chain.static_stage("sum", total)], participants=3)
        assert {r["sum"] for r in out.collect()} == {5050}
    made = chain.make_stage(chain.Barrier.GLOBAL, lambda d, _: d)
    assert made.barrier is chain.Barrier.GLOBAL


def test_chain_of_nothing_and_of_no_rows(spark):
    assert slots(spark, []) == {s: {()} for s in range(4)}
    assert slots(spark, [chain.global_stage("g", log), chain.static_stage("s", log)], 0) == {s: set() for s in range(4)}


def test_stopped_chain(spark):
    token = CancellationToken.owned()

    def stop(df, k):
        token.request_stop()
        return log(df, k)

    assert slots(spark, [chain.static_stage("a", stop), chain.static_stage("b", log)], token=token) == {s: {(0,)} for s in range(4)}


@pytest.mark.parametrize("participants", [1, 3, 8])
def test_phases(spark, participants):
    bounds = spark.createDataFrame([(s, lo, hi) for s, (lo, hi) in enumerate(slot_bounds(32, participants))], "slot int, lo long, hi long").withColumn("v", F.col("slot").cast("long"))
    out = chain.run_phases(bounds, 30, lambda df, p, _: df.withColumn("v", F.col("v") + p + 1)).collect()
    assert {(r.slot, r.v) for r in out} == {(s, s + 30 * 31 // 2) for s in range(participants)}
    seen = []
    chain.run_phases(bounds, 4, lambda df, p, hook: df, pre_phase=seen.append)
    assert seen == [0, 1, 2, 3] and chain.run_phases(bounds, 0, None) is bounds


def test_stopped_phases(spark):
    token, seen = CancellationToken.owned(), []

    def phase(df, p, _):
        seen.append(p)
        if p == 2:
            token.request_stop()
        return df

    chain.run_phases(spark.range(4), 10, phase, token=token)
    assert seen == [0, 1, 2]


def test_recursion_values(spark):
    assert tuple(recurse.skynet(spark, 3).first()) == (3, 1000, 499_500)
    assert recurse.fibonacci(spark, 24).where("n = 24").first().fib == 46368
    assert {n: recurse.queens(spark, n).first().solutions for n in (1, 3, 6)} == {1: 1, 3: 0, 6: 4}
    small = recurse.geometric_tree(spark, max_depth=4, cut=2).collect()
    assert [(r.depth, r.nodes) for r in small][0] == (0, 1) and sum(r.nodes for r in small) == _tree_size(4)


def _tree_size(max_depth):
    import hashlib

    level, total = [hashlib.sha1(bytes(16) + (19).to_bytes(4, "big")).digest()], 0
    for depth in range(max_depth + 1):
        total += len(level)
        after = []
        for state in level:
            u = (int.from_bytes(state[16:], "big") & 0x7FFFFFFF) / 2**31
            n = int(math.log(1 - u) / math.log(1 - 1 / 5)) if depth < max_depth else 0
            after += [hashlib.sha1(state + i.to_bytes(4, "big")).digest() for i in range(n)]
        level = after
    return total


def test_knapsack(spark):
    items = [(k, 1 + k * 37 % 50, 1 + k * 53 % 70) for k in range(14)]
    df = spark.createDataFrame(items, "k int, w int, v int")
    best = max(sum(v for i, (_, w, v) in enumerate(items) if m >> i & 1) for m in range(1 << 14) if sum(w for i, (_, w, _) in enumerate(items) if m >> i & 1) <= 120)
    assert recurse.knapsack(df, 120, key="k", weight="w", value="v").first().best == best
    found = recurse.knapsack_search(df, 120, key="k", weight="w", value="v").first()
    assert found.best == best and found.branches < 2**14
    token = CancellationToken.owned()
    part = recurse.knapsack_search(df, 120, key="k", weight="w", value="v", token=token, stop_above=0.01, together=2).first()
    assert token.stop_requested and 0 < part.best <= best
    assert recurse.knapsack_search(df.limit(0), 120, key="k", weight="w", value="v").first().best == 0
    with pytest.raises(ValueError):
        recurse.fibonacci(spark, 92)
    assert recurse.fibonacci(spark, 91).where("n = 91").first().fib == 4660046610375530309


def test_stopped_expansion(spark):
    token = CancellationToken.owned()

    def step(level, depth):
        if depth == 1:
            token.request_stop()
        return recurse.fan_out(level, F.lit(2)).select("id")

    assert [x.count() for x in recurse.expand_levels(spark.range(1), step, token=token)] == [1, 2, 4]


def test_sorting(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).cast("int").alias("k"))
    assert [r.k for r in recurse.sort_keys(df, "k").collect()] == sorted(i * 7919 % 2003 for i in range(2000))


@pytest.mark.parametrize("broadcast", [True, False])
def test_nearest(spark, monkeypatch, broadcast):
    import numpy as np

    monkeypatch.setattr(bulk, "BLOCK", 16)
    if not broadcast:
        monkeypatch.setattr(bulk, "BROADCAST_NUMBERS", 0)
    x = np.random.default_rng(5).uniform(-1, 1, (60, 8)).astype(np.float32).astype(float)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, [float("nan")] * 8), (62, [1.0, 2.0]), (63, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.query_id: (r.nearest_id, r.distance2) for r in bulk.nearest(df, df).collect()}
    for i in range(60):
        d = [(float(np.square(x[i] - x[j]).sum()), j) for j in range(60) if j != i]
        assert got[i][0] == min(d)[1] and got[i][1] == pytest.approx(min(d)[0], abs=1e-12)
    assert all(got[i] == (None, None) for i in range(60, 64))
    assert bulk.nearest(df, df.limit(0)).where("nearest_id IS NOT NULL").count() == 0


@pytest.mark.parametrize("numbers", [4, 4_000_000])
def test_nearest_with_negative_ids(spark, monkeypatch, numbers):
    monkeypatch.setattr(bulk, "BROADCAST_NUMBERS", numbers), monkeypatch.setattr(bulk, "BLOCK", 2)
    df = spark.createDataFrame([(-1, [0.0, 0.0]), (-2, [0.0, 1.0]), (3, [5.0, 1.0]), (-9, [1.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in bulk.nearest(df, df).collect()} == {(-1, -2, 1.0), (-2, -1, 1.0), (3, -2, 25.0), (-9, None, None)}


def test_nearest_moves_each_vector_once(spark, monkeypatch):
    """Chunks of references in several jobs: what is shuffled is in proportion to the vectors; results are those of one chunk."""
    import numpy as np

    x = np.random.default_rng(6).uniform(-1, 1, (4000, 32)).astype(np.float32)
    x[5], x[3999] = x[9], x[9]
    rows = [(k, v[:16].tolist() if 100 <= k < 120 else v.tolist()) for k, v in enumerate(x)] + [(1, x[7].tolist())]
    found = {}
    for n in (1000, 4000):
        df = spark.createDataFrame(rows[:n] + rows[4000:], "vec_id long, embedding array<float>")
        one = {tuple(r) for r in bulk.nearest(df, df).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(bulk, "BLOCK", 200), patch.setattr(bulk, "BROADCAST_NUMBERS", 0), patch.setattr(bulk, "AT_ONCE", 3)
            written = []
            patch.setattr(bulk, "materialize", lambda df, name, by=None: written.append((name, stored := materialize(df, name, by))) or stored)
            many = {tuple(r) for r in bulk.nearest(df, df).collect()}
        assert one == many and len(many) == n
        found[n] = sum(stored.count() for name, stored in written if name in ("queries", "references"))
        assert not any(name == "tiles" for name, _ in written)
    assert found == {1000: 2 * 1001, 4000: 2 * 4001}
    got = {k: (near, d) for k, near, d in many}
    assert got[9] == (5, 0.0) and got[5] == (9, 0.0) and got[3999] == (5, 0.0) and got[1] == (7, 0.0) and got[100][0] in range(101, 120)


def test_matmul(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.uniform(-1, 1, (300, 270)), rng.uniform(-1, 1, (270, 20))
    cells = lambda m, r, c: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], f"{r} long, {c} long, v double")
    out = np.zeros((300, 20))
    for r in kernels.matmul(cells(a, "i", "k"), cells(b, "k", "j")).collect():
        out[r.i, r.j] = r.v
    assert np.allclose(out, a @ b, atol=1e-9)


def test_heat(spark):
    n, state, grid = 16, 0xC1701, []
    for _ in range(n * n):
        state = (state * 1664525 + 1013904223) % (1 << 32)
        grid.append((state >> 12) / 1048576.0)
    for _ in range(5):
        grid = [0.25 * (grid[p - n] + grid[p + n] + grid[p - 1] + grid[p + 1]) if 0 < p // n < n - 1 and 0 < p % n < n - 1 else grid[p] for p in range(n * n)]
    out = kernels.heat(kernels.lcg_grid(spark, n, 0xC1701), n, 5).collect()
    assert [c for r in sorted(out, key=lambda r: r.i) for c in r.cells] == grid


def test_descent_has_no_depth_limit_by_default(monkeypatch):
    class Level:
        def __init__(self, left):
            self.left = left

        def isEmpty(self):
            return self.left < 0

    from blockloom.plans import recurse

    monkeypatch.setattr(recurse, "materialize", lambda level, _: level)
    below = lambda level, _: Level(level.left - 1)
    assert len(recurse.expand_levels(Level(1_500), below)) == 1_501
    assert len(recurse.expand_levels(Level(1_500), below, max_depth=7)) == 8
