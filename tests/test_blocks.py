import pytest
from pyspark.sql import functions as F

from blockloom.operators.blocks import MAX_INDEX, block_of, chunk_size, coverage, reduce_chunk, slot_bounds, slot_of, with_index


@pytest.mark.parametrize("n", [1, 7, 64, 1000])
@pytest.mark.parametrize("participants", [1, 2, 5, 16])
def test_every_index_once(n, participants):
    for balance in ("static", "dynamic"):
        covered = [i for _, lo, hi in coverage(n, participants, balance=balance, first=3) for i in range(lo, hi)]
        assert covered == list(range(3, n + 3))
    assert [i for lo, hi in slot_bounds(n, participants) for i in range(lo, hi)] == list(range(n))


def test_default_blocks_are_twice_the_participants():
    assert len(coverage(1024, 4)) == 8 and len(coverage(1024, 4, balance="static")) == 4
    assert coverage(0, 4) == [] and coverage(-5, 4) == []
    assert chunk_size(10, 4, chunk=3) == 3


def test_reduce_chunk_ignores_participants():
    assert reduce_chunk(64) == 1 and reduce_chunk(65) == 2 and reduce_chunk(6400) == 100 and reduce_chunk(100, 7) == 7


def test_bounds_near_the_largest_index():
    bounds = slot_bounds(MAX_INDEX, 7)
    assert bounds[0][0] == 0 and bounds[-1][1] == MAX_INDEX and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    with pytest.raises(ValueError):
        slot_bounds(MAX_INDEX + 1, 7)


def test_slot_and_block_columns(spark):
    for n, p in ((1000, 7), (3, 8), (1, 4)):
        rows = spark.range(n).select("id", slot_of(F.col("id"), n, p).alias("slot"), block_of(F.col("id"), 10).alias("block")).collect()
        bounds = slot_bounds(n, p)
        assert all(bounds[r.slot][0] <= r.id < bounds[r.slot][1] and r.block == r.id // 10 for r in rows)
    big = MAX_INDEX - 1
    row = spark.createDataFrame([(big - 1,)], "id long").select(slot_of(F.col("id"), big, 16).alias("slot"), block_of(F.col("id"), 1000).alias("block")).first()
    assert row.slot == 15 and row.block == (big - 1) // 1000


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_index_is_dense_and_ordered(spark, parts):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("k"), F.lit("x").alias("idx0")).repartition(parts)
    rows = with_index(df, "k").collect()
    assert sorted(r.idx for r in rows) == list(range(500))
    assert [r.k for r in sorted(rows, key=lambda r: r.idx)] == sorted(r.k for r in rows)


def test_index_with_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1), (2, 1), (2, 2), (None, 3)], "k int, v int")
    rows = sorted(with_index(df, "k").collect(), key=lambda r: r.idx)
    assert [r.idx for r in rows] == [0, 1, 2, 3] and [r.k for r in rows] == [None, None, 2, 2]
    assert with_index(df.limit(0), "k").count() == 0
