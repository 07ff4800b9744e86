import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.engine import Engine
from blockloom.operators.blocks import with_index
from blockloom.operators.reduce import divergence, folded_partials, kahan_within, reduce_blocks, tree
from blockloom.operators.scan import compact, scan_blocks, scan_total, scan_with


def serial_fold(values, chunk=0):
    size = chunk or max(1, -(-len(values) // 64))
    level = []
    for lo in range(0, len(values), size):
        acc = 0.0
        for v in values[lo : lo + size]:
            acc = acc + v
        level.append(acc)
    while len(level) > 1:
        level = [level[k] + level[k + 1] if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def serial_kahan(values):
    total = c = 0.0
    for v in values:
        y = v - c
        t = total + y
        c = (t - total) - y
        total = t
    return total


def frame(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"idx long, v {kind}")


def reduced(df, n, **options):
    return reduce_blocks(df, F.col("v"), n, **options).first()[0]


def test_arithmetic_and_empty(spark):
    assert reduced(frame(spark, [float(i + 1) for i in range(1000)]), 1000) == pytest.approx(500500, rel=1e-12)
    none = frame(spark, [1.0]).limit(0)
    assert reduced(none, 0, init=F.lit(42.0)) == 42.0 and reduced(none, 0) is None


@pytest.mark.parametrize("chunk", [0, 1, 3, 97])
def test_same_bits_for_any_partitioning(spark, chunk):
    values = [math.sin(i * 0.001) for i in range(10_000 if chunk != 1 else 700)]
    want = serial_fold(values, chunk).hex()
    for parts in (1, 3, 7):
        assert reduced(frame(spark, values).repartition(parts), len(values), chunk=chunk).hex() == want


def test_kahan_between_blocks(spark):
    adversary = [1.0] * 64
    adversary[0], adversary[-1] = 1e20, -1e20
    for values in (adversary, [1.0] * 63 + [-63.0]):
        got = {reduced(frame(spark, values).repartition(p), 64, determinism="kahan").hex() for p in (1, 3, 7)}
        assert len(got) == 1
        want = serial_kahan(values)
        assert abs(float.fromhex(got.pop()) - want) <= 1e-12 * max(1.0, abs(want))
    with pytest.raises(ValueError):
        reduced(frame(spark, adversary), 64, determinism="kahan", op="min")


def test_kahan_within_takes_every_block(spark):
    """70, 4,097 and 5,000 blocks: more than six levels of the tree, and a block of one row at the end."""
    rng = random.Random(12)
    for n, chunk in ((140, 2), (4097, 1), (9999, 2)):
        values = [rng.uniform(-1e6, 1e6) for _ in range(n)]
        got = kahan_within(frame(spark, values), F.col("v"), n, chunk=chunk).first().value
        assert got == pytest.approx(math.fsum(values), rel=1e-15, abs=1e-9)


def test_init_nulls_and_operators(spark):
    df = frame(spark, [None, 5, None, 7, 1], "long")
    assert reduced(df, 5, init=F.lit(100)) == 113 and reduced(df, 5, op="min") == 1 and reduced(df, 5, op="max", init=F.lit(9)) == 9
    assert reduced(frame(spark, [None, None], "long"), 2, init=F.lit(3)) == 3


def test_order_is_kept(spark):
    words = [chr(97 + i % 26) for i in range(300)]
    parts = folded_partials(frame(spark, words, "string").repartition(5), F.col("v"), 4, F.lit(""), lambda a, b: F.concat(a, b))
    assert tree(parts, 75, lambda a, b: F.concat(a, b)).first()[0] == "".join(words)


def test_divergence(spark):
    runs = spark.createDataFrame([(0, 0.3), (1, 0.1 + 0.2), (2, 0.3), (3, 0.3)], "run int, value double")
    assert divergence(runs).first()[0] == 25.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.integers(0, 9))
def test_any_values(spark, values, chunk):
    assert reduced(frame(spark, values), len(values), chunk=chunk).hex() == (serial_fold(values, chunk) + 0.0).hex()


@pytest.mark.parametrize("op,fold", [("sum", lambda a, b: a + b), ("min", min), ("max", max)])
def test_scans(spark, op, fold):
    random.seed(7)
    values = [random.randrange(-1000, 1000) for _ in range(500)]
    inclusive, acc = [], None
    for v in values:
        acc = v if acc is None else fold(acc, v)
        inclusive.append(acc)
    df = frame(spark, values, "long").repartition(3)
    for chunk in (1, 7, 1000):
        rows = scan_blocks(df, F.col("v"), 500, op=op, chunk=chunk)
        assert [r.scan for r in rows.orderBy("idx").collect()] == inclusive
        before = scan_blocks(df, F.col("v"), 500, op=op, exclusive=True, identity=F.lit(0), chunk=chunk).orderBy("idx").collect()
        assert [r.scan for r in before] == [0, *inclusive[:-1]]
        assert scan_total(rows, 500).first()[0] == inclusive[-1]
    assert scan_blocks(df.limit(0), F.col("v"), 0).count() == 0


def test_scan_of_doubles_has_the_same_bits(spark):
    values = [math.sin(i) for i in range(800)]
    runs = [[r.scan.hex() for r in scan_blocks(frame(spark, values).repartition(p), F.col("v"), 800, chunk=50).orderBy("idx").collect()] for p in (1, 4)]
    assert runs[0] == runs[1] and float.fromhex(runs[0][-1]) == pytest.approx(math.fsum(values), abs=1e-9)


def test_scan_with_any_function_and_its_failure(spark):
    words = [None if i % 7 == 3 else chr(97 + i % 26) for i in range(100)]
    want, acc = [], None
    for w in words:
        acc = acc if w is None else w if acc is None else acc + w
        want.append(acc)
    rows = scan_with(frame(spark, words, "string").repartition(3), "v", 100, lambda a, b: a + b, chunk=9).orderBy("idx").collect()
    assert [r.scan for r in rows] == want

    def fails(a, b):
        raise ZeroDivisionError("combine")

    with pytest.raises(Exception, match="combine"):
        scan_with(frame(spark, words, "string"), "v", 100, fails, chunk=9).collect()


def test_compaction(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("keep"))
    rows = compact(df, F.col("keep"), "id").orderBy("slot").collect()
    assert [(r.slot, r.id) for r in rows] == [(k, 3 * k) for k in range(334)]
    assert compact(df, F.lit(False), "id").count() == 0


def test_random_calls_end(spark):
    random.seed(3)
    with Engine(spark, 3) as engine:
        for _ in range(6):
            n, chunk = random.randrange(0, 60), random.randrange(0, 8)
            df = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 0.001).alias("v"))
            got = engine.reduce(df, F.col("v"), n, init=0.0)
            assert got == pytest.approx(sum(i * 0.001 for i in range(n)), abs=1e-9)
            assert scan_blocks(df, F.col("v"), n, chunk=chunk).count() == n


def test_index_of_a_reduction_needs_no_dense_key(spark):
    df = spark.range(100).select((F.col("id") * 7919 % 101).alias("k"), F.lit(1).alias("v"))
    assert reduced(with_index(df, "k"), 100) == 100
