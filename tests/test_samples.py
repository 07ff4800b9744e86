import functools
import json
import math
import statistics
import tracemalloc
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import samples as S
from blockloom.queries import stats
from blockloom.sources import exports

VENDORS = ["X", "Y"]


def cells(spark, rows):
    return spark.createDataFrame(rows, "workload string, pool string, ns double")


def runs(spark, by_key):
    return spark.createDataFrame([(w, p, k, v) for (w, p), vs in by_key.items() for k, v in enumerate(vs)], "workload string, pool string, rep long, ns double")


def test_medians_and_ranks(spark):
    data = {(f"w{i}", f"p{j}"): [float((i * 31 + j * 17 + k * k * 7) % 23) for k in range(4 + j)] for i in range(2) for j in range(3)}
    got = {(r.workload, r.pool): r.ns for r in S.medians(runs(spark, data).repartition(5)).collect()}
    assert got == {k: statistics.median(v) for k, v in data.items()}
    with_gaps = {("w", "p"): [3.0, None, float("nan"), 1.0]}
    assert S.medians(runs(spark, with_gaps)).first().ns == 2.0
    assert S.medians(runs(spark, data).limit(0)).count() == 0


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("X", "X[a]", "X::b", "X c", "Xz")], "p string")
    assert [r[0] for r in df.select(S.canonical(F.col("p"), VENDORS)).collect()] == ["X", "X", "X", "X", "Xz"]
    assert spark.range(1).select(S.family(F.lit("Scan_a_b")), S.family(F.lit("Plain"))).first()[:] == ("scan", "plain")


def test_best_variant_drops_unusable(spark):
    rows = [("w", "X", 5.0), ("w", "X[a]", 3.0), ("w", "Y", float("nan")), ("w", "Y::b", 0.0), ("w", "Y c", -1.0), ("w", "Z", float("inf"))]
    assert [tuple(r) for r in S.best_variants(cells(spark, rows), VENDORS).collect()] == [("w", "X", 3.0)]


def test_ratios_rates_and_margins(spark):
    rows = [("a_1", "B", 2.0), ("a_1", "X", 4.0), ("a_1", "Y", 1.0), ("a_2", "B", 2.0), ("a_2", "X", 8.0), ("b_1", "X", 9.0), ("b_2", "B", 1.0), ("b_2", "Y", 16.0), ("b_2", "gone", 5.0)]
    ratios = S.baseline_ratios(cells(spark, rows), "B", ["gone"])
    assert {(r.workload, r.pool): r.ratio for r in ratios.collect()} == {("a_1", "X"): 2.0, ("a_1", "Y"): 0.5, ("a_2", "X"): 4.0, ("b_2", "Y"): 16.0}
    assert [tuple(r) for r in S.win_rates(ratios).collect()] == [("X", 1.0), ("Y", 0.5)]
    assert [(r.ratio, r.share) for r in S.survival(ratios).where("pool = 'X'").orderBy("position").collect()] == [(4.0, 0.0), (2.0, 0.5)]
    card = {(r.family, r.pool): r.geomean for r in S.scorecard(ratios).collect()}
    x, y_a, y_b = math.sqrt(8), 0.5, 16.0
    assert card[("a", "X")] == pytest.approx(x) and card[("a", None)] == pytest.approx(math.sqrt(x * y_a)) and card[(None, "Y")] == pytest.approx(math.sqrt(y_a * y_b))
    pivot = {r.family: r for r in S.pivot_scorecard(ratios, ["X", "Y"]).collect()}
    assert math.isnan(pivot["b"].X) and pivot["b"].Y == pytest.approx(16.0)
    assert [tuple(r) for r in S.losses(ratios).collect()] == [("a_1", "Y", 2.0)]
    assert [r.pool for r in S.family_geomeans(ratios, "a").collect()] == ["Y", "X"]
    assert {tuple(r) for r in S.scatter_points(ratios).collect()} >= {("a_1", "X", 4.0, 2.0)}


def test_losses_take_the_first_of_equal_peers_and_no_draws(spark):
    rows = [("w", "B", 2.0), ("w", "d", 1.0), ("w", "c", 1.0), ("v", "B", 2.0), ("v", "c", 2.0)]
    assert [tuple(r) for r in S.losses(S.baseline_ratios(cells(spark, rows), "B")).collect()] == [("w", "c", 2.0)]


def test_geomean_of_nothing(spark):
    got = spark.createDataFrame([(-1.0,), (0.0,), (float("inf"),)], "v double").agg(S.geomean(F.col("v"))).first()[0]
    assert math.isnan(got)


def test_diff(spark):
    base, target = cells(spark, [("a", "e", 100.0), ("b", "e", 100.0), ("c", "e", 100.0), ("d", "e", 0.0), ("x", "e", 1.0)]), cells(spark, [("a", "e", 103.0), ("b", "e", 97.0), ("c", "e", 101.0), ("d", "e", 5.0), ("y", "e", 1.0)])
    diff = S.diff_runs(base, target)
    assert [(r.workload, r.flag) for r in diff.collect()] == [("b", "WIN"), ("c", ""), ("a", "REGRESS")]
    assert tuple(S.diff_counts(diff).first()) == (3, 1, 1) and S.diff_runs(base, target, workload_has="a").count() == 1 and S.diff_runs(base, target, pool_has="z").count() == 0


def summary_of(values):
    v = sorted(values)
    n, p25 = len(v), v[len(v) // 4]
    lo, hi = n * 10 // 100, n * 50 // 100
    err = 0.0
    if hi - lo >= 2 and p25 > 0:
        mid = v[lo + (hi - lo) // 2]
        err = 100 * 1.4826 * sorted(abs(x - mid) for x in v[lo:hi])[(hi - lo) // 2] / p25
    return p25, err


@pytest.mark.parametrize("n", [1, 2, 4, 5, 20, 100])
def test_summary(spark, n):
    values = [float(k * k * 37 % 101) + 1 for k in range(n)]
    row = S.summary(runs(spark, {("w", "p"): values})).first()
    p25, err = summary_of(values)
    assert row.ns_per_op == p25 and row.err_pct == pytest.approx(err) and row.ops_per_sec == 1e9 / p25
    tail = S.tail_percentiles(runs(spark, {("w", "p"): values})).first()
    assert [tail.p25, tail.p50, tail.p99] == [sorted(values)[int(p * (n - 1))] for p in (0.25, 0.5, 0.99)]


def test_relative_stddev(spark):
    got = {r.pool: r.rel_stddev_pct for r in S.relative_stddev(runs(spark, {("w", "one"): [5.0], ("w", "zero"): [-1.0, 1.0], ("w", "x"): [1.0, 3.0]})).collect()}
    assert got["one"] == 0.0 and got["zero"] == 0.0 and got["x"] == pytest.approx(100 * math.sqrt(2) / 2)


def test_relative_column(spark):
    df = spark.createDataFrame([("w", "b[1]", 4.0, 1), ("w", "b[0]", 2.0, 0), ("w", "c", 1.0, 2), ("v", "c", 1.0, 0)], "workload string, pool string, ns_per_op double, row int")
    got = {(r.workload, r.pool): r.relative_pct for r in S.relative_to(df, "b", order="row").collect()}
    assert got == {("w", "b[1]"): 50.0, ("w", "b[0]"): 100.0, ("w", "c"): 200.0, ("v", "c"): None}


def test_si(spark):
    df = spark.createDataFrame([(v,) for v in (1.5e9, 2.25e6, -3.1e3, 12.0, 0.5, 0.0)], "v double")
    assert [r[0] for r in df.select(S.si_number(F.col("v"))).collect()] == ["1.50G", "2.25M", "-3.10k", "12.00", "0.500", "0.000"]


def test_powers_of_ten_are_the_nearest_doubles(spark):
    got = spark.range(50).select(S.power_of_ten(F.col("id") - 25)).collect()
    assert [r[0] for r in got] == [float(f"1e{k}") for k in range(-25, 25)]


def test_si_numbers_near_a_tie(spark, tmp_path):
    """297500 * 10^-5 is a little over 2.975; times the double below 10^-5, a little under."""
    import duckdb

    prices = [(833341, 297500.0), (327719, 32350.0), (2, 12345.67), (12, 412345.5), (13, -2.5), (14, None)]
    spark.createDataFrame(prices, "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.shown for r in stats.QUERIES["stat_si_numbers"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        assert got == dict(db.sql(stats.ORACLES["stat_si_numbers"]).fetchall())
    assert (got[833341], got[327719]) == ("2.98", "0.324")


def test_bootstrap(spark):
    rng = np.random.default_rng(2)
    data = {("w", "few"): rng.normal(10, 1, 11).tolist(), ("w", "enough"): rng.normal(10, 1, 12).tolist(), ("w", "flat"): [3.0] * 40}
    got = {r.pool: r for r in S.bootstrap(runs(spark, data)).collect()}
    assert math.isnan(got["few"].lo) and got["few"].median == pytest.approx(np.median(data[("w", "few")]))
    own = np.array(data[("w", "enough")])
    held = np.median(own[np.random.default_rng(0xC1701).integers(0, 12, size=(1024, 12))], axis=1)
    assert got["enough"].lo == np.quantile(held, 0.025) and got["enough"].hi == np.quantile(held, 0.975)
    assert (got["flat"].lo, got["flat"].hi) == (3.0, 3.0)


@pytest.mark.parametrize("n", [501, 100_000])
def test_bootstrap_of_any_size_is_numpys(spark, n):
    own = np.random.default_rng(4).normal(10, 1, n)
    data = runs(spark, {("w", "p"): own.tolist()})
    got = S.bootstrap(data, resamples=64).first()
    rng = np.random.default_rng(0xC1701)
    held = np.array([np.median(own[rng.integers(0, n, size=n)]) for _ in range(64)])
    assert (got.median, got.lo, got.hi) == (np.median(own), np.quantile(held, 0.025), np.quantile(held, 0.975))
    twister = S.MersenneTwister64(0xC1709F22AB)
    upper = np.sort([np.sort(own[twister.below(n, n)])[n // 2] for _ in range(64)])
    want = 100 * (upper[64 * 975 // 1000] - upper[64 * 25 // 1000]) * 0.5 / np.sort(own)[n // 2]
    assert S.bootstrap_half_width(data, resamples=64).first().ci_pct == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("n", [30, 5000])
def test_resampled_ranks_are_those_of_sorted_resamples(monkeypatch, n):
    """However many draws are made at once, and when a rank lies out of reach."""
    own = np.random.default_rng(6).integers(0, n // 3, n).astype(float)
    own[3] = np.inf
    rng = np.random.default_rng(7)
    want = np.sort(own[rng.integers(0, n, size=(40, n))])[:, [n // 2 - 1, n // 2]]
    twice = lambda: functools.partial(lambda rng, k: rng.integers(0, n, size=k), np.random.default_rng(7))
    for draws, reach in ((1 << 18, 6.0), (1001, 6.0), (1 << 18, 0.01)):
        monkeypatch.setattr(S, "DRAWS", draws)
        assert np.array_equal(S._resampled(own, [n // 2 - 1, n // 2], 40, twice, reach), want)


@pytest.mark.parametrize("query", [S.bootstrap, S.bootstrap_half_width])
def test_bootstraps_hold_no_resamples(spark, monkeypatch, query):
    """The memory of a key's 1,024 resamples: 130 MB would be all draws of 16,000 samples."""
    used = []
    monkeypatch.setattr(S, "_by_key", lambda samples, keys, order, value, names, use: used.append(use))
    query(None)
    own = np.random.default_rng(8).normal(10, 1, 16_000)
    tracemalloc.start()
    used[0](own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_bootstrap_takes_samples_in_their_order(spark):
    """Rows dealt out in any way, a key that is null, an order with nulls, and keys of many batches."""
    own = np.random.default_rng(9).normal(10, 1, 25_000)
    rows = [(None, "p", k, float(v)) for k, v in enumerate(own[:-1])] + [(None, "p", None, float(own[-1])), ("w", "p", 1, 2.0), ("w", "p", 0, None)]
    data = spark.createDataFrame(rows, "workload string, pool string, rep long, ns double").orderBy(F.hash("ns")).repartition(7)
    got = {r.workload: r for r in S.bootstrap(data, resamples=20).collect()}
    held = np.median(own[np.random.default_rng(0xC1701).integers(0, 25_000, size=(20, 25_000))], axis=1)
    assert (got[None].lo, got[None].hi) == (np.quantile(held, 0.025), np.quantile(held, 0.975))
    assert got["w"].median == 2.0 and math.isnan(got["w"].lo)


def test_half_width_of_few_and_equal_samples(spark):
    half = {r.pool: r.ci_pct for r in S.bootstrap_half_width(runs(spark, {("w", "few"): [1.0, 2.0] * 14, ("w", "flat"): [3.0] * 40})).collect()}
    assert half == {"few": 0.0, "flat": 0.0}


def test_mersenne_twister():
    """The C++ standard's value for the default seed."""
    assert int(S.MersenneTwister64(5489).numbers(10_000)[-1]) == 9981545732273789042
    a, b = S.MersenneTwister64(7), S.MersenneTwister64(7)
    assert np.array_equal(np.concatenate([a.numbers(5), a.numbers(400)]), b.numbers(405))
    assert all(int(x) * 12345 >> 64 == y for x, y in zip(S.MersenneTwister64(9).numbers(50), S.MersenneTwister64(9).below(12345, 50), strict=True))


def document(**changes):
    doc = {"schema_version": 1, "context": {"tool": "bench", "cpu_logical": 8, "fast_version": "1.2", "checklist": [{"name": "aslr", "status": "OK", "detail": ""}]}, "samples": [{"workload": "b", "pool": "p", "rep": 1, "cycles": "18446744073709551615", "ns": 1.5}, {"workload": "a", "pool": "p", "rep": 0, "cycles": "7", "ns": None}]}
    return doc | changes


def test_read_export(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document(), indent=2))
    context, samples = exports.read_export(spark, str(tmp_path), "fast")
    assert [(r.workload, r.rep, int(r.cycles), r.ns) for r in samples.collect()] == [("a", 0, 7, None), ("b", 1, 2**64 - 1, 1.5)]
    row = context.first()
    assert (row.tool, row.fast_version, row.fast_dirty, row.hostname, row.cpu_logical, row.checklist[0].name) == ("bench", "1.2", False, "", 8, "aslr")


@pytest.mark.parametrize("text", ["{not json", "[1]", json.dumps(document(schema_version=2)), json.dumps(document(context=3)), json.dumps({"schema_version": 1, "context": {}})])
def test_wrong_exports(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError):
        exports.read_export(spark, str(tmp_path))


def test_read_samples_skips_what_is_no_json(spark, tmp_path):
    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": 9}))
    (tmp_path / "c.json").write_text(json.dumps(document()))
    (tmp_path / "d.txt").write_text("no")
    assert exports.read_samples(spark, str(tmp_path)).count() == 2


def test_write_export_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([("a", "p", 0, Decimal(5), 1.25), ("a", "p", 1, Decimal(6), float("nan")), ("b/c", "q", 0, Decimal(7), float("inf"))], "workload string, pool string, rep long, cycles decimal(20,0), ns double")
    context = {"tool": "bench", "cpu_logical": 4, "checklist": [{"name": "n", "status": "OK", "detail": "d"}]}
    exports.write_export(samples, context, str(tmp_path / "out"))
    back, rows = exports.read_export(spark, str(tmp_path / "out"))
    assert [(r.workload, r.rep, r.ns) for r in rows.collect()] == [("a", 0, 1.25), ("a", 1, None), ("b/c", 0, None)]
    assert {r.tool for r in back.collect()} == {"bench"}
