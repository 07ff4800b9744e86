"""Queries of the sample statistics, over events shaped as benchmark samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import samples as S
from blockloom.operators.blocks import with_index
from blockloom.sources import exports
from blockloom.storage import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VENDORS = ("alpha", "beta", "gamma", "delta", "beta::core")
BASELINE, EXCLUDED = "alpha", ("delta",)
_POOLS = ("alpha", "beta[static]", "beta::run", "gamma x7", "delta", "omega", "gammaz")


def query(sql: str | None) -> Callable[[Callable], Callable]:
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _samples(spark: SparkSession, sf_dir: str, low: int = 0, high: int = 2) -> DataFrame:
    """Events as (workload, pool, rep, ns); runs of two halves, by event number, with low and high."""
    events = table(spark, sf_dir, "events").where((F.col("event_id") % 2 >= low) & (F.col("event_id") % 2 < high))
    pool = F.element_at(F.array(*map(F.lit, _POOLS)), (F.col("user_id") % 7 + 1).cast("int"))
    return events.select(F.concat(F.initcap("event_type"), F.lit("_"), (F.col("user_id") % 5).cast("string")).alias("workload"), pool.alias("pool"), F.col("event_id").alias("rep"), F.col("value").alias("ns"))


_S = """s AS (SELECT upper(event_type[1]) || lower(event_type[2:]) || '_' || (user_id % 5) AS workload,
  (['alpha', 'beta[static]', 'beta::run', 'gamma x7', 'delta', 'omega', 'gammaz'])[user_id % 7 + 1] AS pool, event_id AS rep, value AS ns FROM events)"""
_M = f"{_S}, m AS (SELECT workload, pool, median(ns) AS ns FROM s WHERE ns IS NOT NULL GROUP BY 1, 2)"
_B = f"""{_M}, b AS (SELECT workload, CASE WHEN pool = 'alpha' OR pool LIKE 'alpha[%' OR pool LIKE 'alpha::%' OR pool LIKE 'alpha %' THEN 'alpha'
  WHEN pool = 'beta' OR pool LIKE 'beta[%' OR pool LIKE 'beta::%' OR pool LIKE 'beta %' THEN 'beta'
  WHEN pool = 'gamma' OR pool LIKE 'gamma[%' OR pool LIKE 'gamma::%' OR pool LIKE 'gamma %' THEN 'gamma'
  WHEN pool = 'delta' OR pool LIKE 'delta[%' OR pool LIKE 'delta::%' OR pool LIKE 'delta %' THEN 'delta' ELSE pool END AS pool, min(ns) AS ns FROM m WHERE ns > 0 GROUP BY 1, 2)"""
_R = f"""{_B}, r AS (SELECT p.workload, p.pool, p.ns, a.ns AS base_ns, p.ns / a.ns AS ratio FROM b p JOIN b a ON a.workload = p.workload AND a.pool = 'alpha' WHERE p.pool NOT IN ('alpha', 'delta'))"""
_FAMILY = "lower(split_part(workload, '_', 1))"
_C = f"{_R}, c AS (SELECT {_FAMILY} AS family, pool, exp(avg(ln(ratio))) AS g FROM r WHERE ratio > 0 GROUP BY 1, 2)"


def _medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.medians(_samples(spark, sf_dir))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_variants(_medians(spark, sf_dir), VENDORS)


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.baseline_ratios(_best(spark, sf_dir), BASELINE, EXCLUDED)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH {_M} SELECT workload, pool, round(ns, 9) AS ns FROM m")
def stat_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_medians(spark, sf_dir), "ns")


@query(f"WITH {_S} SELECT workload, pool, rep, ns, row_number() OVER (ORDER BY workload, pool, rep) - 1 AS position FROM s")
def stat_sorted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_index(_samples(spark, sf_dir), "workload", "pool", "rep", name="position")


@query(f"WITH {_S} SELECT DISTINCT workload, {_FAMILY} AS family FROM s")
def stat_distinct_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_names(_samples(spark, sf_dir))


@query(f"WITH {_S} SELECT workload, count(*) AS n FROM s WHERE contains(workload, 'Click') OR contains(workload, '_3') GROUP BY workload")
def stat_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.named(_samples(spark, sf_dir), ["Click", "_3"]).groupBy("workload").agg(F.count("*").alias("n"))


@query(f"WITH {_B} SELECT workload, pool, round(ns, 9) AS ns FROM b")
def stat_best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_best(spark, sf_dir), "ns")


@query(f"WITH {_R} SELECT workload, pool, round(ratio, 9) AS ratio FROM r")
def stat_ratio_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ratios(spark, sf_dir).select("workload", "pool", "ratio"), "ratio")


@query(f"WITH {_R} SELECT workload, pool, round(ns, 9) AS ns, round(base_ns, 9) AS base_ns FROM r")
def stat_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.scatter_points(_ratios(spark, sf_dir)), "ns", "base_ns")


@query(f"WITH {_R} SELECT pool, avg((ratio > 1)::INTEGER) AS win_rate FROM r GROUP BY pool")
def stat_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.win_rates(_ratios(spark, sf_dir))


@query(f"WITH {_R} SELECT pool, workload, round(ratio, 9) AS ratio, (row_number() OVER w - 1)::INTEGER AS position, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY pool)::DOUBLE AS share FROM r WINDOW w AS (PARTITION BY pool ORDER BY ratio DESC, workload)")
def stat_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.survival(_ratios(spark, sf_dir)), "ratio")


@query(f"WITH {_R} SELECT pool, round(exp(avg(ln(ratio))), 9) AS geomean FROM r WHERE ratio > 0 GROUP BY pool")
def stat_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ratios(spark, sf_dir).groupBy("pool").agg(S.geomean(F.col("ratio")).alias("geomean")), "geomean")


@query(f"WITH {_C} SELECT pool, round(g, 9) AS geomean FROM c WHERE family = 'click'")
def stat_family_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.family_geomeans(_ratios(spark, sf_dir), "click"), "geomean")


@query(f"""WITH {_C} SELECT family, pool, round(g, 9) AS geomean, 'cell' AS level FROM c
UNION ALL SELECT family, NULL, round(exp(avg(ln(g))), 9), 'family' FROM c GROUP BY family
UNION ALL SELECT NULL, pool, round(exp(avg(ln(g))), 9), 'peer' FROM c GROUP BY pool""")
def stat_scorecard_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.scorecard(_ratios(spark, sf_dir)), "geomean")


@query(f"""WITH {_C} SELECT family, round(max(g) FILTER (WHERE pool = 'beta'), 9) AS beta, round(max(g) FILTER (WHERE pool = 'gamma'), 9) AS gamma, round(max(g) FILTER (WHERE pool = 'omega'), 9) AS omega FROM c GROUP BY family""")
def stat_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.pivot_scorecard(_ratios(spark, sf_dir), ["beta", "gamma", "omega"]), "beta", "gamma", "omega")


@query(f"""WITH {_R}, f AS (SELECT workload, arg_min(pool, (ns, pool)) AS pool, min(ns) AS ns, min(base_ns) AS base_ns FROM r GROUP BY workload)
SELECT workload, pool, round(base_ns / ns, 9) AS slowdown FROM f WHERE ns < base_ns ORDER BY base_ns / ns DESC, workload LIMIT 20""")
def top_n_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.losses(_ratios(spark, sf_dir), 20), "slowdown")


_DIFF = f"""{_S}, x AS (SELECT workload, pool, median(ns) FILTER (WHERE rep % 2 = 0) AS b, median(ns) FILTER (WHERE rep % 2 = 1) AS t FROM s GROUP BY 1, 2),
d AS (SELECT workload, pool, b, t, t / b AS ratio, (t / b - 1) * 100 AS delta FROM x WHERE b > 0 AND t IS NOT NULL AND contains(pool, 'a')),
e AS (SELECT *, CASE WHEN delta > 2 THEN 'REGRESS' WHEN delta < -2 THEN 'WIN' ELSE '' END AS flag FROM d)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.diff_runs(S.medians(_samples(spark, sf_dir, 0, 1)), S.medians(_samples(spark, sf_dir, 1, 2)), pool_has="a")


@query(f"WITH {_DIFF} SELECT workload, pool, round(b, 9) AS base_ns, round(t, 9) AS target_ns, round(ratio, 9) AS ratio, round(delta, 7) AS delta_pct, flag FROM e")
def stat_diff_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_diff(spark, sf_dir), "base_ns", "target_ns", "ratio").withColumn("delta_pct", F.round("delta_pct", 7))


@query(f"WITH {_DIFF} SELECT count(*) AS cells, count(*) FILTER (WHERE flag = 'WIN') AS wins, count(*) FILTER (WHERE flag = 'REGRESS') AS regressions FROM e")
def stat_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.diff_counts(_diff(spark, sf_dir))


_P25 = f"""{_S}, l AS (SELECT workload, pool, list_sort(list(ns)) AS v, len(list(ns)) AS n FROM s WHERE ns IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, v[n // 4 + 1] AS p25, n * 10 // 100 AS lo, n * 50 // 100 AS hi FROM l),
w AS (SELECT *, v[lo + (hi - lo) // 2 + 1] AS mid FROM h),
e AS (SELECT *, list_sort(list_transform(v[lo + 1 : hi], lambda x: abs(x - mid))) AS dev FROM w),
t AS (SELECT workload, pool, p25 AS ns_per_op, CASE WHEN p25 > 0 THEN 1e9 / p25 ELSE 0 END AS ops_per_sec, CASE WHEN hi - lo >= 2 AND p25 > 0 THEN 100 * 1.4826::DOUBLE * dev[(hi - lo) // 2 + 1] / p25 ELSE 0 END AS err_pct FROM e)"""


@query(f"WITH {_P25} SELECT workload, pool, ns_per_op, round(ops_per_sec, 3) AS ops_per_sec, round(err_pct, 9) AS err_pct FROM t")
def stat_p25_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.summary(_samples(spark, sf_dir)), "err_pct").withColumn("ops_per_sec", F.round("ops_per_sec", 3))


@query(f"""WITH {_S}, l AS (SELECT workload, pool, list_sort(list(ns)) AS v, len(list(ns)) AS n FROM s WHERE ns IS NOT NULL GROUP BY 1, 2)
SELECT workload, pool, v[floor(0.25::DOUBLE * (n - 1))::BIGINT + 1] AS p25, v[floor(0.5::DOUBLE * (n - 1))::BIGINT + 1] AS p50, v[floor(0.99::DOUBLE * (n - 1))::BIGINT + 1] AS p99 FROM l""")
def stat_tail_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tail_percentiles(_samples(spark, sf_dir))


@query(f"WITH {_S} SELECT workload, pool, round(CASE WHEN count(ns) < 2 OR avg(ns) = 0 THEN 0 ELSE 100 * stddev_samp(ns) / abs(avg(ns)) END, 7) AS rel_stddev_pct FROM s GROUP BY 1, 2")
def stat_rel_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.relative_stddev(_samples(spark, sf_dir)).withColumn("rel_stddev_pct", F.round("rel_stddev_pct", 7))


@query(f"""WITH {_P25}, b AS (SELECT workload, arg_min(ns_per_op, pool) AS base FROM t WHERE starts_with(pool, 'beta') GROUP BY workload)
SELECT t.workload, pool, round(CASE WHEN base > 0 AND ns_per_op > 0 THEN 100 * base / ns_per_op END, 9) AS relative_pct FROM t LEFT JOIN b USING (workload)""")
def stat_relative_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.relative_to(S.summary(_samples(spark, sf_dir)), "beta", order="pool")
    return _rounded(rows.select("workload", "pool", "relative_pct"), "relative_pct")


@query("""SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.2fG', v / 1e9) WHEN v >= 1e6 THEN printf('%.2fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.2fk', v / 1e3) WHEN v >= 1 THEN printf('%.2f', v) ELSE printf('%.3f', v) END AS shown
FROM (SELECT o_orderkey, o_totalprice * power(10.0::DOUBLE, (o_orderkey % 13)::DOUBLE - 7) AS v FROM orders)""")
def stat_si_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_totalprice") * S.power_of_ten(F.col("o_orderkey") % 13 - 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.si_number(value).alias("shown"))


@query(None)
def stat_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bootstrap(_samples(spark, sf_dir))


@query(None)
def stat_bootstrap_half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bootstrap_half_width(_samples(spark, sf_dir))


@query(f"WITH {_S} SELECT workload, pool, rep, (rep * 3)::DOUBLE AS cycles, ns FROM s")
def stat_export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples written as JSON exports and read back."""
    path = scratch(spark, "exports")
    samples = _samples(spark, sf_dir).withColumn("cycles", (F.col("rep") * 3).cast("decimal(20,0)"))
    exports.write_export(samples, {"tool": "events", "cpu_logical": 8}, path)
    _, back = exports.read_export(spark, path)
    return back.select("workload", "pool", "rep", F.col("cycles").cast("double").alias("cycles"), "ns")
