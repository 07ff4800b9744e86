"""Statistics of benchmark samples: rows (workload, pool, rep, cycles, ns).

Medians and percentiles come from ranks in one range-sorted order of all keys, so a key that holds most of the rows is
spread over tasks like any other range.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators.blocks import with_index

KEYS = ("workload", "pool")
_MAD_TO_SIGMA = 1.4826


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def ranked(samples: DataFrame, keys: Sequence[str] = KEYS, value: str = "ns") -> DataFrame:
    """(*keys, value, n, rank): the rank from 0 of each row's value within its keys. Null and NaN values are left out."""
    clean = samples.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, value)
    indexed = with_index(clean, *keys, value, name="__at")
    starts = indexed.groupBy(*keys).agg(F.min("__at").alias("__start"), F.count("*").alias("n"))
    own = starts.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return indexed.join(own, same).select(*keys, value, "n", (F.col("__at") - F.col("__start")).alias("rank"))


def _at(rank: Column, value: str, name: str) -> Column:
    """The value at a rank, as an aggregate."""
    return F.max(F.when(F.col("rank") == rank, F.col(value))).alias(name)


def _floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def medians(samples: DataFrame, keys: Sequence[str] = KEYS, value: str = "ns") -> DataFrame:
    """(*keys, value): the median of each key; of an even number of values, the mean of the middle two."""
    middle = ranked(samples, keys, value).where((F.col("rank") == F.floor((F.col("n") - 1) / 2)) | (F.col("rank") == F.floor(F.col("n") / 2)))
    return middle.groupBy(*keys).agg(F.avg(value).alias(value))


def family(workload: Column) -> Column:
    """The text before the first underscore, in lower case."""
    return F.lower(F.substring_index(workload, "_", 1))


def canonical(pool: Column, vendors: Iterable[str]) -> Column:
    """The first vendor that the name equals or begins with, before `[`, `::` or a blank; other names stay as they are."""
    out = pool
    for v in reversed(list(vendors)):
        out = F.when((pool == v) | pool.startswith(v + "[") | pool.startswith(v + "::") | pool.startswith(v + " "), F.lit(v)).otherwise(out)
    return out


def best_variants(cells: DataFrame, vendors: Iterable[str]) -> DataFrame:
    """(workload, pool, ns): the least positive, finite median of each canonical name."""
    usable = cells.where(_finite(F.col("ns")) & (F.col("ns") > 0))
    return usable.groupBy("workload", canonical(F.col("pool"), vendors).alias("pool")).agg(F.min("ns").alias("ns"))


def is_peer(pool: Column, baseline: str, excluded: Iterable[str] = (), own_prefix: str | None = None) -> Column:
    out = (pool != baseline) & ~pool.isin(list(excluded)) if list(excluded) else pool != baseline
    return out if own_prefix is None else out & ~pool.startswith(own_prefix)


def baseline_ratios(best: DataFrame, baseline: str, excluded: Iterable[str] = (), own_prefix: str | None = None) -> DataFrame:
    """(workload, pool, ns, base_ns, ratio) of each peer in each workload that has the baseline."""
    base = best.where(F.col("pool") == baseline).select("workload", F.col("ns").alias("base_ns")).where("base_ns > 0")
    peers = best.where(is_peer(F.col("pool"), baseline, excluded, own_prefix))
    return peers.join(base, "workload").select("workload", "pool", "ns", "base_ns", (F.col("ns") / F.col("base_ns")).alias("ratio"))


def scatter_points(ratios: DataFrame) -> DataFrame:
    return ratios.select("workload", "pool", "ns", "base_ns")


def win_rates(ratios: DataFrame) -> DataFrame:
    """(pool, win_rate): the share of workloads in which the baseline is faster; highest first."""
    return ratios.groupBy("pool").agg(F.avg((F.col("ratio") > 1).cast("double")).alias("win_rate")).orderBy(F.desc("win_rate"), "pool")


def survival(ratios: DataFrame) -> DataFrame:
    """(pool, workload, ratio, position, share): each peer's ratios from the highest down; share of those before.

    Positions are places in one range-sorted order of all pools, so no task holds a pool.
    """
    indexed = with_index(ratios.select("pool", "workload", "ratio"), "pool", F.desc("ratio"), "workload", name="__at")
    starts = indexed.groupBy("pool").agg(F.min("__at").alias("__start"), F.count("*").alias("n")).withColumnRenamed("pool", "__pool")
    position = F.col("__at") - F.col("__start")
    placed = indexed.join(starts, F.col("pool").eqNullSafe(F.col("__pool")))
    return placed.select("pool", "workload", "ratio", position.cast("int").alias("position"), (position / F.col("n")).alias("share"))


def geomean(value: Column) -> Column:
    """Geometric mean of the positive, finite values; NaN without any."""
    return F.coalesce(F.exp(F.avg(F.when(_finite(value) & (value > 0), F.log(value)))), F.lit(float("nan")))


def family_geomeans(ratios: DataFrame, of: str) -> DataFrame:
    """(pool, geomean) of one family, lowest first."""
    return ratios.where(family(F.col("workload")) == of).groupBy("pool").agg(geomean(F.col("ratio")).alias("geomean")).orderBy("geomean", "pool")


def scorecard(ratios: DataFrame) -> DataFrame:
    """(family, pool, geomean, level): cells, and margins (null family or pool), which are geomeans of cells, not of ratios."""
    cells = ratios.groupBy(family(F.col("workload")).alias("family"), "pool").agg(geomean(F.col("ratio")).alias("geomean")).where(_finite(F.col("geomean")) & (F.col("geomean") > 0))
    families = cells.groupBy("family").agg(geomean(F.col("geomean")).alias("geomean"))
    peers = cells.groupBy("pool").agg(geomean(F.col("geomean")).alias("geomean"))
    none = F.lit(None).cast("string")
    return (
        cells.select("family", "pool", "geomean", F.lit("cell").alias("level"))
        .unionByName(families.select("family", none.alias("pool"), "geomean", F.lit("family").alias("level")))
        .unionByName(peers.select(none.alias("family"), "pool", "geomean", F.lit("peer").alias("level")))
    )


def pivot_scorecard(ratios: DataFrame, pools: Sequence[str]) -> DataFrame:
    """(family, one column a peer): the cells as a matrix, NaN where there is none."""
    cells = scorecard(ratios).where("level = 'cell'").groupBy("family").pivot("pool", list(pools)).agg(F.first("geomean"))
    return cells.select("family", *[F.coalesce(F.col(f"`{p}`"), F.lit(float("nan"))).alias(p) for p in pools])


def losses(ratios: DataFrame, top: int = 20) -> DataFrame:
    """(workload, pool, slowdown): the fastest peer of each workload where it beats the baseline; the worst `top` of them."""
    fastest = ratios.groupBy("workload").agg(F.min(F.struct("ns", "pool", "base_ns")).alias("m")).select("workload", "m.pool", "m.ns", "m.base_ns")
    beaten = fastest.where("ns < base_ns").select("workload", "pool", (F.col("base_ns") / F.col("ns")).alias("slowdown"))
    return beaten.orderBy(F.desc("slowdown"), "workload").limit(top)


def diff_runs(base: DataFrame, target: DataFrame, *, workload_has: str = "", pool_has: str = "", threshold: float = 0.02) -> DataFrame:
    """(workload, pool, base_ns, target_ns, ratio, delta_pct, flag) of the cells that both have, by delta."""
    b = base.select("workload", "pool", F.col("ns").alias("base_ns")).where("base_ns > 0")
    t = target.select("workload", "pool", F.col("ns").alias("target_ns"))
    both = b.join(t, list(KEYS)).where(F.col("workload").contains(workload_has) & F.col("pool").contains(pool_has))
    delta = (F.col("target_ns") / F.col("base_ns") - 1) * 100
    flag = F.when(delta > threshold * 100, "REGRESS").when(delta < -threshold * 100, "WIN").otherwise("")
    return both.select("workload", "pool", "base_ns", "target_ns", (F.col("target_ns") / F.col("base_ns")).alias("ratio"), delta.alias("delta_pct"), flag.alias("flag")).orderBy("delta_pct", "workload", "pool")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count("*").alias("cells"), F.count_if(F.col("flag") == "WIN").alias("wins"), F.count_if(F.col("flag") == "REGRESS").alias("regressions"))


def named(samples: DataFrame, parts: Sequence[str], column: str = "workload") -> DataFrame:
    """The rows whose name holds any of the parts; without parts, all."""
    return samples.where(functools.reduce(Column.__or__, [F.col(column).contains(p) for p in parts])) if parts else samples


def distinct_names(samples: DataFrame) -> DataFrame:
    """(workload, family), each once, in order."""
    return samples.select("workload", family(F.col("workload")).alias("family")).distinct().orderBy("workload")


def summary(samples: DataFrame, keys: Sequence[str] = KEYS, value: str = "ns") -> DataFrame:
    """(*keys, ns_per_op, ops_per_sec, err_pct): the value at rank n / 4, and the scaled median deviation in the window of
    ranks from 10 to 50 percent (0 with fewer than two ranks in it)."""
    rows = ranked(samples, keys, value)
    lo, hi = F.floor(F.col("n") * 10 / 100), F.floor(F.col("n") * 50 / 100)
    middle = lo + F.floor((hi - lo) / 2)
    heads = rows.groupBy(*keys, "n").agg(_at(F.floor(F.col("n") / 4), value, "p25"), _at(middle, value, "centre"))
    window = rows.where((F.col("rank") >= lo) & (F.col("rank") < hi)).select(*keys, value)
    own = heads.select(*[F.col(k).alias(f"__{k}") for k in keys], "centre")
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    away = window.join(own, same).select(*keys, F.abs(F.col(value) - F.col("centre")).alias("away"))
    mads = ranked(away, keys, "away").where((F.col("rank") == F.floor(F.col("n") / 2)) & (F.col("n") >= 2)).select(*[F.col(k).alias(f"__{k}") for k in keys], "away")
    err = F.when(F.col("p25") > 0, F.coalesce(F.lit(100.0) * F.lit(_MAD_TO_SIGMA) * F.col("away") / F.col("p25"), F.lit(0.0))).otherwise(0.0)
    ops = F.when(F.col("p25") > 0, 1e9 / F.col("p25")).otherwise(0.0)
    return heads.join(mads, same, "left").select(*keys, F.col("p25").alias("ns_per_op"), ops.alias("ops_per_sec"), err.alias("err_pct"))


def tail_percentiles(samples: DataFrame, keys: Sequence[str] = KEYS, value: str = "ns") -> DataFrame:
    """(*keys, p25, p50, p99) at rank floor(percent / 100 * (n - 1))."""
    at = lambda p: _floor(F.lit(p / 100.0) * (F.col("n") - 1).cast("double"))
    return ranked(samples, keys, value).groupBy(*keys).agg(*[_at(at(p), value, f"p{p}") for p in (25, 50, 99)])


def relative_stddev(samples: DataFrame, keys: Sequence[str] = KEYS, value: str = "ns") -> DataFrame:
    """(*keys, rel_stddev_pct): sample deviation over the mean's size; 0 with fewer than two values or a mean of 0."""
    c = F.col(value)
    out = F.when((F.count(c) < 2) | (F.avg(c) == 0) | ~_finite(F.avg(c)), 0.0).otherwise(100 * F.stddev_samp(c) / F.abs(F.avg(c)))
    return samples.groupBy(*keys).agg(out.alias("rel_stddev_pct"))


def relative_to(rows: DataFrame, baseline: str, *, order: str, group: str = "workload", name: str = "pool", value: str = "ns_per_op") -> DataFrame:
    """rows with relative_pct: 100 * the baseline's value / the row's; null unless both are positive.

    The baseline is, by `order`, the first row of the group whose name begins so.
    """
    base = rows.where(F.col(name).startswith(baseline)).groupBy(group).agg(F.min(F.struct(order, value))[value].alias("__base")).withColumnRenamed(group, "__group")
    joined = rows.join(base, F.col(group).eqNullSafe(F.col("__group")), "left")
    return joined.select(*rows.columns, F.when((F.col("__base") > 0) & (F.col(value) > 0), 100 * F.col("__base") / F.col(value)).alias("relative_pct"))


def power_of_ten(exponent: Column) -> Column:
    """The double nearest to ten to a whole exponent; the JVM's pow(10, -5) is the one below it."""
    return F.concat(F.lit("1e"), exponent.cast("string")).cast("double")


def si_number(value: Column, digits: int = 3) -> Column:
    """The number with a G, M or k suffix and digits - 1 decimals; under 1, plain with `digits` decimals."""
    # format_number rounds the number's exact binary value; format_string its shortest decimal text
    text = lambda scale, places: F.replace(F.format_number(value / scale, places), F.lit(","), F.lit(""))
    size = F.abs(value)
    out = F.when(size >= 1e9, F.concat(text(1e9, digits - 1), F.lit("G"))).when(size >= 1e6, F.concat(text(1e6, digits - 1), F.lit("M")))
    return out.when(size >= 1e3, F.concat(text(1e3, digits - 1), F.lit("k"))).when(size >= 1, text(1.0, digits - 1)).otherwise(text(1.0, digits))


def _by_key(samples: DataFrame, keys: Sequence[str], order: str | None, value: str, names: Sequence[str], use: Callable[[np.ndarray], Sequence[float]]) -> DataFrame:
    """(*keys, *names): what use() makes of each key's values, in their order. Spark sorts; a task holds one key's values."""
    clean = samples.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, *([order] if order else []), F.col(value).cast("double").alias("__v"))
    schema = T.StructType([*[clean.schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in names]])
    by = [F.col(order).asc_nulls_last(), F.col("__v")] if order else []
    dealt = clean.repartition(*keys).sortWithinPartitions(*keys, *by).select(*keys, "__v")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in batches:
            held += memoryview(np.ascontiguousarray(batch.column(len(keys)).to_numpy())).cast("B")
        found = use(np.frombuffer(held, np.float64))
        yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], k.type) for k in key], *[pa.array([x], pa.float64()) for x in found]], names=schema.names)

    return dealt.groupBy(*keys).applyInArrow(run, schema)


#: Draws of a bootstrap made at once.
DRAWS = 1 << 18


def _resampled(own: np.ndarray, ranks: Sequence[int], resamples: int, seeded: Callable[[], Callable[[int], np.ndarray]], reach: float = 6.0) -> np.ndarray:
    """(resamples, ranks): the values at these ranks of each sorted resample; seeded()(k) draws the next k places from the start.

    A rank of a resample lies within a few roots of n of its rank in the samples. Samples that near are told apart, the rest
    are only below or above: a resample is a row of counts, 4 bytes a sample and what DRAWS draws take are held. Should a
    rank lie farther off, all is drawn again with a wider reach.
    """
    n = len(own)
    half = int(reach * math.sqrt(n)) + 8
    lo, hi = max(0, min(ranks) - half), min(n - 1, max(ranks) + half)
    near = np.unique(np.partition(own, (lo, hi))[lo : hi + 1])
    codes, bins = np.empty(n, np.int32), len(near) + 2
    for k in range(0, n, DRAWS):
        part = own[k : k + DRAWS]
        codes[k : k + DRAWS] = np.searchsorted(near, part) + (part >= near[0])
    draw, together, out = seeded(), max(1, DRAWS // n), np.empty((resamples, len(ranks)))
    for first in range(0, resamples, together):
        rows = min(together, resamples - first)
        counts = np.zeros(rows * bins, np.int64)
        for at in range(0, rows * n, DRAWS):
            k = min(DRAWS, rows * n - at)
            counts += np.bincount(codes[draw(k)] + np.arange(at, at + k) // n * bins, minlength=rows * bins)
        upto = counts.reshape(rows, bins).cumsum(1)
        for c, rank in enumerate(ranks):
            code = (upto <= rank).sum(1)
            if code.min() == 0 or code.max() == bins - 1:
                return _resampled(own, ranks, resamples, seeded, 4 * reach)
            out[first : first + rows, c] = near[code - 1]
    return out


def bootstrap(samples: DataFrame, *, resamples: int = 1024, ci: float = 0.95, seed: int = 0xC1701, least: int = 12, keys: Sequence[str] = KEYS, order: str = "rep", value: str = "ns") -> DataFrame:
    """(*keys, median, lo, hi): percentile bootstrap interval of the median; NaN bounds with fewer than `least` samples.

    Samples are resampled in the order of `order` with numpy's generator, draw for draw, whatever their number: a key of n
    samples takes resamples * n draws, of which DRAWS are held at once.
    """
    alpha = (1 - ci) / 2

    def resample(own: np.ndarray) -> list[float]:
        n, found = len(own), [float(np.median(own)), float("nan"), float("nan")]

        def seeded() -> Callable[[int], np.ndarray]:
            rng = np.random.default_rng(seed)
            return lambda k: rng.integers(0, n, size=k)

        if n >= least:
            held = _resampled(own, [n // 2] if n % 2 else [n // 2 - 1, n // 2], resamples, seeded).mean(1)
            found[1:] = float(np.quantile(held, alpha)), float(np.quantile(held, 1 - alpha))
        return found

    return _by_key(samples, keys, order, value, ("median", "lo", "hi"), resample)


class MersenneTwister64:
    """The 64-bit generator of the C++ standard, in numpy: what does not depend on each other is computed at once."""

    N, M = 312, 156

    def __init__(self, seed: int) -> None:
        state = [seed & 2**64 - 1]
        for i in range(1, self.N):
            state.append((6364136223846793005 * (state[-1] ^ state[-1] >> 62) + i) & 2**64 - 1)
        self.state, self.left = np.array(state, np.uint64), np.zeros(0, np.uint64)

    def _next(self, count: int) -> np.ndarray:
        """At least the next `count` numbers. Half a state is made at a time, from words that are known; all are tempered at once."""
        n, m = self.N, self.M
        s = np.empty(n + -(-count // m) * m, np.uint64)
        s[:n] = self.state
        for k in range(0, len(s) - n, m):
            x = (s[k : k + m] & np.uint64(0xFFFFFFFF80000000)) | (s[k + 1 : k + m + 1] & np.uint64(0x7FFFFFFF))
            s[k + n : k + n + m] = s[k + m : k + n] ^ (x >> np.uint64(1)) ^ (x & np.uint64(1)) * np.uint64(0xB5026F5AA96619E9)
        self.state = s[-n:].copy()
        y = s[n:]
        y ^= y >> np.uint64(29) & np.uint64(0x5555555555555555)
        y ^= y << np.uint64(17) & np.uint64(0x71D67FFFEDA60000)
        y ^= y << np.uint64(37) & np.uint64(0xFFF7EEE000000000)
        y ^= y >> np.uint64(43)
        return y

    def numbers(self, n: int) -> np.ndarray:
        out = np.concatenate([self.left, self._next(n - len(self.left))]) if n > len(self.left) else self.left
        self.left = out[n:].copy()
        return out[:n]

    def below(self, bound: int, n: int) -> np.ndarray:
        """n whole numbers from 0 to bound - 1: the high half of number * bound. For bounds under 2^32 a number is drawn again,
        as the library does it, with odds under 2^-32; here the first one stands."""
        x = self.numbers(n)
        high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
        b = np.uint64(bound)
        return ((high * b + (low * b >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def bootstrap_half_width(samples: DataFrame, *, resamples: int = 1024, seed: int = 0xC1709F22AB, least: int = 30, keys: Sequence[str] = KEYS, order: str = "rep", value: str = "ns") -> DataFrame:
    """(*keys, ci_pct): half the width of the 95 percent interval of the upper median as a percentage of it; 0 under `least` samples.

    Each resample is drawn with the 64-bit Mersenne Twister, in the order of `order`, whatever the number of samples.
    """

    def width(own: np.ndarray) -> list[float]:
        n = len(own)
        middle = float(np.partition(own, n // 2)[n // 2])
        if n < least or middle == 0 or not math.isfinite(middle):
            return [0.0]

        def seeded() -> Callable[[int], np.ndarray]:
            rng = MersenneTwister64(seed)
            return lambda k: rng.below(n, k)

        medians = np.sort(_resampled(own, [n // 2], resamples, seeded)[:, 0])
        return [100.0 * float(medians[resamples * 975 // 1000] - medians[resamples * 25 // 1000]) * 0.5 / abs(middle)]

    return _by_key(samples, keys, order, value, ("ci_pct",), width)
